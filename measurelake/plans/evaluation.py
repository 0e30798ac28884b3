"""Evaluation of parsed quantities: comparison with gold, splits, curation, metrics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative difference up to which two values are the same.
TOLERANCE = 1e-9


def same_values(a: Column, b: Column) -> Column:
    """Whether two arrays of numbers are equal place by place, up to TOLERANCE; null if either is."""
    near = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y)), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)


def compare(gold: DataFrame, parsed: DataFrame, on: list[str]) -> DataFrame:
    """`on` and decision: `correct`, `false` or `manual`, for each gold span (type, values, units); left join on `on`.

    A span that wasn't parsed, or whose type or values differ, is false. Equal types and values with equal units are
    correct; where the units differ, or gold has none, a person has to decide. Units are sets of names of what they
    measure. Spans that repeat are compared each.
    """
    p = parsed.select(*on, F.col("type").alias("_type"), F.col("values").alias("_values"), F.col("units").alias("_units"))
    alike = F.col("type").eqNullSafe(F.col("_type")) & F.coalesce(same_values(F.col("values"), F.col("_values")), F.lit(False))
    units = F.array_sort(F.array_distinct("units")) == F.array_sort(F.array_distinct("_units"))
    return gold.join(p, on, "left").select(*on, F.when(~alike, "false").when(units, "correct").otherwise("manual").alias("decision"))


def positional_split(df: DataFrame, order: str, first: int) -> DataFrame:
    """`df` with `split`: `train` for the `first` rows by the unique column `order`, `dev` for the rest.

    The border is found by a top-k of `order` alone, so no global sort or single-task window is needed.
    """
    border = df.select(order).orderBy(order).limit(first).agg(F.max(order)).first()[0]  # one value
    return df.withColumn("split", F.when(F.col(order) <= F.lit(border), "train").otherwise("dev"))


def regroup(df: DataFrame, decision: str = "decision", manual: str = "manual_decision") -> DataFrame:
    """`df` with `decision` replaced by the manual one where a person had to decide and did."""
    return df.withColumn(decision, F.when(F.col(decision) == "manual", F.coalesce(manual, decision)).otherwise(F.col(decision)))


def transfer_curation(new: DataFrame, old: DataFrame, curated: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """`new` with the `curated` columns of the row of `old` that is equal in all other columns but `ignore`, nulls included.

    What `new` has itself stays. Of several equal old rows the least values count; a row is never doubled.
    """
    keys = [c for c in new.columns if c not in curated and c not in ignore]
    known = old.groupBy(*(F.col(c).alias(f"_{c}") for c in keys)).agg(*(F.min(c).alias(f"_{c}") for c in curated))
    joined = new.join(known, reduce(lambda a, b: a & b, (new[c].eqNullSafe(known[f"_{c}"]) for c in keys)), "left")
    return joined.select(*(F.coalesce(new[c], known[f"_{c}"]).alias(c) if c in curated else new[c] for c in new.columns))


def accuracy(df: DataFrame, by: list[str], ignored: tuple[str, ...] = (), correct: str = "correct", category: str = "error_category") -> DataFrame:
    """`by`, n, accuracy, and accuracy_kept: without the rows of `ignored` error categories. Null without rows."""
    kept = ~F.coalesce(F.col(category).isin(*ignored), F.lit(False)) if ignored else F.lit(True)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.count_if(correct), F.count(correct)).alias("accuracy"), F.try_divide(F.count_if(F.col(correct) & kept), F.count_if(F.col(correct).isNotNull() & kept)).alias("accuracy_kept"))


def self_assessment(df: DataFrame, by: list[str], success: str = "success", correct: str = "correct") -> DataFrame:
    """`by`, the confusion matrix of the parser's own success flag (null counts as no), precision, recall and f1."""
    said, right = F.coalesce(success, F.lit(False)), F.col(correct)
    counts = df.groupBy(*by).agg(*(F.count_if(a & b).alias(n) for n, a, b in (("tp", said, right), ("fp", said, ~right), ("fn", ~said, right), ("tn", ~said, ~right))))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(F.lit(2) * precision * recall, precision + recall)})


def error_categories(df: DataFrame, category: str = "error_category") -> DataFrame:
    """category, n and share of all categorised errors; only the counts, one row each, meet for the total."""
    counts = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def category_table(df: DataFrame, file: str, files: list[str], category: str = "error_category") -> DataFrame:
    """One row for each category, one column for each of `files`, 0 where a file has none."""
    return df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).pivot(file, files).agg(F.count(F.lit(1))).fillna(0, files)


def report(df: DataFrame, form: str = "markdown", most: int = 1000) -> str:
    """A small table as Markdown or LaTeX; larger ones than `most` rows are refused, since the driver holds them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    cells = [df.columns, *([("" if x is None else str(x)) for x in r] for r in rows)]
    if form == "latex":
        lines = [" & ".join(x.replace("_", r"\_").replace("%", r"\%") for x in r) + r" \\" for r in cells]
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])
    lines = ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in cells]
    return "\n".join([lines[0], "|" + " --- |" * len(df.columns), *lines[1:]])
