"""Quality rules: a learned decision list over document statistics, in DataFrame functions only.

Sequential covering: a rule grows by the threshold condition that adds most information about the rejected class
(FOIL gain) until it covers hardly any accepted row, is pruned by what its conditions are worth on rows held back
from growing, and its rows are taken out before the next rule grows. Growing reads one histogram of statistic,
bin and label for each condition; rows never leave the executors. The rules become one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import let, materialize, unused, words

BINS = 24
RULES = 8
CONDITIONS = 3
#: Labelled rows that the list is learned from, at most (in expectation); chosen by hash.
SAMPLE = 60_000


def statistics(text: Column) -> dict[str, Column]:
    """The base statistics of a text, each a native expression of long type; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
        "n_marks": F.length(F.regexp_replace(text, r"[^!?]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
    }


def window_hashes(w: Column, n: int = 5) -> Column:
    """64-bit hashes of the windows of n words, in order; no window if there are fewer words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column, n: int = 5) -> Column:
    """Words in windows that are found twice or more, each counted once.

    Only texts with a repeated window sort theirs; overlapping windows are summed by the distance to the next.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(o: Column) -> Column:
        alike = lambda x, k: F.coalesce(F.get(o, k)["h"] == x["h"], F.lit(False))
        return F.filter(o, lambda x, k: alike(x, k - 1) | alike(x, k + 1))

    places = F.array_sort(F.transform(let(ordered, again), lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(-n).alias("at"), F.lit(0).alias("sum")), lambda a, p: F.struct(p.alias("at"), (a["sum"] + F.least(p - a["at"], F.lit(n))).alias("sum")), lambda a: a["sum"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`df` with the statistics of its texts under `prefix`, each a long; a column of the same name is replaced."""
    names = statistics(F.col(text))
    out = df.withColumns({f"{prefix}{k}": v.cast("long") for k, v in names.items()})
    return out.withColumn(f"{prefix}n_repeat_words", let(let(words(F.col(text)), window_hashes), repeated_words).cast("long"))


def rates(prefix: str = "") -> dict[str, Column]:
    """What conditions are put on: statistics for each word or character, 0 where there is none."""
    c = lambda x: F.col(f"{prefix}{x}")
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "symbol_rate": per(c("n_symbols"), c("word_chars")),
        "upper_rate": per(c("n_upper"), c("word_chars")),
        "mark_rate": per(c("n_marks"), c("n_words")),
        "repeat_rate": per(c("n_repeat_words"), c("n_words")),
        "dup_lines": c("n_dup_lines").cast("double"),
        "word_length": per(c("word_chars"), c("n_words")),
        "words": c("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.statistic] > self.threshold if self.above else of[self.statistic] <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule, of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(of)
    return out


def learn(stats: DataFrame, label: str, prefix: str = "", bad_weight: float = 1.0) -> list[Rule]:
    """Rules for rows with label 0 (1: accepted; null labels are passed over), from rows with statistics and label.

    No label 0 or no rows: no rules. At most about SAMPLE rows are read, by hash of their statistics.
    """
    of = rates(prefix)
    rows = stats.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), *(v.alias(k) for k, v in of.items()))
    spread = F.xxhash64(*of, "y")
    total = rows.count()
    if total > SAMPLE:
        rows = rows.where(F.pmod(spread, F.lit(1_000_000)) < math.ceil(1_000_000 * SAMPLE / total))
    rows = materialize(rows.withColumn("held", F.pmod(F.shiftright(spread, 20), F.lit(3)) == 0), "rules")
    names = list(of)
    steps = rows.where("y = 0").agg(*(F.percentile_approx(k, [i / BINS for i in range(BINS + 1)], 2000).alias(k) for k in names)).first()
    both = rows.agg(*(F.percentile_approx(k, [i / BINS for i in range(BINS + 1)], 2000).alias(k) for k in names)).first()
    edges = {k: sorted({*(steps[k] or []), *(both[k] or [])}) for k in names}
    here = {k: F.col(k) for k in names}
    # edges[k][i] is the threshold under the rows of bin i + 1
    def bin_of(k: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges[k])), lambda t: t < F.col(k))) if edges[k] else F.lit(0)

    binned = materialize(rows.select("y", "held", *names, *(bin_of(k).alias(f"bin_{k}") for k in names)), "bins")

    def histogram(rule: Rule, left: Column) -> dict[str, dict[tuple[int, int], int]]:
        long = binned.where(~F.col("held") & left & _all(rule, here)).select("y", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"bin_{k}").alias("b")) for k in names))).alias("x"))
        out: dict[str, dict[tuple[int, int], int]] = {k: {} for k in names}
        for r in long.groupBy("x.k", "x.b", "y").count().collect():  # as many rows as there are bins
            out[r["k"]][r["b"], r["y"]] = r["count"]
        return out

    def gain(p: int, n: int, p0: int, n0: int) -> float:
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0

    rules: list[Rule] = []
    left = F.lit(True)
    for _ in range(RULES):
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            counts = histogram(rule, left)
            p0, n0 = (sum(v for (_, y), v in counts[names[0]].items() if y == label_) for label_ in (0, 1))
            if p0 < 5 or not rule and p0 * 200 < p0 + n0 or rule and n0 * 200 < p0:
                break
            best = (1e-9, None)
            for k in names:
                under = {0: 0, 1: 0}
                for i, t in enumerate(edges[k]):
                    for y in (0, 1):
                        under[y] += counts[k].get((i, y), 0)
                    for above in (True, False):
                        p, n = (p0 - under[0], n0 - under[1]) if above else (under[0], under[1])
                        best = max(best, (gain(p, n, p0, n0), (k, above, t)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule = (*rule, Condition(*best[1]))
        if not rule:
            break
        # prune: the shortest start of the rule that is worth as much on the rows held back
        starts = [rule[: i + 1] for i in range(len(rule))]
        worth = binned.where(F.col("held") & left).agg(*(F.count_if(_all(s, here) & (F.col("y") == y)).alias(f"w{i}_{y}") for i, s in enumerate(starts) for y in (0, 1))).first()
        value = [(worth[f"w{i}_0"] - bad_weight * worth[f"w{i}_1"]) / max(1, worth[f"w{i}_0"] + worth[f"w{i}_1"]) for i in range(len(starts))]
        i = max(range(len(starts)), key=lambda i: (value[i], -i))
        if worth[f"w{i}_0"] <= 4 * bad_weight * worth[f"w{i}_1"]:
            break
        rules.append(starts[i])
        left = left & ~_all(starts[i], here)
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list: the number of the first rule that rejects a row, or null if none does."""
    of, out = rates(prefix), None
    for i, rule in enumerate(rules):
        out = F.when(_all(rule, of), i) if out is None else out.when(_all(rule, of), i)
    return F.lit(None).cast("int") if out is None else out


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.statistic} {'>' if c.above else '<='} {c.threshold:g}" for c in r) for r in rules]


def apply_rules(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics and decisions: `keep`, the five statistics, base_failed, rejected_by (rule number or null), kept.

    Learned from the rows that `labels` (doc_id, label) covers. Null and empty texts have no words and fail the
    base rules, as do texts under 10 words or with over a fifth of their words in repeated windows. Rows that
    repeat are judged alike; rows without doc_id are judged but not learned from. An empty table gives an empty
    result, no labels a list without rules; of labels that differ for one doc_id the least counts. Texts of any length
    are read whole. Other columns are not read.
    """
    p, key, mark = "__", unused(df, "__id"), unused(df, "__label")
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    stats = materialize(with_statistics(df.select(*{*keep, doc_id, text}), text, p).drop(*({text} - {*keep})), "statistics")
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias(key), F.col(label).alias(mark)).groupBy(key).agg(F.min(mark).alias(mark))
    base = (F.col(f"{p}n_words") < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * F.col(f"{p}n_words"))
    rules = learn(stats.where(~base).join(known, F.col(doc_id) == F.col(key)), mark, p)
    named = [F.col(f"{p}{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    by = verdict(rules, p)
    return stats.select(*keep, *named, base.alias("base_failed"), F.when(~base, by).alias("rejected_by"), (~base & by.isNull()).alias("kept"))
