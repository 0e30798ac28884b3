"""URL filters: Spark's FP-growth mines combinations of URL tokens from labels; rules match by an inverted index.

A URL's tokens are its scheme, each suffix of its host, its path's folders and its file's ending, and the names of
its parameters; numbers are masked. Labelled URLs with their label as one more token go into FP-growth; a frequent
combination whose share of bad labels reaches `confidence`, and `lift` times that of all URLs, is a rule, unless a
part of it is a rule already. Hand-written rules by host and path go first; the longest that fits wins.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import lower_ascii, materialize

BAD = "label=bad"
GOOD = "label=good"
#: Most tokens of a combination, the label's included, and most mined rules that are matched as literals of the plan.
TOKENS, RULES = 4, 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Tokens of a URL, each once; numbers in paths are masked as `0`."""
    folders = F.filter(F.split(F.regexp_replace(path, r"\d+", "0"), "/"), lambda x: x != "")
    names = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^(.*?)://", 1)))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(
        F.array_distinct(F.concat(scheme, F.transform(suffixes(host), lambda x: F.concat(F.lit("host="), x)), F.transform(folders, lambda x: F.concat(F.lit("folder="), x)), F.transform(names, lambda x: F.concat(F.lit("name="), x)))),
        F.array().cast("array<string>"),
    )


def mine(df: DataFrame, labels: DataFrame, support: float = 0.002, confidence: float = 0.5, lift: float = 2.0, least: int = 20, url: str = "url", page_id: str = "page_id", bad: Column | None = None) -> list[tuple[frozenset[str], float, int]]:
    """Rules as (tokens, share of bad labels, labelled URLs they fit), best first; none without labels.

    labels: (doc_id, quality, toxic), doc_id being a page_id; a page is bad if its quality is 0 or it is toxic.
    Pages whose labels are all null are passed over; a page that repeats counts as often. Fewer labelled pages than
    `least`, or none that is bad, make no rules; nor do null URLs, and URLs of any length count whole. Where no token
    says more about the labels than chance, as in tables whose URLs and labels are independent, no rule passes.
    """
    spark = df.sparkSession
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1) if bad is None else bad
    known = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max(bad).alias("__bad"))
    host, path = split_url(F.col(url))
    rows = df.where(F.col(url).isNotNull()).join(known, F.col(page_id) == F.col("__id")).select(F.array_append(tokens(F.col(url), host, path), F.when(F.col("__bad"), BAD).otherwise(GOOD)).alias("items"))
    rows = materialize(rows.repartition(spark.sparkContext.defaultParallelism), "transactions")
    n = rows.count()
    share = rows.where(F.array_contains("items", BAD)).count() / n if n >= least else 0.0
    if not share:
        return []
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n))).fit(rows).freqItemsets.where(F.size("items") <= TOKENS)
    both = sets.where(F.array_contains("items", BAD)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("hits"))
    every = sets.where(~F.array_contains("items", BAD) & ~F.array_contains("items", GOOD)).select(F.array_sort("items").alias("tokens"), "freq")
    rules = both.join(every, "tokens").withColumn("share", F.col("hits") / F.col("freq")).where(f"share >= {confidence} AND share >= {lift * share}")
    # all of them: the support bounds their number, whatever the size of the table
    kept = minimal(materialize(rules.select("tokens", "share", "freq"), "rules"))
    return sorted(((frozenset(r["tokens"]), r["share"], r["freq"]) for r in kept.collect()), key=lambda r: (-r[1], -r[2], sorted(r[0])))


def minimal(rules: DataFrame) -> DataFrame:
    """The rules (sorted tokens, each set once, TOKENS - 1 at most) of which no part is a rule."""
    places = [[i for i in range(TOKENS - 1) if mask >> i & 1] for mask in range(1, (1 << (TOKENS - 1)) - 1)]
    parts = F.array(*(F.filter(F.array(*(F.get("tokens", F.lit(i)) for i in own)), lambda t: t.isNotNull()) for own in places))
    proper = F.filter(F.array_distinct(parts), lambda p: (F.size(p) > 0) & (F.size(p) < F.size("tokens")))
    over = rules.select("tokens", F.explode(proper).alias("part")).join(rules.select(F.col("tokens").alias("part")), "part", "left_semi")
    return rules.join(over.select("tokens").distinct(), "tokens", "left_anti")


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest hand-written rule (verdict, `host/path`) that fits; null if none does."""
    own = suffixes(host)
    rule = verdict = F.lit(None).cast("string")
    for action, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = pattern.partition("/")
        fits = F.array_contains(own, domain) & path.startswith(slash + start)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def judge(df: DataFrame, mined: list[tuple[frozenset[str], float, int]], rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keep`, host, path, rule (hand-written, or null), mined (number of the first mined rule, or null), verdict.

    The inverted index maps the rarest token of each mined rule to the rule, so a URL looks up its own tokens only.
    A URL that nothing fits is allowed. A null URL or one without `://` has no host and no path, and is allowed.
    URLs of any length are read whole; rows that repeat are judged alike, and an empty table gives an empty result.
    Map only up to RULES mined ones, which are literals as the hand-written are; more are joined to the distinct URLs.
    """
    host, path = split_url(F.col(url))
    index: dict[str, list[int]] = {}
    seen: dict[str, int] = {}
    for r, _, _ in mined:
        for t in r:
            seen[t] = seen.get(t, 0) + 1
    for i, (r, _, _) in enumerate(mined):
        index.setdefault(min(r, key=lambda t: (seen[t], -len(t), t)), []).append(i)
    own = F.col("__tokens")
    number = F.lit(None).cast("int")
    if 0 < len(mined) <= RULES:
        entries = F.create_map(*(x for k, v in index.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, sorted(mined[i][0]))).alias("t")) for i in v)))))
        found = F.flatten(F.transform(F.filter(own, lambda t: F.array_contains(F.lit([*index]), t)), lambda t: F.try_element_at(entries, t)))
        number = F.array_min(F.transform(F.filter(found, lambda x: F.forall(x["t"], lambda t: F.array_contains(own, t))), lambda x: x["i"]))
    out = df.select(*keep, F.col(url).alias("__url"), host.alias("__host"), path.alias("__path")).withColumn("__tokens", tokens(F.col("__url"), F.col("__host"), F.col("__path")))
    if len(mined) > RULES:
        entries = df.sparkSession.createDataFrame([(k, i, sorted(mined[i][0])) for k, v in index.items() for i in v], "__key string, __i int, __t array<string>")
        asked = out.where(F.col("__url").isNotNull()).select("__url", "__tokens").distinct().withColumn("__key", F.explode("__tokens"))
        fits = asked.join(F.broadcast(entries), "__key").where(F.forall("__t", lambda t: F.array_contains("__tokens", t)))
        out = out.join(fits.groupBy("__url").agg(F.min("__i").alias("__number")), "__url", "left")
        number = F.col("__number")
    rule, verdict = listed(F.col("__host"), F.col("__path"), rules)
    return out.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), number.alias("mined"), F.coalesce(verdict, F.when(number.isNotNull(), "block").otherwise("allow")).alias("verdict"))
