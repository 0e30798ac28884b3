"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A window is a shortest run of lines that holds `min_words` words or more, from a line on or up to a line. In each, the
line of the least hash is selected: its hash is the fingerprint, its place a position, and neighbouring windows mostly
select the same one. Whatever two places share, if it is as long as a window, holds the same windows, so the same
positions are selected in it: a fingerprint that has one position only is in no repeat, and its windows go no further.
Positions that share a fingerprint are joined, and each match is extended both ways over the windows around it, which
reach back and forward from the position by `min_words` words: windows of equal content are matches, however their
surroundings differ. Of these the first by (document, line) stays, and the lines of all later ones go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import materialize, unused, words


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(df: DataFrame, text: str, doc_id: str, min_words: int) -> DataFrame:
    """(doc, version, first, last, fingerprint, position, content) of each window; two a line at most, of `min_words` lines at most."""
    line = F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.size(words(x)).alias("n")))
    rows = (
        df.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(line).alias("pos", "line"))
        .where("line.n > 0")
        .select("doc", "version", "pos", "line.*")
    )
    own = Window.partitionBy("doc", "version")
    one = F.row_number().over(Window.partitionBy("doc", "version", "pos").orderBy("h"))
    rows = rows.repartition("doc", "version").withColumn("copy", one).where("copy = 1")  # rows that repeat whole
    rows = rows.withColumn("until", F.sum(F.col("n").cast("long")).over(own.orderBy("pos"))).withColumn("since", F.col("until") - F.col("n"))
    made = []
    for frame, complete in (
        (own.orderBy("since").rangeBetween(0, min_words - 1), lambda w: F.max("until").over(w) - F.col("since")),
        (own.orderBy("until").rangeBetween(1 - min_words, 0), lambda w: F.col("until") - F.min("since").over(w)),
    ):
        made.append(F.struct(F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.min(F.struct("h", "pos")).over(frame).alias("selected"), F.xxhash64(F.collect_list("g").over(frame)).alias("content"), (complete(frame) >= min_words).alias("whole")))
    return rows.select("doc", "version", made[0].alias("ahead"), made[1].alias("behind")).select("doc", "version", F.explode(F.array("ahead", "behind")).alias("w")).where("w.whole").select("doc", "version", "w.first", "w.last", F.col("w.selected.h").alias("fingerprint"), F.col("w.selected.pos").alias("position"), "w.content")


def repeated_spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 50) -> DataFrame:
    """(doc, version, spans): for each document with later repeats, the spans of lines to delete, apart and in order.

    The windows are written once. Counting positions and equal windows combines on the map side, and of a group,
    however large, only its first place travels back to the windows, by joins that adaptive execution splits where
    they are skewed.
    """
    found = materialize(windows(df, text, doc_id, min_words), "windows")
    at = F.struct("doc", "version", "position")
    shared = found.groupBy("fingerprint").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low < high").select("fingerprint")
    met = materialize(found.join(shared, "fingerprint"), "met")
    first = met.groupBy("fingerprint", "content").agg(F.min(F.struct("doc", "version", "first")).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "origins")  # a plain side, so that the join splits where a window is in many places
    later = met.join(first, ["fingerprint", "content"]).where(F.struct("doc", "version", "first") > F.col("origin")).select("doc", "version", "first", "last")
    own = Window.partitionBy("doc", "version").orderBy("first", "last")
    later = later.withColumn("reach", F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("island", F.sum(F.when(F.col("first") > F.coalesce("reach", F.lit(-2)) + 1, 1).otherwise(0)).over(own))
    spans = later.groupBy("doc", "version", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 50) -> DataFrame:
    """All rows and columns of `df`, `text` without later repeated runs, and `removed_spans` array<struct<first, last>>.

    Lines end at `\\n`; lines without a word are passed over in matching, and go with a run around them. A run
    counts from `min_words` words on. First means smaller doc_id, then earlier line. Null or empty texts, texts
    shorter than `min_words` words and rows without doc_id stay as they are. Rows equal in doc_id and text are one
    document, and keep or lose the same lines; of equal doc_ids with different texts each is a document of its own.
    Texts of any length are read whole; an empty table stays empty. A column `removed_spans` that is there already is
    replaced; all other names are free.
    """
    key, version, found = (unused(df, f"__{x}") for x in ("doc", "version", "spans"))
    spans = repeated_spans(df, text, doc_id, min_words).select(F.col("doc").alias(key), F.col("version").alias(version), F.col("spans").alias(found))
    out = df.join(spans, (df[doc_id] == F.col(key)) & (F.xxhash64(df[text]) == F.col(version)), "left")
    kept = F.filter(_lines(df[text]), lambda _, i: ~F.exists(found, lambda s: (s["first"] <= i) & (i <= s["last"])))
    cleaned = F.when(F.col(found).isNull(), df[text]).otherwise(F.array_join(kept, "\n"))
    return out.select(*(cleaned.alias(c) if c == text else df[c] for c in df.columns if c != "removed_spans"), F.coalesce(found, F.array().cast("array<struct<first:int,last:int>>")).alias("removed_spans"))
