"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, in a fixed shuffled order, are one stream of words, cut into blocks of equal length (to
within a word). Each source has as many slots of the schedule as blocks come nearest to its target. Slot i stands at
the golden-ratio point frac(i * phi); the source in whose stretch of the sorted points it falls fills it with its
next block, and begins anew after its last. Points of this sequence are spread so evenly that each source has its
share of slots in any stretch of the schedule, to within a few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import materialize, words

PHI = (math.sqrt(5) - 1) / 2
#: Slots of the schedule that are ranked together before the ranks of the parts are summed.
CHUNK = 8192
#: Documents of a source that are summed together, on average.
SHELF = 4096
#: Blocks that a source is cut into at least, or one for each word: less than one slot would be nothing to a small one.
BLOCKS = 16


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Add `target` to (source, source_size): weights repeat over the sources by code point, null last.

    Sources stop at `most` times their size; the excess goes to the others by weight until none is above. A
    source stops exactly if the level (words for each unit of weight) passes most * size / weight, so sources in
    order of that bound stop one after the other, and the level is that of the first prefix that is consistent.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("bound", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("bound", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum(F.lit(float(most)) * F.col("source_size")).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(Window.partitionBy()) - stopped) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("common", F.max(F.when(F.col("level") <= F.col("bound"), F.col("level"))).over(Window.partitionBy()))
    target = F.least(F.col("weight") * F.coalesce("common", F.col("bound")), F.lit(float(most)) * F.col("source_size"))
    return ranked.withColumn("target", target).drop("bound", "level", "common")


def _mix(df: DataFrame, text: str, doc_id: str, source: str, weights: tuple[float, ...], most: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents with place and size, and how often each block is taken."""
    size = F.size(words(F.col(text))).cast("long")
    docs = materialize(df.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(doc_id), F.lit(seed)).alias("order"), F.xxhash64(text).alias("version")), "sizes")

    # sources of any size are cut into shelves by hash, so that no running sum is over a whole source
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.least("source_size", F.lit(BLOCKS)))
    # as many blocks as come nearest to the target, and never one more often than `most` allows
    quota = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.floor(F.col("blocks") * float(most)))
    sums = targets(sums, weights, most).withColumn("blocks", blocks).withColumn("quota", F.when(F.col("source_size") > 0, quota).otherwise(0).cast("long"))
    sums = materialize(sums, "sources")
    docs = docs.join(sums, docs["source"].eqNullSafe(sums["source"])).drop(sums["source"])
    docs = docs.withColumn("shelf", F.pmod(F.shiftrightunsigned("order", 1), F.ceil(F.col("n") / SHELF)))
    shelves = docs.groupBy("source", "shelf").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shelves = shelves.select(F.col("source").alias("s"), F.col("shelf").alias("f"), before.alias("base"))
    own = Window.partitionBy("source", "shelf").orderBy("order", "doc", "version")
    inside = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = docs.withColumn("inside", inside).withColumn("place", F.row_number().over(own)).join(shelves, F.col("source").eqNullSafe(F.col("s")) & (F.col("shelf") == F.col("f")))
    docs = docs.withColumn("start", F.col("base") + F.col("inside")).select("doc", "version", "source", "shelf", "place", "size", "source_size", "target", "blocks", "start")

    # the schedule: point, source, rank within the source, block
    total, n = sums.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    until = F.sum("quota").over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    share = sums.select("source", "blocks", "quota", until.alias("until")).where("quota > 0").withColumn("from", F.col("until") - F.col("quota"))
    cells = max(1, total // CHUNK)
    slots = df.sparkSession.range(0, total).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    below = slots.groupBy("cell").agg(F.count("*").alias("n"))
    below = below.select(F.col("cell").alias("c"), F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    # the place of each point among all in order; bins of places, each with a few sources only
    slots = slots.withColumn("in_cell", F.row_number().over(Window.partitionBy("cell").orderBy("u", "slot")) - 1).join(F.broadcast(below), F.col("cell") == F.col("c"))
    width = max(1, total // max(1, 4 * n))
    slots = slots.select("slot", (F.col("below") + F.col("in_cell")).alias("point")).withColumn("bin", F.floor(F.col("point") / width))
    share = share.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("until") - 1) / width))))
    slots = slots.join(share, "bin").where("from <= point AND point < until")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK)).select("slot", "chunk", "source", "blocks")
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    slots = slots.withColumn("within", within).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    rank = F.col("base") + F.col("within")
    slots = slots.select("slot", "source", rank.alias("rank"), F.pmod(rank, F.col("blocks")).alias("block"))
    return docs, slots


def _div(a: Column, b: str) -> Column:
    """Whole part of a / b, exact: decimals of 38 digits."""
    return F.call_function("div", a, F.col(b).cast("decimal(20,0)"))


def _start_of(b: Column) -> Column:
    """First word of block b: b * source_size / blocks, rounded down."""
    return _div(b.cast("decimal(18,0)") * F.col("source_size").cast("decimal(18,0)"), "blocks")


def _block_of(word: Column) -> Column:
    """The block that a word of the stream is in."""
    return _div((word + 1).cast("decimal(18,0)") * F.col("blocks").cast("decimal(18,0)") - 1, "source_size")


def _point(i: Column) -> Column:
    """frac(i * phi), exact to some 1e-10 for any slot: high and low part apart."""
    low, high = F.pmod(i, F.lit(1 << 20)), F.floor(i / (1 << 20))
    step = math.fmod((1 << 20) * PHI, 1.0)
    return F.pmod(F.pmod(low * PHI, F.lit(1.0)) + F.pmod(high * step, F.lit(1.0)), F.lit(1.0))


def schedule(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = 64, seed: int = 7) -> DataFrame:
    """(slot, source, rank, block): which block of which source stands where in the mix."""
    return _mix(df, text, doc_id, source, weights, most, block, seed)[1]


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = 64, seed: int = 7) -> DataFrame:
    """(doc, version, source, size, source_size, target, taken) of each row; version is the text's hash.

    The size of a text is its number of words; a null or empty text has none and is never taken. Null is a source
    of its own. Texts of any length are counted whole. Rows may repeat: each has a place in its source's stream. `taken` counts the words in the slots'
    blocks, repeats included. An empty table gives an empty result. Other columns are not read.
    """
    docs, slots = _mix(df, text, doc_id, source, weights, most, block, seed)
    times = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    times = times.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    pieces = docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(_block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1)))))
    pieces = pieces.join(times, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    share = F.least(F.col("start") + F.col("size"), _start_of(F.col("block") + 1)) - F.greatest(F.col("start"), _start_of(F.col("block")))
    return pieces.groupBy("source", "shelf", "place").agg(F.first("doc").alias("doc"), F.first("version").alias("version"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.coalesce(share * F.col("times"), F.lit(0))).alias("taken")).select("doc", "version", "source", "size", "source_size", "target", "taken")
