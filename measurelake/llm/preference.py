"""Preference formatting: the shared turns of a chosen and a rejected conversation once, and what follows of each.

Conversations become arrays of turns; pairs are compared in array functions. The prompt is the longest common
prefix of turns, rendered once; each completion is the turns behind it, as text and as spans of that text with a
mask that is true where loss is counted: what an assistant says, and the mark that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import materialize

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Conversations of one shared prefix that are paired in one window; larger groups are cut to such parts by hash first.
PART = 512


def conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in the order of `turn`, then role, then text.

    Null roles and texts count as empty; rows without conv_id are passed over; a null turn stands first. Rows that
    repeat whole count once; turns of any length are kept whole; an empty table has no conversations. Other columns are
    not read.
    """
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    turns = F.array_sort(F.collect_set("t"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def pairs(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, rejected) of conversations that begin with the same turn.

    Conversations are paired by the deepest prefix of turns they share: the longest prefixes first; one that is odd
    goes on to the next shorter prefix that it shares with others, so that of a first turn one at most stays alone.
    Copies, which differ in nothing, are left for a prefix that others share too; where there is none, they are
    paired with each other. Of a pair the one with more words by assistants is chosen, in a tie the smaller conv_id.
    A conversation that stays alone is chosen; rejected is a copy of it whose last turn by an assistant says again
    what the first such turn said, with a null rejected_id; no turns if there are no two such turns that differ.
    pair_id is the smaller conv_id of the pair.
    """
    said = F.aggregate(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(0), lambda a, t: a + F.size(F.array_remove(F.split(t["text"], r"[\x20\x09-\x0D]+"), "")))
    convs = materialize(convs.select("conv_id", "turns", said.alias("said")), "conversations")
    two = convs.join(_mates(convs), "conv_id", "left").groupBy(F.coalesce("pair", "conv_id").alias("pair_id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("said")).alias("less"), "conv_id", "turns"))).alias("two"))
    chosen, other = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    two = two.select("pair_id", chosen["conv_id"].alias("chosen_id"), other["conv_id"].alias("rejected_id"), chosen["turns"].alias("chosen"), other["turns"].alias("rejected"))
    return two.withColumn("rejected", F.coalesce("rejected", stale(F.col("chosen"))))


def _mates(convs: DataFrame) -> DataFrame:
    """(conv_id, pair) of conversations that have a partner; pair is the smaller conv_id of both."""
    none = F.array().cast("array<bigint>")
    chain = F.aggregate("turns", none, lambda a, t: F.array_append(a, F.xxhash64(F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("bigint")), a), -1), F.lit(0)), t["role"], t["text"])))
    heads = convs.select("conv_id", chain.alias("chain")).select("conv_id", F.element_at(F.concat(F.array(F.lit(0).cast("bigint")), "chain"), -1).alias("whole"), F.size("chain").alias("depth"), F.posexplode("chain").alias("at", "h"))
    heads = materialize(heads.select("conv_id", "whole", "at", "h", (F.col("at") + 1 == F.col("depth")).alias("ends")), "prefixes")
    shared = heads.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("ends").cast("long")).alias("whole_n")).where("n > 1")
    own = heads.join(shared, "h").groupBy("conv_id").agg(F.first("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("at", "h", "n", (F.col("n") == F.col("whole_n")).alias("copies")))).alias("path"))
    # prefixes at which conversations part; those of copies alone only if there is no other
    forks = F.filter("path", lambda x, i: F.coalesce(F.get("path", i + 1)["n"] != x["n"], F.lit(True)))
    own = own.withColumn("path", forks)
    own = own.withColumn("path", F.when(F.exists("path", lambda x: ~x["copies"]), F.filter("path", lambda x: ~x["copies"])).otherwise(F.col("path")))
    own = materialize(own, "paths")
    deepest, largest = own.agg(F.coalesce(F.max(F.size("path")), F.lit(0)), F.max(F.get("path", F.lit(0))["n"])).first()
    left, out = None, own.select("conv_id", F.col("conv_id").alias("pair")).limit(0)
    for level in range(deepest, 0, -1):  # few: only where conversations part
        here = own.where(F.size("path") == level)
        here = here if left is None else here.unionByName(left)
        node = F.get("path", F.lit(level - 1))
        parts = F.ceil(node["n"] / PART)
        for part in [F.pmod(F.xxhash64("conv_id"), parts), F.lit(0)] if largest > PART else [F.lit(0)]:
            made = materialize(_paired(here.withColumn("node", node["h"]).withColumn("part", part.cast("long"))), "paired")
            out = out.unionByName(made.where("pair IS NOT NULL").select("conv_id", "pair"))
            here = made.where("pair IS NULL").select("conv_id", "whole", "path")
        left = here
    return out


def _paired(rows: DataFrame) -> DataFrame:
    """(conv_id, whole, path, pair): pairs within node and part, with null for one of an odd number.

    In the order of what they say, each goes with the one half the group away: copies meet only if they are most of it.
    """
    own = Window.partitionBy("node", "part")
    rows = rows.withColumn("half", F.floor(F.count("*").over(own) / 2)).withColumn("k", F.row_number().over(own.orderBy("whole", "conv_id")) - 1)
    rows = rows.withColumn("k", F.when(F.col("k") < 2 * F.col("half"), F.col("k") % F.greatest("half", F.lit(1))))
    pair = F.when(F.col("k").isNotNull(), F.min("conv_id").over(Window.partitionBy("node", "part", "k")))
    return rows.select("conv_id", "whole", "path", pair.alias("pair"))


def stale(turns: Column) -> Column:
    """The conversation up to its last assistant's turn, which says what the first one said; no turns if that is no change."""
    places = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    first, last = F.array_min(places), F.array_max(places)
    none = F.array().cast("array<struct<role:string,text:string>>")
    again = F.concat(F.slice(turns, 1, last), F.slice(turns, first + 1, 1))
    return F.when(F.get(turns, first)["text"] != F.get(turns, last)["text"], again).otherwise(none)


def render(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def segments(turns: Column) -> Column:
    """Turns as array<struct<text, mask>>; the texts in order are the rendering, the mask marks what loss is counted on."""
    return F.flatten(F.transform(turns, lambda t: F.array(F.struct(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)).alias("text"), F.lit(False).alias("mask")), F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), (t["role"] == "assistant").alias("mask")))))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns; 0 if one is null."""
    short = F.least(F.size(F.coalesce(a, F.array().cast("array<struct<role:string,text:string>>"))), F.size(F.coalesce(b, F.array().cast("array<struct<role:string,text:string>>"))))
    alike = F.zip_with(F.slice(a, 1, short), F.slice(b, 1, short), lambda x, y: F.coalesce(x.eqNullSafe(y), F.lit(False)))
    first = F.array_position(alike, False)
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.when(first == 0, short).otherwise((first - 1).cast("int")))


def format_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`df` with n_common, prompt, chosen_completion, rejected_completion and their segments.

    Null or empty conversations render as no text. If one conversation is a prefix of the other, its completion is
    empty. Columns of these names that are there already are replaced.
    """
    a, b = F.col(chosen), F.col(rejected)
    n = F.col("n_common")
    out = df.withColumn("n_common", common_turns(a, b))
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    none = F.array().cast("array<struct<role:string,text:string>>")
    rest_a, rest_b = rest(F.coalesce(a, none)), rest(F.coalesce(b, none))
    return out.withColumns({"prompt": render(F.slice(F.coalesce(a, none), 1, n)), "chosen_completion": render(rest_a), "rejected_completion": render(rest_b), "chosen_segments": segments(rest_a), "rejected_segments": segments(rest_b)})
