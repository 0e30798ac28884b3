"""Targets and bounds of the mix for sources that are small, no multiple of a block, or at their bound."""

from __future__ import annotations

from measurelake.llm import mixing


def test_small_and_capped_sources(spark) -> None:
    sizes = {"a": [10], "b": [65], "c": [40] * 267, "d": [1000] * 200, "e": [1000] * 100}  # c: 10,680 words
    rows = [(f"{s}{i}", s, "w " * n) for s, own in sizes.items() for i, n in enumerate(own)]
    docs = spark.createDataFrame([*rows, ("none", "f", ""), ("null", None, None)], "doc_id string, source string, text string")
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows) + 2 and (out.taken <= 3 * out["size"]).all()
    by = out.groupby(out.source.fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    for s in "abc":  # at the bound, in whole
        assert by.target[s] == 3 * by["size"][s] == by.taken[s], by
    for s in "de":
        assert abs(by.taken[s] - by.target[s]) <= 64, by
    assert by.taken["f"] == by.taken["-"] == 0


def test_small_source_below_a_block(spark) -> None:
    rows = [(f"a{i}", "a", "w " * 2) for i in range(10)] + [(f"b{i}", "b", "w " * 1000) for i in range(30)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id string, source string, text string"), weights=(1.0, 3000.0)).toPandas()
    own = out[out.source == "a"]  # target 10 of 20 words
    assert abs(own.taken.sum() - own.target.iloc[0]) <= 1 and own.target.iloc[0] < 11, own


def test_slots_alternate(spark) -> None:
    rows = [(f"{s}{i}", s, "w " * 640) for s in "abc" for i in range(40)]
    slots = mixing.schedule(spark.createDataFrame(rows, "doc_id string, source string, text string")).toPandas().sort_values("slot")
    assert list(slots.slot) == list(range(1200))
    for s, share in zip("abc", (5 / 8, 2 / 8, 1 / 8)):
        own = slots.source == s
        assert abs(own.sum() - 1200 * share) <= 1
        assert ((own.cumsum() - share * (slots.slot + 1)).abs() <= 4).all()
        assert list(slots["rank"][own]) == list(range(own.sum()))
