"""Pairs by the deepest shared prefix, in groups of any size."""

from __future__ import annotations

from measurelake.llm import preference


def frame(spark, convs: dict[int, list[str]]):
    rows = [(i, k, "system" if k == 0 else "user" if k % 2 else "assistant", t) for i, own in convs.items() for k, t in enumerate(own)]
    return preference.conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))


def common(a: list[str], b: list[str]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_siblings_meet_in_a_large_group(spark) -> None:
    # 1,000 prompts of one system turn; the two answers to each are far apart by conv_id
    convs = {i + 5000 * j: ["s", f"q{i}", f"answer {j}"] for i in range(1000) for j in range(2)}
    convs |= {20000 + i: ["s", f"alone {i}", "a"] for i in range(701)}
    out = preference.pairs(frame(spark, convs)).collect()
    assert sorted(x for r in out for x in (r.chosen_id, r.rejected_id) if x is not None) == sorted(convs)
    depth = [common(convs[r.chosen_id], convs[r.rejected_id]) for r in out if r.rejected_id is not None]
    assert depth.count(2) == 1000 and depth.count(1) == 350
    assert sum(r.rejected_id is None for r in out) == 1


def test_odd_ones_go_up_and_copies_wait(spark) -> None:
    convs = {1: ["s", "p", "x", "y", "1"], 2: ["s", "p", "x", "y", "2"], 3: ["s", "p", "x", "y", "3"], 4: ["s", "p", "z"], 5: ["s", "r"], 6: ["s", "t"]}
    convs |= {11: ["c", "d", "e"], 12: ["c", "d", "e"], 13: ["c", "d", "f"], 14: ["c", "d", "f"], 21: ["w"], 22: ["w"], 31: ["one"]}
    out = preference.pairs(frame(spark, convs)).collect()
    found = {r.pair_id: {r.chosen_id, r.rejected_id} for r in out}
    depth = sorted(common(convs[a], convs[b]) for a, b in (p for p in found.values() if None not in p))
    assert depth == [1, 1, 2, 2, 2, 4] and {5, 6} in found.values() and {21, 22} in found.values()
    assert found[31] == {31, None} and {frozenset(found[k]) for k in (11, 12)} == {frozenset({11, 13}), frozenset({12, 14})}
    assert all(k == min(x for x in p if x is not None) for k, p in found.items())
