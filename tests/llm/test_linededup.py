"""Line dedup against a quadratic search over all pairs of places."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from measurelake.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(rows: list[tuple], least: int) -> list[tuple]:
    """Texts without the lines of every stretch of `least` words or more, made of whole lines, that stands earlier.

    All pairs of places are compared; a common stretch is grown line by line from each pair.
    """
    docs = []
    for row in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        lines = row[1].split("\n")
        docs.append((row, lines, [i for i, x in enumerate(lines) if WORD.search(x)]))
    gone: dict[tuple, set] = {}
    for b, (row, lines, own) in enumerate(docs):
        gone[row] = set()
        for a in range(b + 1):
            other, theirs = docs[a][1:]
            places: dict[str, list[int]] = {}
            for j, at in enumerate(theirs):
                places.setdefault(other[at], []).append(j)
            for i in range(len(own)):
                for j in (j for j in places.get(lines[own[i]], ()) if a < b or j < i):  # others share no line
                    k = n = 0
                    while i + k < len(own) and j + k < len(theirs) and lines[own[i + k]] == other[theirs[j + k]]:
                        n += len(WORD.findall(lines[own[i + k]]))
                        k += 1
                    if n >= least:
                        gone[row].update(range(own[i], own[i + k - 1] + 1))
    return sorted(((r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone.get(r, ()))) if r in gone else r for r in rows), key=str)


def run(spark, rows: list[tuple], least: int) -> list[tuple]:
    out = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_words=least)
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_planted_runs(spark, seed):
    draw = random.Random(seed)
    common = [" ".join(f"c{i}{k}" for k in range(draw.randint(1, 6))) for i in range(6)]
    passages = [[" ".join(f"p{i}x{j}y{k}" for k in range(draw.randint(1, 7))) for j in range(6)] for i in range(4)]
    rows = []
    for d in range(25):
        lines: list[str] = []
        for _ in range(draw.randint(0, 5)):
            at = draw.randint(0, 3)
            lines += draw.choice([[draw.choice(common)], passages[draw.randrange(4)][at:], passages[draw.randrange(4)][: at + 2], [f"own {d} {draw.random()}"], ["", " "]])
        rows.append((d, "\n".join(lines)))
    assert run(spark, rows, 8) == brute(rows, 8)


def test_edges(spark):
    long = "\n".join(f"line {i} of a very long text" for i in range(3000))
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "a b c\nd e f"), (3, "a b c\nd e f"), (4, "x\na b c\n\nd e f\ny"), (5, "a b c"), (6, "one\tword"), (7, long), (8, "start\n" + long)]
    out = run(spark, rows, 6)
    assert (3, "a b c\nd e f") in out and (4, "x\ny") in out and (8, "start") in out and (5, "a b c") in out and (7, long) in out
    assert out == brute(rows[:8], 6)[:0] + sorted([*brute(rows[:8], 6), (7, long), (8, "start")], key=str)


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 2, 3, 4), (2, "a b c d", 5, 6, 7, 8)], "doc_id long, text string, __doc int, __version int, __spans int, h int")
    out = linededup.dedup_lines(df, min_words=3).orderBy("doc_id").collect()
    assert [(r.text, r["__doc"], r["__version"], r["__spans"], r.h) for r in out] == [("a b c d", 1, 2, 3, 4), ("", 5, 6, 7, 8)]
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).where(F.lit(True)).count() == 0
