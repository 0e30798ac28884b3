"""The stages of the pipeline, each against a plain version on the stage's own input."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from measurelake.llm import mixing, quality
from tests.llm.test_contract import brute_bpe, brute_components, read, words
from tests.llm.test_linededup import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage, as pandas."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = []
    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(f(spark, docs, DATA), name)
        out.append((name, before.toPandas(), docs.toPandas(), before))
    return out


def key(df: pd.DataFrame) -> list[tuple]:
    return sorted(zip(df.doc_id, df.text.fillna("")))


def test_classify(spark, stages):
    _, before, after, df = stages[0]
    assert list(after.columns) == list(before.columns)
    model = quality.fit(df, spark.read.parquet(f"{DATA}/labels.parquet"))
    stats = np.array([quality.statistics(t) for t in before.text], float)
    score = [np.interp(quality.fourier(((x - model.mean) / model.scale)[None]) @ model.weights, model.scores, model.chances)[0] for x in stats]  # one text at a time
    kept = before[np.array(score) >= corpus_pipeline.LEAST_SCORE]
    assert key(after) == key(kept)
    known = read("labels").merge(before[["doc_id"]], on="doc_id")
    good, bad = (set(known.doc_id[known.quality == q]) for q in (1, 0))
    assert len(good & set(after.doc_id)) >= 0.95 * len(good) and len(bad & set(after.doc_id)) <= 0.5 * len(bad)


def test_dedup_lines(stages):
    _, before, after, _ = stages[1]
    want = [(d, t) for d, t in brute([(int(d), t) for d, t in zip(before.doc_id, before.text)], 50)]
    was = dict(zip(before.doc_id, before.text))
    want = sorted((d, t or "") for d, t in want if t == was[d] or words(t))
    assert key(after) == want and (after.n_chars == after.text.str.len()).all()


def test_dedup_near(stages):
    _, before, after, _ = stages[2]
    component = {d: c for d, (_, c) in brute_components(before, 5, 80).items()}
    assert key(after) == key(before[[component[d] == d for d in before.doc_id]])


def test_mix(stages):
    _, before, after, df = stages[3]
    taken = mixing.mix(df).toPandas()
    copies = {r.doc: round(r.taken / r.size) for r in taken.itertuples() if r.size and 2 * r.taken >= r.size}
    assert after.doc_id.value_counts().to_dict() == {d: n for d, n in copies.items() if n}
    assert max(copies.values()) <= 3 and set(map(tuple, after[["doc_id", "text"]].values)) <= set(map(tuple, before[["doc_id", "text"]].values))


def test_encode(stages):
    _, before, after, _ = stages[4]
    want = brute_bpe(before)
    assert len(after) == len(before) and all(want[r.doc_id] == (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.itertuples())


def test_nulls_and_empty_table(spark):
    names = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id " * 20, "en", "a", 120), (3, "a word " * 30, None, None, 210), (3, "a word " * 30, None, None, 210)]
    for table in (spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], names + ", __score int, __place int, __copies int, version int"), spark.createDataFrame([], names)):
        docs = table
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(f(spark, docs, DATA), "edge")
            assert docs.columns == table.columns
        assert corpus_pipeline.encode(spark, docs, DATA).count() == docs.count()
