"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from measurelake.llm import bpe, common, jaccard, langcrf, mixing, preference, quality, rules, urlrules

LONG = " ".join(f"w{i % 977} v{i % 1009}" for i in range(60_000))  # some 600,000 characters
TEXTS = [(1, "the cat sat on the mat today"), (2, None), (3, ""), (4, LONG), (5, "the cat sat on the mat today"), (5, "the cat sat on the mat today"), (None, "no id at all here"), (6, "\n \t\n"), (7, "ünïcödé 日本 🙂"), (8, "THE cat sat on the mat today")]
#: Names that operators use inside.
CLASHES = ["__id", "__text", "__doc", "__version", "__score", "__label", "size", "doc", "n", "rep", "component", "part", "tokens"]
SCHEMA = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` int" for c in CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None if i % 3 == 0 else f"s{i % 2}", "en" if i % 2 else None, *range(len(CLASHES))) for i, r in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_bpe(docs, empty):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    run = lambda df: bpe.encode_documents(df, ranks, keep=tuple(df.columns), outputs=("n_tokens", "decoded", "decoded_sha256")).collect()
    out = run(docs)
    assert sorted((str(r.doc_id), r.decoded, r.decoded_sha256) for r in out) == sorted((str(d), t or "", hashlib.sha256((t or "").encode()).hexdigest()) for d, t in TEXTS)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0} and run(empty) == []


def test_rules(docs, empty, labels):
    out = rules.apply_rules(docs, labels, keep=("doc_id", "__id", "n")).collect()
    assert len(out) == len(TEXTS) and all(r.base_failed and not r.kept for r in out if r.doc_id in (2, 3, 6))
    assert rules.apply_rules(empty, labels).count() == 0
    assert all(r.kept == (not r.base_failed) for r in rules.apply_rules(docs, labels.where("false")).collect())


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.taken <= 3 * r.size for r in out) and all(r.taken == 0 for r in out if r.doc in (2, 3, 6))
    assert mixing.mix(empty).count() == 0


def test_jaccard(docs, empty):
    out = {(r.doc, r.n, r.component) for r in jaccard.link(docs).collect()}
    w = LONG.split()
    long = len(set(zip(w, w[1:], w[2:], w[3:])))
    assert out == {(1, 4, 1), (2, 0, 2), (3, 0, 3), (4, long, 4), (5, 4, 1), (None, 2, None), (6, 0, 6), (7, 1, 7), (8, 4, 1)}
    assert jaccard.link(empty).count() == 0


def test_jaccard_texts_of_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(9, a), (9, b), (3, b + " x"), (5, a + " y"), (4, "none of it")]
    out = {(r.doc, r.component) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(9, 3), (3, 3), (5, 3), (4, 4)}


def test_jaccard_reads_texts_of_pairs_within_the_bound_only(spark, monkeypatch):
    draw, rows = random.Random(4), {}
    made = lambda k: [f"w{draw.randrange(10**9)}" for _ in range(k)]
    shared, text = made(400), made(500)
    texts = [shared + made(100), shared + made(100), text, text[:495] + made(5)]  # the first two meet, and can't link

    def counted(df, tag, *codec):
        out = common.materialize(df, tag, *codec)
        rows.setdefault(tag, out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    monkeypatch.setattr(jaccard, "_bucket_counts", lambda _: np.zeros(jaccard.BUCKETS, np.int64))  # else shared signatures come last
    got = {r.doc: r.component for r in jaccard.link(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}
    assert rows["members"] >= 4 and rows["sets"] == 2


def test_count_vectors_bound_the_overlap_in_two_bits_a_shingle():
    draw = np.random.default_rng(5)
    for n in (1, 5, 16, 17, 64, 500, 3000, 8192, 9000):
        level = jaccard._level(n)
        for k in (0, 1):
            a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
            for common_ in (0, n // 2, n):
                b = np.unique(np.append(a[:common_], draw.integers(0, 2**63, n - common_, dtype=np.uint64)))
                (x, more_x), (y, more_y) = (jaccard.count_vector(s, level + k) for s in (a, b))
                assert len(x) % 8 == 0 and (n > 2048 or 8 * len(x) <= max(64, 4 * n * (1 + k)))
                bound = int(np.bitwise_count(np.frombuffer(x, np.uint8) & np.frombuffer(y, np.uint8)).sum()) + min(more_x, more_y)
                assert bound >= common_ and (common_ or n < 64 or bound < 0.85 * n)


def test_jaccard_planted_groups(spark, monkeypatch):
    """A hot passage, exact copies and near copies of all degrees, in blocks of a few; against all pairs."""
    import random

    from tests.llm.test_contract import brute_components

    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    draw = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    hot = [f"h{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(400)}"
        texts.append(own)
    texts += [hot + [f"t{i}u{k}" for k in range(draw.randint(8, 30))] for i in range(120)] + [list(base)] * 40
    import pandas as pd

    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_components(pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r.doc: (r.n, r.component) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) > 100


def test_urls(spark, labels):
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 100_000, 1), (2, None, 2), (3, "", 3), (4, "HTTP://EXAMPLE.com/en/?q", 4), (4, "HTTP://EXAMPLE.com/en/?q", 4), (5, "://", 5), (None, "http://b.net/es/", 6)], "page_id long, url string, __tokens int")
    mined = urlrules.mine(pages, labels)
    out = urlrules.judge(pages, mined, [("allow", "com/"), ("block", "example.com/en/")], keep=("page_id", "__tokens")).collect()
    assert mined == [] and sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in out) == sorted([("1", "a.com", "com/", "allow"), ("2", "", None, "allow"), ("3", "", None, "allow"), *[("4", "example.com", "example.com/en/", "block")] * 2, ("5", "", None, "allow"), ("None", "b.net", None, "allow")])
    assert urlrules.judge(pages.where("false"), mined, []).count() == 0 and urlrules.mine(pages.where("false"), labels) == []


def test_quality(docs, empty, labels):
    model = quality.fit(docs, labels)
    out = quality.score(docs, model, keep=("doc_id", "__text", "__id")).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 5)}) == 1 and len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    none = quality.fit(docs, labels.where("false"))
    assert none is None and {r.score for r in quality.score(docs, none).collect()} == {0.5} and quality.score(empty, model).count() == 0
    again = quality.score(docs.repartition(1), model, keep=("doc_id",)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in out}


def test_language(docs, empty):
    model = langcrf.fit(docs)
    out = langcrf.predict(docs, model, keep=("doc_id", "__text")).collect()
    assert len(out) == len(TEXTS) and {r.lang_pred for r in out if r.doc_id in (2, 3, 6)} == {"und"} and {r.lang_pred for r in out if r.doc_id in (1, 4, 5)} == {"en"}
    assert langcrf.fit(empty) is None and {(r.lang_pred, r.score) for r in langcrf.predict(docs, None).collect()} == {("und", 0.0)} and langcrf.predict(empty, model).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x " * 50_000), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 1, "assistant", "yo"), (3, None, None, None), (None, 0, "user", "lost"), (4, 0, "user", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, pair int, path int")
    out = {r.pair_id: r for r in preference.format_pairs(preference.pairs(preference.conversations(df))).collect()}
    assert set(out) == {1, 3, 4} and (out[1].chosen_id, out[1].rejected_id, out[1].n_common) == (1, 2, 1) and out[3].rejected_id is None
    for r in out.values():
        for side in ("chosen", "rejected"):
            assert "".join(s.text for s in r[f"{side}_segments"]) == r[f"{side}_completion"]
        assert r.prompt + r.chosen_completion == "".join(f"<|im_start|>{t.role}\n{t.text}<|im_end|>\n" for t in r.chosen)
    assert preference.pairs(preference.conversations(df.where("false"))).count() == 0


def test_folder_for_tests_only(spark):
    assert common.shared_dir(spark)
    df = common.materialize(spark.range(3).select(F.col("id")), "x")
    assert df.count() == 3
    common.discard(df)
