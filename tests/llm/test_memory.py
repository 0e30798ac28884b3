"""What goes to Python workers, and what they keep there from one operator to the next."""

from __future__ import annotations

import random
import tracemalloc
import weakref

import public_tokenizers
import pytest

from measurelake.llm import bpe, jaccard, quality

SCHEMA = "doc_id long, text string, lang string"
ROWS = [(1, "some words here", "en"), (2, None, None), (3, "", "fr")]


def test_kept_text_goes_to_python_once(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for keep, columns in ((("lang", "text", "doc_id"), 3), (("doc_id",), 2)):
        assert quality.score(df, None, keep=keep)._jdf.queryExecution().analyzed().children().head().output().size() == columns
    model = quality.fit(df, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int"))
    rows = sorted(tuple(r) for r in quality.score(df, model, keep=("lang", "text", "doc_id")).select("doc_id", "text", "lang").collect())
    assert rows == ROWS
    scores = [dict(quality.score(df, model, keep=k).select("doc_id", "score").collect()) for k in (("lang", "text", "doc_id"), ("doc_id",))]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("operator", [lambda df: quality.score(df, None), lambda df: jaccard._sketched(df, "text", "doc_id", 5, (80, 100), 8)])
def test_workers_drop_the_codec_for_another_operator(spark, monkeypatch, operator):
    df, sent = spark.createDataFrame(ROWS, SCHEMA), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: sent.append(f) or self)
    operator(df)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.codec_of(ranks, bpe.PATTERN)
    assert bpe.codec_of(ranks, bpe.PATTERN) is codec and codec.decode(codec.encode("some text")) == b"some text"
    gone = weakref.ref(codec)
    del codec
    assert gone()
    assert list(sent[0](iter(()))) == []
    assert not gone()


def test_codec_holds_little_for_each_arc_and_no_piece_met_once():
    codec = bpe.Codec(bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))))
    draw = random.Random(3)
    pieces = [" " + "".join(draw.choices(["th", "en", "sch", "ó", "q", "ing", "re", "x"], k=5)) for _ in range(4000)]
    tracemalloc.start()
    for piece in pieces:
        codec.transducer.encode(piece.encode())
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(codec.transducer.arcs) > 3_000 and used < 300 * len(codec.transducer.arcs)
    codec.encode(" qxqxth")
    assert " qxqxth" not in codec.pieces
    assert codec.encode(" qxqxth") == codec.transducer.encode(b" qxqxth") and " qxqxth" in codec.pieces
