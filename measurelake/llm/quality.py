"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

cos(W x + b) with Gaussian W approximates a Gaussian kernel over the standardised statistics, so one linear ridge
fit stands for a kernel machine. Each partition sums its share of the normal equations; the driver adds a bounded
number of such sums and solves. Pool-adjacent-violators turns the scores of rows held back into probabilities.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import materialize, release, slices, unused

#: Labelled rows that a model is fitted on, at most (in expectation); chosen by hash of the document's id.
SAMPLE = 24_000
#: Partial sums of the normal equations that the driver adds.
PARTS = 16
FEATURES = 256
#: Rows whose statistics are held at a time.
BLOCK = 256
SEED = 11
NAMES = ("log_words", "word_length", "symbols", "capitals", "marks", "digits", "stops", "distinct", "stutter", "trigrams", "log_lines", "same_lines", "line_words")


def statistics(text: str | None) -> tuple[float, ...]:
    """Statistics NAMES of a whole text; all 0 without words."""
    text = text or ""
    w = text.split()
    n = len(w)
    if not n:
        return (0.0,) * len(NAMES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = sum(map(len, w))
    count = text.count
    return (
        math.log1p(n),
        letters / n,
        sum(map(count, "#*$%&|<>")) / letters,
        sum(map(str.isupper, w)) / n,
        (count("!") + count("?")) / n,
        sum(map(count, "0123456789")) / letters,
        (count(".") + count(",")) / n,
        len(set(w)) / n,
        sum(map(operator.eq, w, islice(w, 1, None))) / n,
        len(set(zip(w, islice(w, 1, None), islice(w, 2, None)))) / max(1, n - 2),
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Calibration: scores and probabilities, both rising.
    scores: np.ndarray
    chances: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores, in padded blocks of one shape and rounded, so that a row's doesn't depend on its neighbours."""
        out = np.empty(len(stats))
        for at in range(0, len(stats), BLOCK):
            block = np.zeros((BLOCK, stats.shape[1]))
            part = stats[at : at + BLOCK]
            block[: len(part)] = part
            out[at : at + BLOCK] = (fourier((block - self.mean) / self.scale) @ self.weights)[: len(part)]
        return out.round(10)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.scores, self.chances)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics (clipped at 8 deviations), and a constant."""
    draw = np.random.default_rng(SEED)
    w = draw.normal(size=(x.shape[1], FEATURES)) / math.sqrt(x.shape[1])
    z = np.cos(np.clip(x, -8, 8) @ w + draw.uniform(0, 2 * math.pi, FEATURES)) * math.sqrt(2 / FEATURES)
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; equal scores count as one. Half a row of each label is added to every pool."""
    xs, at = np.unique(scores, return_inverse=True)
    total, good = np.bincount(at).astype(float), np.bincount(at, labels)
    pools: list[list[float]] = []
    for x, t, g in zip(xs, total, good, strict=True):
        pools.append([x, x, t, g])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, high, t1, g1 = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + t1, pools[-1][3] + g1]
    x, y = [], []
    for low, high, t, g in pools:
        x += [low, high]
        y += [(g + 0.5) / (t + 1)] * 2
    return np.array(x), np.maximum.accumulate(np.array(y))


def _statistics_of(df: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "stats array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, BLOCK):
            stats = pa.array([statistics(x.as_py()) for x in batch.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), stats], [*keep, "stats"])

    return df.select(*keep, text).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model | None:
    """A model of the rows of `df` that `labels` (doc_id, label 0 or 1; nulls are passed over) covers.

    Reads about SAMPLE labelled rows, chosen by a hash of doc_id; None if there is none. Of labels that differ for one
    doc_id the least counts.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y")).groupBy("__id").agg(F.min("__y").alias("__y"))
    n = known.count()
    grain = 1 << 30
    cut = grain if n <= SAMPLE else math.ceil(grain * SAMPLE / n)
    chosen = lambda c: F.pmod(F.xxhash64(F.lit(SEED), c), F.lit(grain)) < cut
    rows = _statistics_of(df.where(chosen(F.col(doc_id))).select(F.col(doc_id).alias("__id"), text), ("__id",), text)
    rows = materialize(rows.join(known.where(chosen(F.col("__id"))), "__id").select("stats", "__y", (F.pmod(F.xxhash64(F.lit(SEED + 1), "__id"), F.lit(4)) == 0).alias("held")), "labelled")
    at = [F.col("stats")[i] for i in range(len(NAMES))]
    moments = rows.agg(F.count("*"), *map(F.mean, at), *map(F.stddev_pop, at)).first()
    if not moments[0]:
        return None
    mean = np.array(moments[1 : 1 + len(NAMES)], float)
    scale = np.array(moments[1 + len(NAMES) :], float)
    scale[scale < 1e-9] = 1.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = fourier((_matrix(batch.column(0)) - mean) / scale)
            a += z.T @ z
            b += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([a, b]).tobytes()], pa.binary())], ["sums"])

    total = sum((np.frombuffer(r[0]).reshape(FEATURES + 2, -1) for r in rows.where("NOT held").select("stats", "__y").coalesce(PARTS).mapInArrow(sums, "sums binary").collect()), np.zeros((FEATURES + 2, FEATURES + 1)))
    a, b = total[:-1], total[-1]
    ridge = 1e-4 * max(1.0, a[-1, -1]) * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-6
    model = Model(mean, scale, np.linalg.solve(a + ridge, b), np.zeros(1), np.zeros(1))
    held = rows.where("held").select("stats", "__y").toArrow()  # a quarter of the bounded sample
    if not held.num_rows:
        return Model(mean, scale, model.weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    x, y = isotonic(model.raw(_matrix(held.column(0).combine_chunks())), held.column(1).to_numpy())
    return Model(mean, scale, model.weights, x, y)


def score(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns `keep` and the score in [0, 1] of each whole text; map only.

    Null and empty texts are scored by statistics that are all 0; texts of any length are read whole. Without a model
    every score is 0.5. Rows that repeat have equal scores; an empty table gives an empty result; columns that aren't
    kept are not read. A text that is kept goes to Python once.
    """
    keep = tuple(keep)
    at = keep.index(text) if text in keep else len(keep)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, BLOCK):
            stats = np.array([statistics(x.as_py()) for x in batch.column(at)], float).reshape(-1, len(NAMES))
            values = np.full(len(stats), 0.5) if model is None else model.score(stats)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(values, pa.float64())], [*keep, name])

    return df.select(*keep, *(() if text in keep else (F.col(text).alias(unused(df, "__text")),))).mapInArrow(run, schema)
