"""Learned partitions at production parameters on a table of more than SAMPLE rows, where most probes leave parts out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from measurelake.llm import annpart

N, WIDTH, K = 20000, 64, 5


def vectors(clustered: bool) -> np.ndarray:
    draw = np.random.default_rng(11)
    flat = draw.normal(size=(N, WIDTH))
    return draw.normal(size=(400, WIDTH))[draw.integers(0, 400, N)] + 0.5 * flat if clustered else flat


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_pruned_search(spark, tmp_path, clustered: bool) -> None:
    m = vectors(clustered)
    pq.write_table(pa.table({"vec_id": np.arange(N), "embedding": list(m)}), tmp_path / "embeddings.parquet", row_group_size=2500)
    rows = annpart.search(spark.read.parquet(str(tmp_path / "embeddings.parquet")), F.col("vec_id") % 100 == 0, K).collect()
    got: dict[int, set[int]] = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q in range(0, N, 100):
        s = m @ m[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:K].tolist()))
    recall = hits / (K * N // 100)
    print("recall", recall, "clustered" if clustered else "unclustered")
    assert recall >= 0.9


def test_few_probes_on_clustered_vectors() -> None:
    m = vectors(True)[: annpart.SAMPLE]
    model = annpart.fit(m, 128)
    assert len(model.bias) == 128 and model.probes <= 16


def test_lengths_edges_and_ties(spark) -> None:
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    rows += [(20, [1.0, 0.0, 0.0]), (21, [1.0, 1.0, 0.0]), (22, [5.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, part int, v int")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in annpart.search(df, F.lit(True), 2).collect()}
    assert got == {
        (1, 1): (2, 1.0), (1, 2): (3, 1.0), (2, 1): (1, 1.0), (2, 2): (3, 1.0), (3, 1): (1, 1.0), (3, 2): (2, 1.0),
        (4, 1): (1, 0.0), (4, 2): (2, 0.0), (20, 1): (21, 0.707107), (21, 1): (20, 0.707107),
    }
    assert annpart.search(df.where("false"), F.lit(True), 2).count() == 0
