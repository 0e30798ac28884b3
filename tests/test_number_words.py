"""Number words of all customers, round tens included."""

from __future__ import annotations

from measurelake import catalogue

DATA = "/root/testdata/sf0.001"


def test_every_customer(spark) -> None:
    want = {r.c_custkey: float(r.c_custkey % 79 + 21) for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    got = {r.c_custkey: r.number for r in catalogue.QUERIES["number_words"](spark, DATA).collect()}
    assert got == want and {*range(30, 100, 10)} <= {*got.values()}
