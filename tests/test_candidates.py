"""Tokens, roles and ranking of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelake.operators import candidates as C

TOKENS = {"5 kg": ["5", " ", "kg"], "10-15 min": ["10", "-", "15", " ", "min"], "156 out of 180": ["156", " ", "out of", " ", "180"], "at least 3 m": ["at least", " ", "3", " ", "m"], "12.5 ± 3.7 %": ["12.5", " ", "± 3.7", " ", "%"], "2kg": ["2", "kg"], "m": ["m"]}
READ = {"5 kg": ("nsu", "single_quantity", 1), "10-15 min": ("nrnsu", "range", 2), "1 to 2 m": ("nsrsnsu", "range", 2), "3 m, 4 m and 5 m": (None, "list", 3), "156 out of 180": ("nsqsn", "ratio", 2), "1 x 2 x 3 mm": (None, "multidim", 3), "at least 3 m": ("msnsu", "single_quantity", 1), "12.5 ± 3.7 %": ("nsesu", "single_quantity", 1), "-5 kg": ("mnsu", "single_quantity", 1)}


def test_tokens_and_readings(spark):
    texts = [*{*TOKENS, *READ}, "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = C.interpret(rows, F.col("t"), "x").select("t", C.tokens(F.col("t")).alias("tokens"), "x").collect()
    got = {r.t: r for r in rows}
    assert {t: list(got[t].tokens) for t in TOKENS} == TOKENS and all("".join(r.tokens) == r.t for r in rows if r.t)
    wrong = {t: got[t].x for t, (roles, kind, n) in READ.items() if got[t].x is None or (got[t].x.type, got[t].x.quantities) != (kind, n) or roles and got[t].x.roles != roles}
    assert not wrong
    assert got[None].x is None


def test_rules(spark):
    pick = lambda tokens, every: C.ranked(spark.createDataFrame([(tokens, every)], "t array<string>, e array<string>"), "t", "e", "r").first().r
    assert pick(["5", "-", "9"], ["nmn", "nrn"]) == "nrn"  # whole segments first
    assert pick(["5", "m", "-", "2"], ["nurn", "nuuu"]) == "nuuu"  # a unit before, a bare small number behind
    assert pick(["9", "to", "5"], ["nrn", "nln"]) == "nln"  # a range that falls
    assert pick(["1", "x", "2", "x", "3"], ["nxnun", "nxnxn"]) == "nxnxn"  # three dimensions
    assert pick(["1", "of", "2"], ["nqn"]) == "nqn"
    options = F.array(*[F.array(F.lit("n"), F.lit("u"))] * 13)
    assert spark.range(1).select(C.readings(options)).first()[0] is None
    assert spark.range(1).select(C.readings(F.array(F.array(F.lit("n")), F.array(F.lit("q"), F.lit("u")), F.array(F.lit("n"))))).first()[0] == ["nqn"]
