"""Known inputs and outcomes of number, unit, modifier and quantity parsing."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from measurelake.functions import text as T
from measurelake.functions.numbers import plain_digits, str2num, value_and_magnitude
from measurelake.operators import unit_core
from measurelake.operators.modifiers import modifiers
from measurelake.operators.quantities import parse_quantities

U, P = "http://qudt.org/vocab/unit/", "http://qudt.org/PLACEHOLDER_"
NUMBERS = {
    "1,331.4": 1331.4, "0,351": 0.351, "2.7×10^6": 2.7e6, "1.23e-5": 1.23e-5, "two thirds": 2 / 3, "an eighth": 1 / 8, "one eighth": 1 / 8, "eighth": 8, "8th": 8, "one third": 1 / 3,
    "two third": 2 / 3, "12.3 million": 12.3e6, "one hundred and twenty three": 123, "fifty seven billion": 57e9, "seventy-eight": 78, "this is not a": None, "1.23": 1.23, "6.351": 6.351,
    "6.351.432": 6351432, "6,351": 6351, "6'351": 6351, "27": 27, "27.": 27, "27th": 27, "1/27": 1 / 27, "twenty-seven": 27, "": None, "a": 1, "- 10": -10, "2.6k": 2600, "2.6M": 2.6e6,
}
DIGITS = {"123": "123", "12.3": "12.3", "12,3": "12.3", "1,22,33": None, "1.22.33": None, "1,331.4": "1331.4", "1.234.567,890": "1234567.890", "0.234.567,890": None, "10.234.567,890": "10234567.890", "1,234.567": "1234.567", "10,000": "10000", "1 000 000": "1000000", ".5": ".5", "x": None, "1,": None, "": None, None: None}
APART = {"1.23×10^6": (1.23, 1e6), "1.23*10^6": (1.23, 1e6), "1.23 10^6": (1.23, 1e6), "1.23e-5": (1.23, 1e-5), "123e6": (123, 1e6), "10e6": (10, 1e6), "12.3 million": (12.3, 1e6), "fifty seven billion": (57, 1e9)}
SPANS = {
    "10-3": "10^-3", "10 15": "10^15", "10-15": "10-15", "10 -3": "10^-3", "10 3": "10^3", "103": "103", "8.75*10 -2 $/kW-h": "8.75*10^-2 $/kW-h", "1.0 * 107": "1.0 * 10^7", "1.0 * 1070": "1.0 * 10^70",
    "1.0 * 107000": "1.0 * 107000", "1.0 * 100": "1.0 * 100", "0. 0273 US$/kWh": "0.0273 US$/kWh", "> 0. 0 5": "> 0.05", "twofold": "two-fold", "%.": "%", "wt.%": "wt.%", "perc.": "perc.", "(5 m)": "5 m", "(5 m": "5 m", "5 m)": "5 m",
    "5 (m)": "5 (m)", "5.71(95% CI)": "5.71 (95% CI)", "6- 10%": "6 - 10%", "$.27/kWh": "$0.27/kWh", "$.27.21/kWh": "$.27.21/kWh", "5 and 6 respectively": "5 and 6", "5, and 6": "5 and 6", "3x4": "3 * 4", "2x3x4": "2 * 3 * 4", "10²³ m": "10^23 m",
    "5 +/- 2": "5 ± 2", ">= 3": "≥ 3", "1e5": "1*10^5", "2**3": "2^3",
}
UNITS = {"km.": ("km", "km"), "-hours": ("hours", "hours"), "kW·h": ("kW h", "kW·h"), "per year": ("/ year", "per year"), "∘ C": ("°C", "∘ C"), "mol%": ("mol %", "mol%"), "%:": ("%", "%:")}
QUANTITIES = [
    ("5 bpm", "single_quantity", [5], [U + "BEAT-PER-MIN"]), ("3 per mL", "single_quantity", [3], [U + "MilliL"]), ("4.6µm", "single_quantity", [4.6], [U + "MicroM"]), ("− 1", "single_quantity", [-1], None),
    ("60 ∘ C", "single_quantity", [60], [U + "DEG_C"]), ("4.1 m s −1", "single_quantity", [4.1], None), ("0.28–0.34 $/kWh", "range", [0.28, 0.34], None), ("5-to 10-year", "range", [5, 10], [U + "YR"] * 2),
    ("−0.6 to −1.2 V", "range", [-0.6, -1.2], None), ("50 and − 50%", "list", [50, -50], None), ("25 and 30 kilometers per hour (km/h)", "list", [25, 30], None), ("between 25 and 30 kilometers per hour (km/h)", "range", [25, 30], None),
    ("0,378$/kWh", "single_quantity", [0.378], None), ("< 0. 0 5", "single_quantity", [0.05], None), ("10²³ m", "single_quantity", [1e23], None), ("10-15 min", "range", [10, 15], None), ("1 of 2", "ratio", [1, 2], None), ("1:7.5", "ratio", [1, 7.5], None),
    ("156 out of 180", "ratio", [156, 180], None), ("Twenty-eight of 50", "ratio", [28, 50], None), ("100 mm x 100 mm x 400 mm", "multidim", [100, 100, 400], None), ("twofold", "single_quantity", [2], None), ("10 to 15 million", "range", [10e6, 15e6], None),
    ("9.23 wt.%", "single_quantity", [9.23], [P + "PERCENT_BY_MASS"]), ("about a third", "single_quantity", [1 / 3], None), ("a few hundred hours", "single_quantity", [None], None), ("minus 5%", "single_quantity", [5], [U + "PERCENT"]),
]
UNCERTAIN = [("2.98 (2.62-3.38)", 2.98, 2.62, 3.38, "unknown"), ("12.5 ± 3.7%", 12.5, -3.7, 3.7, "tolerance"), ("12.5% ± 3.7%", 12.5, -3.7, 3.7, "tolerance"), ("0.67 ± 0.18", 0.67, -0.18, 0.18, "tolerance"), ("$0.2109 ± 0.0321 kWh -1", 0.2109, -0.0321, 0.0321, "tolerance"), ("113 (± 1) nM", 113, -1, 1, "tolerance")]


def column(spark, values, f) -> dict:
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("t", f(F.col("t")).alias("x"))
    return {r.t: r.x for r in df.collect()}


def close(a, b) -> bool:
    return a is b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12)


def test_numbers(spark):
    got = column(spark, NUMBERS, str2num)
    assert not {k: (got[k], v) for k, v in NUMBERS.items() if not close(got[k], v)}
    assert column(spark, DIGITS, plain_digits) == DIGITS
    apart = column(spark, APART, lambda t: value_and_magnitude(F.lower(t)))
    assert not {k: (apart[k], v) for k, v in APART.items() if not (close(apart[k].value, v[0]) and close(apart[k].magnitude, v[1]))}


def test_spans(spark):
    got = column(spark, SPANS, T.normalize_quantity)
    assert not {k: (got[k], v) for k, v in SPANS.items() if got[k] != v}
    assert {k: tuple(v) for k, v in column(spark, UNITS, T.normalize_unit).items()} == UNITS


def test_predicates(spark):
    rows = {"a number at some point 1.23.": (True, True), "This text does not contain a number.": (False, False), "two or three numbers": (True, True), "a trillion numbers": (True, True), "a gazillion numbers": (False, True)}
    got = column(spark, rows, lambda t: F.array(T.contains_number(t), T.contains_number(t, imprecise=True)))
    assert {k: tuple(v) for k, v in got.items()} == rows
    assert column(spark, ["kilometer-per-hour", "km per hour", "hour", "km/h", "a "], T.is_compound_word_unit) == {"kilometer-per-hour": True, "km per hour": True, "hour": False, "km/h": False, "a ": False}
    assert column(spark, ["light-year", "km", "km2", "earth mass"], T.is_plain_word_unit) == {"light-year": True, "km": False, "km2": False, "earth mass": True}


def test_relative(spark):
    rows = [("it rose by 5 % then", 11, 14, True), ("by 5 %", 0, 6, True), ("it lay 5 % above the mean", 7, 10, True), ("it lay 5 % then", 7, 10, False), ("it rose by 5", 11, 11, False), ("it is 5 % higher than", 6, 21, True), (None, 0, 1, None)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, t string, a int, b int").select("i", T.is_relative(F.col("t"), F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == [r[3] for r in rows]


def test_quantities(spark):
    df = parse_quantities(spark.createDataFrame([(q[0],) for q in QUANTITIES], "t string"), F.col("t"), "r").collect()
    got, wrong = {r.t: r.r for r in df}, {}
    for text, kind, values, uris in QUANTITIES:
        r = got[text]
        found = [q["value"]["numeric_value"] for q in r["normalized_quantities"]]
        linked = [(q["suffixed_unit"]["normalized"] or [{"uri": None}])[0]["uri"] if q["suffixed_unit"] else None for q in r["normalized_quantities"]]
        if r["type"] != kind or len(found) != len(values) or not all(map(close, found, values)) or uris and linked != uris:
            wrong[text] = (r["type"], found, linked)
    assert not wrong


def test_no_quantities_and_modifiers(spark):
    texts = ["this is not a quantity", "J mol −1", "a", ".19.23/kWh", "About 30 mg", "minus 5%", "non-zero", None]
    got = {r.t: r.r for r in parse_quantities(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), "r").collect()}
    assert [got[t]["success"] for t in texts[:4]] == [False] * 4
    assert [got[t]["normalized_quantities"][0]["prefixed_modifier"]["normalized"] for t in ("About 30 mg", "minus 5%")] == ["~", "-"]
    assert got[None] is None


@pytest.mark.parametrize("row", UNCERTAIN, ids=lambda r: r[0])
def test_uncertainty(spark, row):
    text, center, low, high, kind = row
    q = parse_quantities(spark.createDataFrame([(text,)], "t string"), F.col("t"), "r").first().r["normalized_quantities"]
    assert len(q) == 1 and (q[0]["value"]["numeric_value"], q[0]["uncertainty"]["lb"], q[0]["uncertainty"]["ub"], q[0]["uncertainty"]["type"]) == (center, low, high, kind)


def test_text_modifiers(spark):
    rows = [("the temperature is approximately 25 °C, which is around 77 °F.", "25 °C", ["approximately"]), ("the temperature is approx. 25 °C, which is around 77 °F.", "25 °C", ["approx."]), ("in general due to two key factors there is", "two key factors", [])]
    df = spark.createDataFrame([(t, t.index(s), t.index(s) + len(s)) for t, s, _ in rows], "t string, a int, b int")
    got = {r.t: list(r.m) for r in df.select("t", modifiers(F.col("t"), F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {t: m for t, _, m in rows}


def test_units():
    for text in ("€ ton −1", "km / s", "g /cm3", "$2021/kWh", "$_{2021}/kWh", "$_2021/kWh", "$ 2021/kWh", "$ 2021 /kWh", "pint (uk) per minute", "TWh/a", "TWh kg*s^2/(m^2 per year)^3", "km", "%", "$/kWh"):
        unit_core.parse(text)
    part = lambda t, e, u: unit_core.Part(t, e, U + u, None)
    assert unit_core.single_class((part("μg", 1.0, "MicroGM"), part("mL", -1.0, "MilliL")), "μg/ mL") == U + "MicroGM-PER-MilliL"
    assert unit_core.ucum((part("km", 1.0, "KiloM"), part("s", -1.0, "SEC"))) == ("km/s", "km.s-1")
    assert unit_core.ucum((part("erg", 1.0, "ERG"), part("cm2", -1.0, "CentiM2"), part("s", -1.0, "SEC"))) == ("erg/(cm2.s)", "erg.cm-2.s-1")
