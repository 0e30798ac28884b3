"""What keeps queries within their time on large tables: steps that don't grow with lists of terms, and rows over all cores."""

from __future__ import annotations

import itertools
import random
import time
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from measurelake import catalogue
from measurelake.functions import formatting as N
from measurelake.functions import lexicon
from measurelake.functions import text as T
from measurelake.functions.text import let
from measurelake.operators import candidates as C
from measurelake.operators import modifiers as M
from measurelake.operators.quantities import spread


def _every_fraction(value: Column) -> Column:
    each = lambda v: F.transform(F.sequence(F.lit(1), F.lit(N.DENOMINATORS)), lambda d: F.struct(F.round(F.abs(F.round(v * d) / d - v), 12).alias("off"), d.alias("d")))
    return let(value, lambda v: let(F.array_min(each(v))["d"], lambda d: F.struct(F.round(v * d).cast("long").alias("numerator"), d.cast("long").alias("denominator"))))


def test_nearest_fraction_is_the_same_with_few_steps(spark):
    r = random.Random(3)
    values = [None, 0.0, -0.0, 0.5, 1 / 3, -1 / 3, 0.0005, 0.999, 0.9995, 1e-13, 2**30 - 0.3, 2**30 + 0.3, 1e12 + 0.25, 1e17, 1e6 + 1 / 6, -1e6 - 1 / 7]
    for _ in range(60):
        a, b, whole = Fraction(r.randrange(1000), r.randrange(1, 1001)), Fraction(r.randrange(1000), r.randrange(1, 1001)), r.choice([0, 7, 123456, 2**28])
        values += [float(a) + whole, -float(a) - whole, float((a + b) / 2) + whole, float(a) + 1e-12 + whole, r.random() + whole, r.random() / 1000]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~_every_fraction(F.col("v")).eqNullSafe(N.nearest_fraction(F.col("v")))).count() == 0
    begun = time.monotonic()
    big = spark.range(0, 200_000, 1, 8).select((F.col("id") / 8 + 0.3).alias("v")).select("v", N.nearest_fraction(F.col("v")).alias("x"))
    assert big.where((F.col("x.denominator") > 40) | (F.abs(F.col("x.numerator") / F.col("x.denominator") - F.col("v")) > 1e-9)).count() == 0
    assert time.monotonic() - begun < 20  # with a thousand denominators a row it took a minute


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(0, 5000, 1, 1).select("id", F.repeat(F.lit("x"), 50).alias("t")).write.parquet(path)
    split = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # many parts, and all rows in one
        dealt = spread(rows)
        assert dealt.columns == rows.columns and dealt.count() == 5000
        assert dealt.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() == spark.sparkContext.defaultParallelism
    finally:
        for k in split:
            spark.conf.unset(k)


def test_predicates_find_the_same_in_less_time(spark):
    r = random.Random(4)
    terms = [*lexicon.NUMBER_WORDS, *lexicon.MAGNITUDES, *lexicon.IMPRECISE_QUANTITIES, *lexicon.CONSTANTS]
    texts = [f"ab {t[: r.randrange(1, len(t) + 1)]}{r.choice(['', ' x', 's', ' of'])}" for t in terms] + [f"In{t.upper()}." for t in terms] + ["7", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t, low = F.col("t"), F.lower(F.col("t"))
    pairs = ((T.contains_number(t), T.NUMBER_PATTERN), (T.contains_number(t, imprecise=True), T.NUMBER_OR_IMPRECISE_PATTERN), (T.is_imprecise(t), T.IMPRECISE_PATTERN), (T.contains_constant(t), T.CONSTANT_PATTERN))
    assert [df.where(~found.eqNullSafe(low.rlike(pattern))).collect() for found, pattern in pairs] == [[]] * 4
    words = "the process was stable over the whole period and the samples were measured again by their owners ".split()
    long = spark.range(0, 400, 1, 8).select(F.lit(" ".join(r.choices(words, k=3000))).alias("t"), "id")
    lasts = lambda c: _seconds(long.select(F.concat("t", F.col("id").cast("string")).alias("t")).where(c))
    lasts(T.contains_constant(t))
    assert lasts(T.contains_constant(t)) * 2 < lasts(low.rlike(T.CONSTANT_PATTERN))


def test_modifiers_are_the_same_with_one_search_each(spark):
    r = random.Random(5)
    words, signs = ([m for m in lexicon.PREFIXED_MODIFIERS if (m[-1].isalnum() or m.endswith(".")) == w] for w in (True, False))
    prefix = rf"(?:(?:(?<!\w)(?:{T.alternatives(words)})(?!\w)|(?:{T.alternatives(signs)}))\s?)+"
    suffixes = T.alternatives(lexicon.SUFFIXED_MODIFIERS)
    olds = (rf"(?i)({prefix})$", rf"(?i)^({prefix})", rf"(?i)^(\s?(?:{suffixes})(?!\w))", rf"(?i)((?<!\w)(?:{suffixes}))$")
    every = [*lexicon.PREFIXED_MODIFIERS, *lexicon.SUFFIXED_MODIFIERS]
    texts = [*every, *(f" {m.upper()}" for m in every), *(f"{r.choice(['it ', '(', ''])}{a}{r.choice(['', ' ', 's '])}{b}{r.choice(['', ' ', 'x', ' 5'])}" for a, b in (r.choices(every, k=2) for _ in range(1500)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = [F.regexp_extract("t", new, 1) == F.regexp_extract("t", old, 1) for new, old in zip((M._BEFORE, M._FIRST, M._AFTER, M._LAST), olds, strict=True)]
    assert [df.where(~s).collect() for s in same] == [[]] * 4
    rows = spark.range(0, 80_000, 1, 8).select(F.concat(F.lit("the load in the last year is approximately "), F.col("id").cast("string"), F.lit(" kg or more")).alias("t"))
    once = _seconds(rows.where(F.regexp_extract("t", olds[0], 1) == ""))
    found = lambda: _seconds(rows.where(F.array_join(M.modifiers(F.col("t"), F.lit(43), F.length("t") - 8), "|") != ""))
    found()
    assert found() < 2 * once  # what is before a span was looked for four times


def test_ranking_of_many_readings_is_not_quadratic(spark):
    every = ["n" + "".join(p) for p in itertools.product("um", repeat=11)]
    rows = C.ranked(spark.createDataFrame([(["5", *"abcdefghijk"], [*every, "nrn"])], "t array<string>, e array<string>"), "t", "e", "r").select("r")
    begun = time.monotonic()
    assert rows.first().r == "nrn"  # beside a range that rises no single quantity stands
    assert time.monotonic() - begun < 40


def test_equal_spans_of_a_group_are_counted_before_they_are_parsed(spark):
    plan = catalogue.QUERIES["quantity_ranges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate [") > plan.index("ArrowEvalPython")


def _seconds(df) -> float:
    begun = time.monotonic()
    df.count()
    return time.monotonic() - begun
