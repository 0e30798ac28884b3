"""Queries over the driver's tables, one or more for each operator, with their DuckDB twins.

Texts are rendered from columns, parsed back, and compared with the columns: the twin knows the answer without parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.functions import text as T
from measurelake.functions.numbers import str2num
from measurelake.operators.modifiers import modifiers
from measurelake.operators.quantities import parse_quantities, spread
from measurelake.operators.units import convert_fixed, link, parse_unit, rescale, ucum_code, unit_info

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, *choices: str) -> Column:
    """One of the texts, by the key's remainder."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(key, F.lit(len(choices))) + 1).cast("int"))


def _whole(c: Column) -> Column:
    return F.round(c).cast("long")


def _parsed(df: DataFrame, text: Column) -> DataFrame:
    return parse_quantities(df, text, "r")


def _first(record: Column) -> Column:
    return F.get(record["normalized_quantities"], F.lit(0))


#: Unit surfaces that queries render, and how many millimetres, milligrams or seconds each is.
LENGTHS = ("mm", "cm", "m")
MASSES = ("mg", "g", "kg")


@query("SELECT p_brand, count(*) AS n, sum(p_size * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 1000 END)::BIGINT AS total_mm FROM part GROUP BY p_brand")
def length_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat_ws(" ", F.col("p_size").cast("string"), _pick(F.col("p_partkey"), *LENGTHS))
    q = _parsed(_table(spark, sf_dir, "part"), t).select("p_brand", _first(F.col("r")).alias("q")).select("p_brand", F.col("q.value.numeric_value").alias("v"), F.col("q.suffixed_unit.normalized").alias("u"))
    return rescale(q, "v", "u", "mm", "in_mm").select("p_brand", _whole(F.col("in_mm")).alias("mm")).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("mm").alias("total_mm"))


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS number FROM orders")
def number_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", str2num(F.format_string("%.2f", F.col("o_totalprice").cast("double"))).alias("number"))


@query("SELECT o_orderkey, round(o_totalprice::DOUBLE * 1000, 0)::BIGINT AS number FROM orders")
def number_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.round(F.col("o_totalprice").cast("double") * 1000, 0).cast("long")
    return _table(spark, sf_dir, "orders").select("o_orderkey", str2num(F.format_number(whole, 0)).cast("long").alias("number"))


@query("SELECT c_custkey, (c_custkey % 79 + 21)::DOUBLE AS number FROM customer")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 79 + 21
    tens = F.element_at(F.array(*map(F.lit, "twenty thirty forty fifty sixty seventy eighty ninety".split())), (n / 10).cast("int") - 1)
    ones = F.get(F.array(*map(F.lit, ["", *"-one -two -three -four -five -six -seven -eight -nine".split()])), (n % 10).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", str2num(F.concat(tens, ones)).alias("number"))


@query("SELECT p_partkey, p_size::BIGINT * CASE p_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END AS number FROM part")
def number_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.concat_ws(" ", F.col("p_size").cast("string"), _pick(F.col("p_partkey"), "hundred", "thousand", "million", "billion"))
    return _table(spark, sf_dir, "part").select("p_partkey", _whole(str2num(rendered)).alias("number"))


@query("SELECT p_partkey, p_size::BIGINT * CASE p_partkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 100000 END AS number FROM part")
def number_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.concat(F.col("p_size").cast("string"), _pick(F.col("p_partkey"), "×10^3", "e6", " * 10**5"))
    return _table(spark, sf_dir, "part").select("p_partkey", _whole(str2num(rendered)).alias("number"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity::DOUBLE + (l_linenumber % 4) / 4.0) * 4)::BIGINT AS quarters FROM lineitem")
def number_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), (F.col("l_linenumber") % 4).cast("string"), F.lit("/4"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _whole(str2num(rendered) * 4).alias("quarters"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LOWERED = "lower(text)"


@query(
    f"SELECT doc_id, regexp_matches({_LOWERED}, {_quoted(T.NUMBER_PATTERN)}) AS number, regexp_matches({_LOWERED}, {_quoted(T.NUMBER_OR_IMPRECISE_PATTERN)}) AS number_or_imprecise, regexp_matches({_LOWERED}, {_quoted(T.IMPRECISE_PATTERN)}) AS imprecise,"
    f" regexp_matches({_LOWERED}, {_quoted(T.CONSTANT_PATTERN)}) AS constant, regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, '[0-9]\\.[0-9]') AS decimal FROM documents"
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return spread(_table(spark, sf_dir, "documents")).select(
        "doc_id", T.contains_number(t).alias("number"), T.contains_number(t, imprecise=True).alias("number_or_imprecise"), T.is_imprecise(t).alias("imprecise"), T.contains_constant(t).alias("constant"), T.contains_digit(t).alias("digit"), T.contains_decimal(t).alias("decimal")
    )


@query("SELECT p_partkey, k NOT IN (3, 4, 5) AS number, k NOT IN (4, 5) AS number_or_imprecise, k = 3 AS imprecise, k IN (4, 6) AS constant, k IN (0, 1, 6) AS digit, k = 1 AS decimal FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part)")
def predicates_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pick(F.col("p_partkey"), "it has 3 legs", "a length of 2.5 m", "a Trillion atoms", "a gazillion atoms", "the Planck constant", "no amount here", "the speed of light, 299 Mm/s")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", T.contains_number(t).alias("number"), T.contains_number(t, imprecise=True).alias("number_or_imprecise"), T.is_imprecise(t).alias("imprecise"), T.contains_constant(t).alias("constant"), T.contains_digit(t).alias("digit"), T.contains_decimal(t).alias("decimal")
    )


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS numeric, p_partkey % 3 = 0 AS with_zero FROM part")
def is_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-0."), size)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" ."), size)).otherwise(F.concat(size, F.lit("d")))
    return _table(spark, sf_dir, "part").select("p_partkey", T.is_numeric(t).alias("numeric"), T.is_numeric(t, require_leading_zero=True).alias("with_zero"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS relative FROM orders")
def is_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, amount = _pick(F.col("o_orderkey"), "a share of ", "it rose by ", "it lay "), F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(" %"))
    after = _pick(F.col("o_orderkey"), " was found", " was found", " above the mean")
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.is_relative(F.concat(before, amount, after), F.length(before), F.length(before) + F.length(amount)).alias("relative"))


@query("SELECT p_partkey, p_size || '.5 ± 2 ≥ 10^3' AS normalized FROM part")
def normalize_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(".5  +/- 2  >= 10³. "))
    return _table(spark, sf_dir, "part").select("p_partkey", T.normalize_quantity(t).alias("normalized"))


_MODIFIED = "CASE o_orderkey % 4 WHEN 0 THEN '~' WHEN 1 THEN '>=' WHEN 2 THEN '>' ELSE '<' END"


@query(f"SELECT {_MODIFIED} AS modifier, count(*) AS n, sum(o_custkey % 500 + 1)::BIGINT AS total FROM orders GROUP BY 1")
def quantity_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(_pick(F.col("o_orderkey"), "about ", "at least ", "more than ", "less than "), (F.col("o_custkey") % 500 + 1).cast("string"), F.lit(" kg"))
    q = _parsed(_table(spark, sf_dir, "orders"), t).select(_first(F.col("r")).alias("q"))
    return q.groupBy(F.col("q.prefixed_modifier.normalized").alias("modifier")).agg(F.count("*").alias("n"), F.sum(_whole(F.col("q.value.numeric_value"))).alias("total"))


@query("SELECT l_returnflag, 'range' AS type, count(*) AS n, sum(l_quantity::INT)::BIGINT AS lower, sum(l_quantity::INT + l_linenumber)::BIGINT AS upper FROM lineitem GROUP BY l_returnflag")
def quantity_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("l_quantity").cast("int")
    t = F.concat(F.lit("between "), low.cast("string"), F.lit(" and "), (low + F.col("l_linenumber")).cast("string"), F.lit(" km/h"))
    # equal texts of a group are counted first: their record is the same, so each is normalized, parsed and moved once
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", t.alias("t")).agg(F.count("*").alias("n"))
    q = parse_quantities(rows, F.col("t"), "r", deal=False)
    value = lambda k: F.sum(_whole(F.col("r.normalized_quantities")[k]["value"]["numeric_value"]) * F.col("n"))
    return q.groupBy("l_returnflag", F.col("r.type").alias("type")).agg(F.sum("n").alias("n"), value(0).alias("lower"), value(1).alias("upper"))


@query("SELECT p_brand, 'tolerance' AS kind, count(*) AS n, -sum(p_partkey % 9 + 1)::BIGINT AS lower, sum(p_partkey % 9 + 1)::BIGINT AS upper FROM part GROUP BY p_brand")
def quantity_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.col("p_size").cast("string"), F.lit(" ± "), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" %"))
    q = _parsed(_table(spark, sf_dir, "part"), t).select("p_brand", _first(F.col("r"))["uncertainty"].alias("u"))
    return q.groupBy("p_brand", F.col("u.type").alias("kind")).agg(F.count("*").alias("n"), F.sum(_whole(F.col("u.lb"))).alias("lower"), F.sum(_whole(F.col("u.ub"))).alias("upper"))


@query("SELECT CASE p_partkey % 5 WHEN 0 THEN 'single_quantity' WHEN 1 THEN 'range' WHEN 2 THEN 'list' WHEN 3 THEN 'ratio' ELSE 'multidim' END AS type, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 3 ELSE 2 END::INT AS quantities, count(*) AS n FROM part GROUP BY 1, 2")
def quantity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = ((F.col("p_size") + k).cast("string") for k in (0, 7, 19))
    kind = F.col("p_partkey") % 5
    t = F.when(kind == 0, F.concat(a, F.lit(" m"))).when(kind == 1, F.concat(a, F.lit(" to "), b, F.lit(" m"))).when(kind == 2, F.concat(a, F.lit(" m, "), b, F.lit(" m and "), c, F.lit(" m")))
    t = t.when(kind == 3, F.concat(a, F.lit(" out of "), b)).otherwise(F.concat(a, F.lit(" x "), b, F.lit(" x "), c, F.lit(" mm")))
    q = _parsed(_table(spark, sf_dir, "part"), t)
    return q.groupBy(F.col("r.type").alias("type"), F.col("r.nbr_quantities").alias("quantities")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, (p_size * 10)::BIGINT AS metres_per_second_10 FROM part")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = convert_fixed(F.col("p_size") * 3.6, "km/h", "m/s")
    return _table(spark, sf_dir, "part").select("p_partkey", _whole(speed * 10).alias("metres_per_second_10"))


@query("SELECT p_partkey, (p_size * 18 + 320)::BIGINT AS fahrenheit_10 FROM part")
def temperature_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = convert_fixed(F.col("p_size").cast("double"), "°C", "°F")
    return _table(spark, sf_dir, "part").select("p_partkey", _whole(f * 10).alias("fahrenheit_10"))


@query("SELECT 'http://qudt.org/vocab/unit/' || CASE p_partkey % 3 WHEN 0 THEN 'MilliGM' WHEN 1 THEN 'GM' ELSE 'KiloGM' END AS uri, count(*) AS n FROM part GROUP BY 1")
def unit_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(_table(spark, sf_dir, "part").select(_pick(F.col("p_partkey"), *MASSES).alias("surface")), "surface").groupBy("uri").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'km/s' ELSE 'erg/(cm2.s)' END AS slash, CASE s_suppkey % 2 WHEN 0 THEN 'km.s-1' ELSE 'erg.cm-2.s-1' END AS minus FROM supplier")
def unit_ucum(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = "http://qudt.org/vocab/unit/"
    erg = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(float(e)).alias("exponent"), F.lit(unit + u).alias("uri"), F.lit(None).cast("int").alias("year")) for t, e, u in (("erg", 1, "ERG"), ("cm", -2, "CentiM"), ("s", -1, "SEC"))))
    code = ucum_code(F.when(F.col("s_suppkey") % 2 == 0, parse_unit(F.lit("km / s"))).otherwise(erg))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("c")).select("s_suppkey", "c.*")


@query("SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'A0E0L1I0M0H0T-1D0' ELSE 'A0E0L2I0M1H0T-2D0' END AS dimension_vector FROM supplier")
def unit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = unit_info(parse_unit(_pick(F.col("s_suppkey"), "km/h", "kg m^2 / s^2")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", info["dimension_vector"].alias("dimension_vector"))


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'approximately' WHEN 1 THEN 'or higher' ELSE '' END AS modifiers, count(*) AS n FROM orders GROUP BY 1")
def text_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _pick(F.col("o_orderkey"), "the load is approximately ", "the load is ", "these are "), _pick(F.col("o_orderkey"), ", it says", " or higher when seen", " key factors")
    span = F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit(" kg"))
    found = modifiers(F.concat(before, span, after), F.length(before), F.length(before) + F.length(span))
    return spread(_table(spark, sf_dir, "orders")).groupBy(F.array_join(found, "|").alias("modifiers")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, true AS correct, CASE WHEN p_partkey % 2 = 0 THEN true ELSE false END AS success, count(*) AS n FROM part GROUP BY ALL")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-assessment against the known answer: one half has a number, the other has none."""
    known = F.col("p_partkey") % 2 == 0
    t = F.when(known, F.concat(F.col("p_size").cast("string"), F.lit(" kg"))).otherwise("no amount here")
    r = _parsed(_table(spark, sf_dir, "part"), t).withColumn("known", known)
    right = _first(F.col("r"))["value"]["numeric_value"].eqNullSafe(F.when(F.col("known"), F.col("p_size").cast("double")))
    return r.groupBy("p_brand", right.alias("correct"), F.col("r.success").alias("success")).agg(F.count("*").alias("n"))
