"""Units on columns: linking to the catalog by a join, and parsing, conversion and codes by Arrow functions.

The catalog is fixed data of a few thousand rows, whatever the input; workers build it once each. Unit strings repeat,
so parses are cached in each worker; `link` needs no Python at all.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.operators import unit_catalog, unit_core
from measurelake.operators.unit_core import Part

UNIT_TYPE = "array<struct<text:string,exponent:double,uri:string,year:int>>"
PARTS = pa.list_(pa.struct([("text", pa.string()), ("exponent", pa.float64()), ("uri", pa.string()), ("year", pa.int32())]))
_INFO = pa.struct([("dimension_vector", pa.string()), ("conversion_multiplier", pa.float64()), ("applicable_system", pa.list_(pa.string())), ("allow_conversion", pa.bool_())])
_UCUM = pa.struct([("slash", pa.string()), ("minus", pa.string())])


def as_rows(parts: tuple[Part, ...] | None) -> list[dict] | None:
    return None if parts is None else [{"text": p.text, "exponent": p.exponent, "uri": p.uri, "year": p.year} for p in parts]


def _parts(rows: list[dict] | None) -> tuple[Part, ...] | None:
    return None if rows is None else tuple(Part(r["text"], r["exponent"], r["uri"], r["year"]) for r in rows)


@cache
def _functions() -> dict:
    @F.arrow_udf(UNIT_TYPE)
    def parse(text: pa.Array) -> pa.Array:
        names = text.dictionary_encode()
        return pa.array([as_rows(unit_core.parse(t)) for t in names.dictionary.to_pylist()], PARTS).take(names.indices)

    @F.arrow_udf("double")
    def convert(value: pa.Array, source: pa.Array, target: pa.Array) -> pa.Array:
        rows = zip(value.to_pylist(), map(_parts, source.to_pylist()), map(_parts, target.to_pylist()), strict=True)
        return pa.array([None if None in (v, a, b) else unit_core.convert(v, a, b) for v, a, b in rows], pa.float64())

    @F.arrow_udf("struct<dimension_vector:string,conversion_multiplier:double,applicable_system:array<string>,allow_conversion:boolean>")
    def info(parts: pa.Array) -> pa.Array:
        def one(p: tuple[Part, ...] | None) -> dict | None:
            i = None if p is None else unit_core.info(p)
            dims = None if i is None else unit_catalog.vector([int(d) if d == int(d) else d for d in i.dims])
            return None if i is None else {"dimension_vector": dims, "conversion_multiplier": None if i.multiplier is None else float(i.multiplier), "applicable_system": list(i.systems), "allow_conversion": i.convertible}

        return pa.array([one(_parts(r)) for r in parts.to_pylist()], _INFO)

    @F.arrow_udf("struct<slash:string,minus:string>")
    def ucum(parts: pa.Array) -> pa.Array:
        codes = [None if r is None else unit_core.ucum(_parts(r)) for r in parts.to_pylist()]
        return pa.array([None if c is None else {"slash": c[0], "minus": c[1]} for c in codes], _UCUM)

    @F.arrow_udf("string")
    def pretty(parts: pa.Array) -> pa.Array:
        return pa.array([None if r is None else unit_core.pretty(_parts(r)) for r in parts.to_pylist()], pa.string())

    return {"parse": parse, "convert": convert, "info": info, "ucum": ucum, "pretty": pretty}


def parse_unit(text: Column) -> Column:
    """Parts of a unit string; null if something in it is no unit."""
    return _functions()["parse"](text)


def convert(value: Column, source: Column, target: Column) -> Column:
    """A value in the target's units, both parsed; null where they don't convert."""
    return _functions()["convert"](value, source, target)


def convert_fixed(value: Column, source: str, target: str) -> Column:
    """A value from one named unit to another, both parsed once by the driver: a factor and an offset in the plan.

    Null values stay null, and all are null where the units don't convert.
    """
    a, b = unit_core.parse(source), unit_core.parse(target)
    if a is None or b is None or (start := unit_core.convert(0.0, a, b)) is None:
        return F.lit(None).cast("double")
    return value * F.lit(unit_core.convert(1.0, a, b) - start) + F.lit(start)


def _catalog(spark: SparkSession) -> DataFrame:
    """(uri, dims, factor, plain) of every unit: fixed data of a few thousand rows; plain units convert by factors alone."""
    rows = [(u.uri, unit_catalog.vector([int(d) if d == int(d) else d for d in u.dims]), float(u.factor), not (u.offset or u.currency) and bool(u.systems)) for u in unit_core.units().values() if u.factor is not None]
    return spark.createDataFrame(rows, "uri string, dims string, factor double, plain boolean")


def rescale(df: DataFrame, value: str, parts: str, target: str, out: str) -> DataFrame:
    """`df` with `out`: the value, whose unit is a single linked part in column `parts`, in the units of `target`.

    Factors come by a broadcast join with the fixed catalogue, no Python runs for it. Null where the unit isn't one
    part of exponent 1 and of the target's dimensions, or has an offset or a currency (see `convert` for these).
    """
    to = unit_core.parse(target)
    only = unit_core.units()[to[0].uri]
    known = _catalog(df.sparkSession).where("plain").select(F.col("uri").alias("__uri"), F.col("dims").alias("__dims"), (F.col("factor") / float(only.factor)).alias("__ratio"))
    one = F.get(F.col(parts), F.lit(0))
    dims = unit_catalog.vector([int(d) if d == int(d) else d for d in only.dims])
    joined = df.join(F.broadcast(known), one["uri"] == F.col("__uri"), "left")
    good = (F.size(parts) == 1) & (one["exponent"] == 1) & (F.col("__dims") == dims)
    return joined.select(*(df[c] for c in df.columns), F.when(good, F.col(value) * F.col("__ratio")).alias(out))


def exchange(df: DataFrame, value: str, currency: str, year: str, target: str, target_year: int, cpi: DataFrame, fx: DataFrame, out: str) -> DataFrame:
    """`df` with `out`: an amount of money of some year in the target currency of the target year.

    `cpi` and `fx` hold (currency, year, rate): price levels, and rates to one common currency, each pair once. Prices
    rise to the target year first, then the amount is exchanged at that year's rates. Null where a rate is missing.
    The rates of the target year are few rows; levels are joined by (currency, year).
    """
    level = lambda n: cpi.select(F.col("currency").alias(f"__{n}c"), F.col("year").alias(f"__{n}y"), F.col("rate").alias(f"__{n}"))
    now = fx.where(F.col("year") == target_year)
    then, later = level("then"), level("later").where(F.col("__latery") == target_year)
    own = now.select(F.col("currency").alias("__own_c"), F.col("rate").alias("__own"))
    to = now.where(F.col("currency") == target).select(F.col("year").alias("__to_y"), F.col("rate").alias("__to"))
    x = df.join(then, (F.col(currency) == F.col("__thenc")) & (F.col(year) == F.col("__theny")), "left").join(later, F.col(currency) == F.col("__laterc"), "left")
    x = x.join(own, F.col(currency) == F.col("__own_c"), "left").join(to, F.lit(target_year) == F.col("__to_y"), "left")
    price = F.when(F.col(year) == target_year, 1.0).otherwise(F.col("__later") / F.col("__then"))
    rate = F.when(F.col(currency) == target, 1.0).otherwise(F.col("__own") / F.col("__to"))
    return x.select(*(df[c] for c in df.columns), (F.col(value) * price * rate).alias(out))


def unit_info(parts: Column) -> Column:
    """Dimensions, factor, systems and whether it may be converted."""
    return _functions()["info"](parts)


def ucum_code(parts: Column) -> Column:
    """UCUM codes with slashes and with negative exponents."""
    return _functions()["ucum"](parts)


def pretty(parts: Column) -> Column:
    return _functions()["pretty"](parts)


def link(df: DataFrame, surface: str) -> DataFrame:
    """`df` with `uri`, the best one of a whole surface as written or else in lower case; a join with fixed data."""
    best = df.sparkSession.createDataFrame(list(unit_catalog.best_uri().items()), "__surface string, uri string")
    as_written, lowered = best, best.select(F.col("__surface").alias("__lower"), F.col("uri").alias("__other"))
    out = df.join(F.broadcast(as_written), F.col(surface) == F.col("__surface"), "left").join(F.broadcast(lowered), F.lower(F.col(surface)) == F.col("__lower"), "left")
    return out.select(*(df[c] for c in df.columns), F.coalesce("uri", "__other").alias("uri"))
