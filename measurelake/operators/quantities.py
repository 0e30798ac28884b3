"""Quantity spans to typed records: native normalization, then one Arrow function for the grammar."""

from __future__ import annotations

from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.functions.text import normalize_quantity
from measurelake.operators import quantity_core
from measurelake.operators.candidates import unused_name
from measurelake.operators.quantity_core import Parsed, Quantity, Uncertainty
from measurelake.operators.unit_core import parse as parse_unit
from measurelake.operators.units import PARTS, UNIT_TYPE, as_rows

_MODIFIER, _UNIT = "struct<text:string,normalized:string>", f"struct<text:string,ellipsed:boolean,normalized:{UNIT_TYPE}>"
_BOUNDS = "struct<type:string,lb:double,ub:double,unit:string,unit_normalized:" + UNIT_TYPE + ",is_same_as_mean:boolean>"
QUANTITY_TYPE = (
    f"struct<text:string,type:string,nbr_quantities:int,success:boolean,separators:array<struct<text:string,role:string>>,normalized_quantities:array<struct<"
    f"prefixed_modifier:{_MODIFIER},prefixed_unit:{_UNIT},value:struct<text:string,numeric_value:double,is_imprecise:boolean>,uncertainty:{_BOUNDS},suffixed_unit:{_UNIT},suffixed_modifier:{_MODIFIER}>>>"
)
_modifier = pa.struct([("text", pa.string()), ("normalized", pa.string())])
_unit = pa.struct([("text", pa.string()), ("ellipsed", pa.bool_()), ("normalized", PARTS)])
_bounds = pa.struct([("type", pa.string()), ("lb", pa.float64()), ("ub", pa.float64()), ("unit", pa.string()), ("unit_normalized", PARTS), ("is_same_as_mean", pa.bool_())])
_value = pa.struct([("text", pa.string()), ("numeric_value", pa.float64()), ("is_imprecise", pa.bool_())])
_quantity = pa.struct([("prefixed_modifier", _modifier), ("prefixed_unit", _unit), ("value", _value), ("uncertainty", _bounds), ("suffixed_unit", _unit), ("suffixed_modifier", _modifier)])
_record = pa.struct(
    [("text", pa.string()), ("type", pa.string()), ("nbr_quantities", pa.int32()), ("success", pa.bool_()), ("separators", pa.list_(pa.struct([("text", pa.string()), ("role", pa.string())]))), ("normalized_quantities", pa.list_(_quantity))]
)


def _pair(m: tuple[str, str | None] | None) -> dict | None:
    return m and {"text": m[0], "normalized": m[1]}


def _unit_row(u: tuple | None, ellipsed: bool) -> dict | None:
    return u and {"text": u[0], "ellipsed": ellipsed, "normalized": as_rows(u[1])}


def _uncertainty(u: Uncertainty | None) -> dict | None:
    return u and {"type": u.kind, "lb": u.lb, "ub": u.ub, "unit": u.unit, "unit_normalized": as_rows(parse_unit(u.unit)) if u.unit else None, "is_same_as_mean": u.unit is None}


def _row(q: Quantity) -> dict:
    return {
        "prefixed_modifier": _pair(q.modifier),
        "prefixed_unit": _unit_row(q.prefix, q.ellipsed),
        "value": {"text": q.text, "numeric_value": q.value, "is_imprecise": q.imprecise},
        "uncertainty": _uncertainty(q.uncertainty),
        "suffixed_unit": _unit_row(q.suffix, q.ellipsed),
        "suffixed_modifier": _pair(q.after),
    }


def record(text: str | None) -> dict | None:
    """The record of one normalized span; null for null."""
    if text is None:
        return None
    p: Parsed = quantity_core.parse(text)
    return {"text": text, "type": p.kind, "nbr_quantities": len(p.quantities), "success": p.success, "separators": [{"text": t, "role": r} for t, r in p.separators], "normalized_quantities": [_row(q) for q in p.quantities]}


#: Records of spans that a worker has met are kept, up to so many.
KEPT = 50_000


@lru_cache(KEPT)
def _known(text: str) -> dict | None:
    return record(text)


@cache
def _parse():
    @F.arrow_udf(QUANTITY_TYPE)
    def parse(text: pa.Array) -> pa.Array:
        spans = text.dictionary_encode()
        return pa.array([_known(t) for t in spans.dictionary.to_pylist()], _record).take(spans.indices)

    return parse


def _filled(df: DataFrame) -> int:
    """Parts that hold rows; only footers are read, as no column is."""
    return df.select(F.spark_partition_id().alias("part")).distinct().count()


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its rows lie in fewer parts than there are; else as it is.

    A file is cut by size, but all of a row group's rows are in the part that its middle is in: so the parts of a table
    that is read as it is are counted by their rows. Rows are dealt by number, which needs no sorting of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plain = not df.isStreaming and df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if df.isStreaming or df.rdd.getNumPartitions() >= cores and not (plain and _filled(df) < cores):
        return df
    number = unused_name(df, "__number")
    return df.withColumn(number, F.monotonically_increasing_id()).repartition(cores, number).drop(number)


def parse_quantities(df: DataFrame, text: Column, out: str = "quantity", deal: bool = True) -> DataFrame:
    """`df` with the record of a quantity span in column `out`; null for null, type `unknown` without a number.

    The normalized text is generated as a column before the grammar reads it: so the function's argument is a plain
    attribute, and the function runs once a row however many fields of the record are used. Of equal spans in a batch
    one is parsed, and workers keep what they have parsed. Rows are only moved where a scan has too few parts, and not
    without `deal`, as behind an exchange they are dealt already (to count its parts would run it).
    """
    df = spread(df) if deal else df
    lines = df.select("*", F.explode(F.array(normalize_quantity(text))).alias("__normalized"))
    return lines.select(*(df[c] for c in df.columns), _parse()(F.col("__normalized")).alias(out))
