"""Streams of texts with quantities: parsed row by row, and counted by windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.operators.quantities import parse_quantities


def parse_stream(events: DataFrame, text: Column, out: str = "quantity") -> DataFrame:
    """A stream with the record of its quantity spans in `out`; no state, so late and repeated events are parsed alike."""
    return parse_quantities(events, text, out)


def counts_by_window(parsed: DataFrame, time: str, every: str, late: str, record: str = "quantity") -> DataFrame:
    """(start, type, n, parsed_n): spans of each type and how many of them were read with success, by windows of event time.

    Events that come later than `late` behind the newest are passed over, so the state stays as large as the windows
    still open; rows without a time are passed over too.
    """
    windows = parsed.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(F.window(time, every).alias("window"), F.col(f"{record}.type").alias("type"))
    counts = windows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(f"{record}.success"), F.lit(False))).alias("parsed_n"))
    return counts.select(F.col("window.start").alias("start"), "type", "n", "parsed_n")
