"""JSON surface lists and result files, annotated corpora in TEI, and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "paragraph int, text string, spans array<struct<start:int,end:int,type:string,surface:string>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("surface", pa.string())])
_SKIPPED = ("list", "figure")


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """(uri, surface) of JSON files that are one object each: uri to a list of surfaces."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("uri", "surfaces"))
    return whole.select("uri", F.explode("surfaces").alias("surface"))


def read_results(spark: SparkSession, folder: str, prefix: str, schema: str, suffix: str = ".json") -> DataFrame:
    """All JSON-line files of a folder with this prefix and suffix, and the name of each row's file."""
    return spark.read.schema(schema).json(f"{folder}/{prefix}*{suffix}").withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))


def paragraphs(document: str) -> Iterator[tuple[int, str, list[dict]]]:
    """Number, text and measure spans of the paragraphs of a TEI document, by offsets into the text.

    Mixed content is read in order. Comments, lists and figures are left out; a measure that holds only a date or
    only units isn't a span.
    """
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    for k, p in enumerate(e for e in ElementTree.fromstring(document).iter() if local(e) == "p"):
        text, spans = [""], []

        def walk(e: ElementTree.Element, text: list[str] = text, spans: list[dict] = spans) -> None:
            start = len(text[0])
            text[0] += e.text or ""
            for child in e:
                if local(child) and local(child) not in _SKIPPED:
                    walk(child)
                text[0] += child.tail or ""
            inner = {local(x) for x in e.iter()} - {"measure"}
            kinds = {x.get("type") for x in e.iter() if local(x) == "measure"}
            if local(e) == "measure" and inner & {"num"} or local(e) == "measure" and not inner and not kinds & {"UNIT", "DATE"}:
                spans.append({"start": start, "end": len(text[0]), "type": e.get("type") or "value", "surface": text[0][start:]})

        walk(p)
        outer = [s for s in spans if not any(o is not s and o["start"] <= s["start"] and s["end"] <= o["end"] for o in spans)]
        yield k, text[0], outer


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """(source, paragraph, text, spans) of TEI files; each file is read whole by one task, files by many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, text in zip(batch.column(0), batch.column(1), strict=True):
                rows = list(paragraphs(text.as_py()))
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(rows), pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(_SPAN))], ["source", "paragraph", "text", "spans"])

    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("source"), "value")
    return files.mapInArrow(run, "source string, " + SPANS)


def write_lookup(df: DataFrame, path: str, form: str = "json") -> None:
    """A lookup or an evaluation as JSON lines or Parquet files, replacing what is there."""
    df.write.mode("overwrite").format(form).save(path)
