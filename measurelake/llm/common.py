"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, everywhere in this subpackage: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have: `name`, longer by underscores if it must."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of `rows` rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What a worker process keeps for its next task: one thing at a time, by key.
_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """`make()`, kept in this worker process until another key is asked for, or `release`."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what this worker process has `held`: workers go on to other operators, and their memory is the executor's."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the context's own.

    Where neither is set, a local session (tests) gets a temporary folder, and a cluster one in the warehouse, which
    its executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        local = spark.sparkContext.master.split("[")[0] == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Cut lineage: write `df` as Parquet (by the session's codec, or this one) into the shared folder and read it again.

    The files outlive lost executors; they are deleted by `discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


#: Where each materialized DataFrame lies.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame that `materialize` returned; nothing may read it, or what is made of it, again."""
    _delete(df.sparkSession, _written.pop(df))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before us
        pass


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key as text, modulo `parts`."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once a row, however often lambdas in `body` use it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
