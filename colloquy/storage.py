"""Tables in the folder that driver and executors share: written once, read back, deleted when Python ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that a Python kernel holds as Python objects at once.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, on a master of this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of path, the path as that system names it)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = file_system(spark, path)
    return files.exists(target)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name in shared storage; the folder is deleted when Python ends."""
    path = f"{shared_dir(spark)}/colloquy/{label}-{uuid.uuid4().hex}"
    files, target = file_system(spark, path)
    atexit.register(_delete, files, target)
    return path


def _delete(files, target) -> None:
    with suppress(Exception):  # the JVM may be gone by then
        files.delete(target, True)


def local_path(spark: SparkSession, label: str) -> str:
    """A new folder in shared storage by the path that plain file calls take; an error where it is no folder of that kind."""
    path = fresh_path(spark, label)
    scheme, colon, rest = path.partition(":")
    if colon and "/" not in scheme and scheme != "file":
        raise RuntimeError(f"{path}: files are written by path here, which needs a mounted folder in spark.checkpoint.dir")
    return "/" + (rest if colon and scheme == "file" else path).lstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, kernel: Callable[[Iterator[tuple]], Iterable[tuple]], schema: T.StructType) -> DataFrame:
    """Run kernel once a partition, from an iterator of row tuples to an iterable of row tuples; rows cross in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), out.types, strict=True)], schema=out)

    def run(batches):
        ready = []
        for row in kernel(rows(batches)):
            ready.append(row)
            if len(ready) == 4 * SLICE_ROWS:
                yield batch_of(ready)
                ready = []
        if ready:
            yield batch_of(ready)

    return df.mapInArrow(run, schema)
