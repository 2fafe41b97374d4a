"""Plumbing shared by the training-data operators: shared storage, Arrow row mapping."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a Python kernel holds as Python objects at once.
SLICE_ROWS = 256


def ship(*modules) -> None:
    """Have kernels of these modules travel with the task instead of being imported there."""
    for module in modules:
        cloudpickle.register_pickle_by_value(module)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder serves a local[...] master, whose only machine is
    this one; any other master must name a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of this thread that are still to be deleted, innermost scratch() last; what is left goes when Python ends.
_folders = threading.local()


def _open_lists() -> list[list[tuple[str, Callable[[], None]]]]:
    if not hasattr(_folders, "lists"):
        _folders.lists = [[]]
        atexit.register(_delete, _folders.lists[0])
    return _folders.lists


def _delete(folders: list[tuple[str, Callable[[], None]]]) -> None:
    while folders:
        folders.pop()[1]()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name in shared storage; the folder is deleted with the scratch() around, or when Python ends."""
    path = f"{shared_dir(spark)}/colloquy/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _open_lists()[-1].append((path, lambda: files.delete(target, True)))
    return path


def settle(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(*paths: str) -> None:
    """Delete folders of fresh_path() before their time."""
    for folders in _open_lists():
        for entry in [e for e in folders if e[0] in paths]:
            folders.remove(entry)
            entry[1]()


@contextmanager
def scratch():
    """Folders made inside are deleted on leaving, also after a failure, but for those named to the function that this gives."""
    lists, kept = _open_lists(), set()
    lists.append([])
    try:
        yield lambda *paths: kept.update(paths)
    finally:
        own = lists.pop()
        lists[-1].extend(e for e in own if e[0] in kept)
        _delete([e for e in own if e[0] not in kept])


def map_rows(
    df: DataFrame,
    kernel: Callable[[Iterator[tuple]], Iterable[tuple]],
    schema: str | T.StructType,
) -> DataFrame:
    """Run kernel once per partition, from an iterator of row tuples to an iterable of row tuples.

    Rows cross in Arrow batches; only SLICE_ROWS of them are Python objects at a time.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = _arrow_schema(fields)

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    def run(batches):
        found = iter(kernel(rows(batches)))
        while chunk := list(itertools.islice(found, 8 * SLICE_ROWS)):
            columns = list(zip(*chunk, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    return df.mapInArrow(run, fields)


def _arrow_schema(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def quoted(*names: str) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of like, in their order."""
    return df.select(*quoted(*like.columns))


def join_hot(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", share: int = 256, least: int = 1000) -> DataFrame:
    """big joined on key with small, which has one row a key and in `_n` how many rows of big have it; `_n` is dropped.

    A key that more than a `share`-th of all rows have, and more than `least`, is dealt out by
    the hash of column `spread`; its one row of small is repeated for each part. There are
    fewer than `share` such keys, which bounds what is collected and broadcast.
    """
    total = small.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    most = max(least, total // share)
    hot = [(k, -(-n // most)) for k, n in small.filter(F.col("_n") > most).select(key, "_n").collect()]
    small = small.drop("_n")
    if not hot:
        return big.join(small, key, how)
    kind = small.schema[key].dataType.simpleString()
    parts = F.broadcast(small.sparkSession.createDataFrame(hot, f"{key} {kind}, _parts bigint"))
    dealt = big.join(parts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0))).drop("_parts")
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    copied = small.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def row_key() -> Column:
    """A hash that tells rows apart by doc_id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


#: Words of 64 bits that the filter of `likely` has at most, whatever the number of keys: its broadcast is bounded by this.
FILTER_WORDS = 1 << 20


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """df with _likely: false only where the hash `key` is not in wanted, so that few other rows need a shuffle.

    A one-hash Bloom filter with about 16 bits a key, as rows of 64 bits that are broadcast; where
    keys outgrow its fixed bound it says yes more often, which costs time and changes no result.
    """
    n = wanted.count()
    words = min(FILTER_WORDS, 1 << max(10, (n // 4).bit_length()))
    slot = lambda: F.pmod(F.col(key), F.lit(words).cast("bigint"))
    bit = lambda: F.shiftrightunsigned(F.col(key), 58).cast("int")
    one = F.lit(1).cast("bigint")
    table = wanted.select(slot().alias("_slot"), F.call_function("shiftleft", one, bit()).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    held = F.call_function("shiftrightunsigned", F.col("_bits"), bit()).bitwiseAND(one) == 1
    return df.withColumn("_slot", slot()).join(F.broadcast(table), "_slot", "left").withColumn("_likely", F.coalesce(held, F.lit(False))).drop("_slot", "_bits")
