"""SimHash near-dedup by a binary-trie self-join.

Fingerprints are cut into budget + 1 blocks; two that differ in at most budget bits agree in
one block, so they meet in that block's bucket. Each bucket is joined with itself by going
down its binary trie in node pairs, and gives a spanning set of its links; distributed
star passes then make global components of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_kernel as kernel
from .common import join_hot, map_rows, same_columns, scratch, settle, ship
from .components import connected_components

ship(kernel)

#: A bucket with more fingerprints than this, and than a 64th of all, is dealt out in slices.
SLICE_AT = 16_384


def _blocks(n: int) -> list[tuple[int, int]]:
    """(offset, bits) of n blocks that cover 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit fingerprint as a signed long, 0 for texts without words."""
    return map_rows(docs.select("doc_id", "text"), lambda rows: kernel.fingerprints(rows, width), _schema(docs))


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint"


def links(distinct: DataFrame, budget: int = 4, slice_at: int = SLICE_AT) -> DataFrame:
    """A spanning set (a, b) of the links between the distinct fingerprints in column fp.

    Buckets are block value and block number. One that holds more than slice_at and more than
    a 64th of all is dealt out: its fingerprints go to slices, and each pair of slices is a
    bucket of its own. At most 64 * (budget + 1) buckets can be so large, which bounds the
    list of them that is broadcast.
    """
    spark = distinct.sparkSession
    each = F.array(*[F.shiftleft(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")), 4).bitwiseOR(F.lit(k).cast("bigint")) for k, (at, bits) in enumerate(_blocks(budget + 1))])
    dealt = distinct.select("fp", F.explode(each).alias("bucket"))
    most = max(slice_at, distinct.count() // 64)
    large = dealt.groupBy("bucket").count().filter(F.col("count") > most).select("bucket", F.ceil(F.col("count") / most).cast("bigint").alias("n")).collect()
    if large:
        sizes = spark.createDataFrame(large, "bucket bigint, n bigint")
        own = F.pmod(F.xxhash64("fp"), F.col("n"))
        pair = lambda x: F.least(own, x) * F.col("n") + F.greatest(own, x)
        dealt = (
            dealt.join(F.broadcast(sizes), "bucket", "left")
            .withColumn("part", F.when(F.col("n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), pair)))
            .select("fp", F.explode("part").alias("part"), "bucket")
            .select("fp", F.xxhash64("bucket", "part").alias("bucket"))
        )
    grouped = dealt.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp")
    return grouped.mapInArrow(lambda batches: kernel.bucket_links(batches, budget), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text, ...); other columns are left aside.

    component_id is the least doc_id of all documents that can be reached over links of at
    most budget differing bits. Null and empty texts have fingerprint zero and are linked like
    any other; exact copies share a fingerprint and so cost one trie leaf. Rows with a null
    doc_id get a component but never name one. Repeated rows stay repeated. An empty table
    gives an empty table.
    """
    with scratch() as keep:
        marked, marked_at = settle(fingerprints(docs, width), "simhash")
        distinct, _ = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "simhash-distinct")
        roots = connected_components(links(distinct.select("fp"), budget))
        own = distinct.join(roots, distinct["fp"] == roots["node"])
        least = own.groupBy("root").agg(F.min("least").alias("component_id"))
        linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
        named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "_n")
        named, named_at = settle(named, "simhash-named")
        keep(marked_at, named_at)
    return join_hot(marked, named, "fp", "doc_id").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates of an earlier document: the least doc_id of each component stays.

    Of several rows with that same doc_id all stay; rows without a doc_id stay too.
    """
    found = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return same_columns(docs.join(found, "doc_id", "left_anti"), docs)
