"""Near-dedup of the pipeline: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

SimHash fingerprints of the shingles are linked by the trie of `simhash_trie`, and documents meet
in the bucket of their fingerprints' component. At this similarity about ten of 64 bits differ,
beyond what a trie can search, so min-hash bands name further buckets. Every pair of a bucket
that is not linked yet is compared by its whole shingle sets, so no link rests on an estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_kernel as kernel
from . import simhash_trie
from .common import join_hot, likely, map_rows, row_key, same_columns, scratch, settle, ship
from .components import connected_components

ship(kernel)

#: Words of a shingle, and the least similarity of a link.
WIDTH, SIMILARITY = 5, 0.8

#: A pair meets if one of BANDS bands of ROWS least values agrees: all but 4 of 10 million pairs at similarity 0.8.
ROWS, BANDS = 4, 28

#: A bucket with more sets than this is dealt out in slices that meet pairwise.
SLICE_AT = 1024


def _fingerprint_bands(rows: DataFrame, sketched: DataFrame, width: int) -> DataFrame:
    """(digest, band): a band for each component of fingerprints that the trie links."""
    linked = simhash_trie.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), width).select(F.col("doc_id").alias("key"), "component_id").distinct()
    return sketched.select("key", "digest").distinct().join(linked, "key").select("digest", F.xxhash64(F.lit("simhash"), "component_id").alias("band")).distinct()


def _buckets(distinct: DataFrame, linked: DataFrame, slice_at: int) -> DataFrame:
    """(bucket, digest) of the buckets with two sets or more, one bucket for each group of members."""
    each = distinct.select("digest", F.explode("bands").alias("band")).unionByName(linked)
    mark = F.xxhash64("digest")
    sized = each.groupBy("band").agg(F.count("*").alias("_n"), F.bit_xor("digest").alias("x"), F.bit_xor(mark).alias("y")).filter("_n > 1")
    groups, _ = settle(sized.groupBy("_n", "x", "y").agg(F.min("band").alias("band")).select("band", "_n", F.ceil(F.col("_n") / slice_at).cast("bigint").alias("n")), "shingle-groups")
    own = F.pmod(mark, F.col("n"))
    pair = lambda k: F.least(own, k) * F.col("n") + F.greatest(own, k)
    met = join_hot(each, groups, "band", "digest")
    return met.select("digest", "band", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), pair)).alias("part")).select(F.xxhash64("band", "part").alias("bucket"), "digest")


def components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, slice_at: int = SLICE_AT, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(key, digest) of every row, and (digest, keep, _n) of every distinct shingle set.

    keep is the key of the row that stays for the whole component, the one with the least
    doc_id (rows without one come last); key is a hash of doc_id and text.
    """
    with scratch() as keep_folders:
        rows = docs.select(row_key().alias("key"), "doc_id", "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        sketched = map_rows(rows, lambda r: kernel.sketches(r, width, ROWS, bands), f"key bigint, doc_id {kind}, digest bigint, bands array<bigint>")
        sketched, sketched_at = settle(sketched, "shingle-sketches")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
        sized = sketched.groupBy("digest").agg(F.count("*").alias("_n"), F.first("bands").alias("bands"), F.min(order).alias("first"))
        distinct, _ = settle(sized, "shingle-distinct")
        linked, _ = settle(_fingerprint_bands(rows, sketched, width), "shingle-fingerprints")
        met, _ = settle(_buckets(distinct, linked, slice_at), "shingle-buckets")
        needed = distinct.join(met.select("digest").distinct(), "digest", "left_semi").select("digest", F.col("first.key").alias("key"))
        texts = rows.select("key", "text").join(needed, "key").select("digest", "text")
        sets, _ = settle(map_rows(texts, lambda r: kernel.sets(r, width), "digest bigint, shingles array<bigint>").dropDuplicates(["digest"]), "shingle-sets")
        dealt = met.join(sets, "digest").select("bucket", "digest", "shingles").repartition("bucket").sortWithinPartitions("bucket")
        roots = connected_components(dealt.mapInArrow(lambda batches: kernel.bucket_links(batches, similarity), "a bigint, b bigint"))
        named = distinct.select("digest", "_n", "first").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        named = named.withColumn("root", F.coalesce("root", "digest"))
        keep = named.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("_n"))
        named, named_at = settle(join_hot(named.select("root", "digest", F.col("_n").alias("rows")), keep, "root", "digest").select("digest", F.col("keep.key").alias("keep"), F.col("rows").alias("_n")), "shingle-named")
        keep_folders(sketched_at, named_at)
    return sketched.select("key", "digest"), named


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, slice_at: int = SLICE_AT) -> DataFrame:
    """docs with one row of each component: the least doc_id, rows without one last.

    Rows are told apart by doc_id and text, so an id that stands for several texts goes or
    stays with each text by itself; of rows that share both, one stays. Texts without a
    word are copies of one another.
    """
    with scratch() as keep_folders:
        rows, named = components(docs, width, similarity, slice_at)
        sized = join_hot(rows, named, "digest", "key").groupBy("key").agg(F.count("*").alias("rows"), F.first(F.col("key") == F.col("keep")).alias("stays"))
        judged, judged_at = settle(sized.filter("rows > 1 or not stays"), "shingle-judged")
        keep_folders(judged_at)
    sifted = likely(docs.withColumn("_row_key", row_key()), "_row_key", judged.select(F.col("key").alias("_row_key")))
    doubtful = sifted.filter("_likely").join(judged.withColumnRenamed("key", "_row_key"), "_row_key", "left")
    single, again = doubtful.filter("stays is null"), doubtful.filter("stays").dropDuplicates(["_row_key"])
    return same_columns(sifted.filter("not _likely"), docs).unionByName(same_columns(single.unionByName(again), docs))
