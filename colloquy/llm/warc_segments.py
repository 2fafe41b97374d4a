"""WARC archives: writing pages with revisit records, and reading archives with segment reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc_kernel as kernel
from .common import fresh_path, join_hot, likely, map_rows, scratch, settle, ship

ship(kernel)

#: Bytes of a record's block, and of an HTTP chunk; records in one archive file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 1 << 15, 1 << 13, 4096

#: Payloads of so many bytes are written once; their copies become revisit records.
REVISIT_BYTES = 100


def _key(page_id: str = "page_id", digest: str = "digest"):
    return F.xxhash64(F.col(page_id).isNull(), page_id, digest)


def write_archive(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS
) -> None:
    """Write a record for each row of pages(page_id, url, html, ...) to WARC files in path, each record a gzip member.

    Of rows with equal payloads of at least REVISIT_BYTES, those with the least page_id are
    responses, the others revisits; rows without a page_id revisit any that has one. page_id
    may have any type that a cast to text keeps apart. Null html is an empty payload. A
    revisit names its response's record id unless several rows may have that page_id and
    payload.

    Revisits are made from ids and digests. Of the others, almost all are written by the task
    that reads them: a row's html is shuffled only where bounded filters leave open which of
    the two it is.
    """
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("key", _key())
    columns = ["page_id", "url", "html", "digest", "bytes", "key", "refers_to", "target"]
    with scratch():
        ids, _ = settle(page.select("page_id", "url", "digest", "key", F.octet_length("html").cast("bigint").alias("bytes")), "warc-ids")
        repeated, _ = settle(ids.groupBy("key").count().filter("count > 1").select("key"), "warc-repeated")
        large = ids.filter(F.col("bytes") >= REVISIT_BYTES)
        first = large.groupBy("digest").agg(F.count("*").alias("_n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
        first, _ = settle(first.filter("_n > 1 and first is not null"), "warc-first")
        again = join_hot(large, first, "digest", "key").filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        again, _ = settle(again.select("page_id", "url", "digest", "bytes", "key", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("target")), "warc-again")
        twice = first.select(F.xxhash64("digest").alias("h"))
        maybe = lambda df: likely(df.withColumn("h", F.xxhash64("digest")), "h", twice).withColumnRenamed("_likely", "_twice")
        # digests that the filter marks though they occur once, and the responses among those that occur again
        single = maybe(ids).filter("_twice").join(first.select("digest"), "digest", "left_anti").select("key")
        heads = first.select(_key("first.page_id", "digest").alias("key"))
        open_keys, _ = settle(single.unionByName(heads), "warc-open")
        told = likely(maybe(page).withColumn("bytes", F.octet_length("html").cast("bigint")), "key", open_keys)
        none = lambda kind: F.lit(None).cast(kind)
        settled = told.filter("not _twice").select(*columns[:6])
        unsure = told.filter("_twice and _likely").select(*columns[:6])
        revisits = likely(again, "key", open_keys).filter("_likely").select(F.col("key").alias("k"), F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct()
        kept = unsure.join(revisits, (unsure["key"] == revisits["k"]) & (unsure["digest"] == revisits["d"]) & unsure["page_id"].eqNullSafe(revisits["p"]), "left_anti")
        id_type = page.schema["page_id"].dataType
        responses = settled.unionByName(kept).withColumn("refers_to", none(id_type)).withColumn("target", none("string"))
        rows = responses.unionByName(again.withColumn("html", none("string")).select(*columns))
        alone = likely(rows, "key", repeated).withColumn("alone", ~F.col("_likely")).drop("_likely").withColumn("other", _key("refers_to", "digest"))
        alone = likely(alone, "other", repeated.withColumnRenamed("key", "other")).withColumn("other_alone", ~F.col("_likely"))
        text = lambda c: F.col(c).cast("string")
        final = alone.select(text("page_id"), "url", "html", "digest", "bytes", "alone", text("refers_to"), "target", "other_alone")
        records = map_rows(final, lambda it: kernel.write(it, path, segment_bytes, chunk_bytes), "record binary")
        records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", file_records).text(path)


def read_archive(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, error) for each captured page.

    Continuation records are grouped by their origin and put in order. Missing or doubled
    segments, a total length that differs, broken chunk framing, a wrong digest and records
    that cannot be read are rows with an error, and null where nothing is known; so is an id
    that is no `id_type`. Only records written in segments move their bytes between tasks,
    unless payloads are asked for; payload is null otherwise, and empty for revisits.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "origin string, number int, total bigint, kind string, page string, url string, declared string, refers string, n bigint, digest string, block binary, error string"
    parts = map_rows(files, lambda it: kernel.read(it, payloads), schema)
    one = lambda c: F.max(c).alias(c)  # noqa: E731  only an origin's first segment has it
    whole = parts.groupBy("origin").agg(
        *[one(c) for c in ("kind", "page", "url", "declared", "refers", "n", "digest", "error")],
        F.array_sort(F.collect_list(F.struct("number", "total", "block"))).alias("segments"),
    )
    out = "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers string, payload binary, error string"
    rows = map_rows(whole.drop("origin"), lambda it: kernel.assemble(it, payloads), out)
    typed = lambda c: F.expr(f"try_cast({c} AS {id_type})")
    lost = F.concat(F.lit("id is no "), F.lit(id_type), F.lit(": "), F.coalesce("page", "refers"))
    broken = (F.col("page").isNotNull() & typed("page").isNull()) | (F.col("refers").isNotNull() & typed("refers").isNull())
    return rows.select(
        typed("page").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", typed("refers").alias("refers_to"), "payload",
        F.coalesce("error", F.when(broken, lost)).alias("error"),
    )


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archive(spark, path, id_type=kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
