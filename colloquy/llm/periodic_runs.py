"""Periodic runs of words: what a text says over and over in direct succession, and the text without it.

Texts of ordinary length are scanned for all lags by the task that reads them. Longer ones
are written out once and dealt to machines by ranges of lags, each of which is scanned alone;
a range knows the long runs of smaller periods that it needs from a scan of its own, whose
cost is linear in the text. Their runs meet again by row, not by doc_id.

Defined cases: a null or empty text has no words, no runs, and the digests of the empty
string; a null doc_id has no checksum, so its text is taken as it is; repeated rows each give
a row; columns beside doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs_kernel
from .common import map_rows, settle, ship
from .runs_kernel import endings, lag_ranges, whole_texts

ship(runs_kernel)

#: Characters from which a text's lags are dealt out in ranges, and the end of the first range; each further one is twice as long.
LONG, FIRST = 1 << 21, 1 << 10

OUT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def runs_of_texts(docs: DataFrame, long: int = LONG, first: int = FIRST) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), a row for each row of docs."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    is_long = F.coalesce(F.length("text") >= long, F.lit(False))
    short = map_rows(keyed.filter(~is_long), whole_texts, OUT)
    kept, _ = settle(keyed.filter(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    # a word takes two characters, but for the last, and a period at most half of the words
    steps = F.ceil(F.log2(F.greatest(F.length("text") / 4 / first, F.lit(1.0)))).cast("int")
    end = lambda k: F.call_function("shiftleft", F.lit(first), k)
    ranges = F.transform(F.sequence(F.lit(0), steps + 1), lambda k: F.struct(F.when(k == 0, 1).otherwise(end(k - 1)).alias("low"), end(k).alias("high")))
    dealt = kept.select("row", "text", "h", F.explode(ranges).alias("_r")).select("row", "text", "h", "_r.low", "_r.high").repartition("row", "low")
    found = map_rows(dealt, lag_ranges, "row bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    runs = found.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    ended = map_rows(kept.join(runs, "row", "left").select("doc_id", "text", "h", "runs"), endings, OUT)
    return short.unionByName(ended)


def query(docs: DataFrame) -> DataFrame:
    return runs_of_texts(docs)
