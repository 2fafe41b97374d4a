"""Removal of globally repeated multi-line chunks, with DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines tells whether a cut lies at the
second of them; the cut depends on those lines alone, so a passage is cut alike wherever it
stands. A chunk reaches from the lines that made one cut to the next cut, so neighbouring
chunks overlap and nothing that fixed a chunk lies outside it. Each of LEVELS such cuttings
sees the passages that another one misses. Chunk hashes are counted over the whole table;
those that occur twice or more name candidates, whose texts are compared byte by byte before
anything is removed. Only candidates' texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, likely, quoted, row_key, settle

#: One line in DIVISOR is no cut; cuttings; lines with a word that a chunk needs to count as a passage.
DIVISOR, LEVELS, MIN_LINES = 4, 2, 2


def _rotate(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _with_lines(docs: DataFrame, divisor: int, levels: int) -> DataFrame:
    """docs with _lines, their hashes _h, and _chunks: (start, end) of each chunk, by level, in lines."""
    lines = docs.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("_h", F.transform("_lines", lambda x: F.xxhash64(x)))
    n = F.size("_lines")
    inner = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    rolled = lambda i: F.get("_h", i - 1).bitwiseXOR(_rotate(F.get("_h", i - 2), 1))
    part = lambda i, k: F.shiftrightunsigned(rolled(i), 16 * k).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    cuts = lambda k: F.filter(inner, lambda i: part(i, k) % F.lit(divisor) != 0)
    lines = lines.withColumns({f"_c{k}": F.concat(F.array(F.lit(1)), cuts(k), F.array(n)) for k in range(levels)})

    def spans(name: str) -> Column:
        span = lambda c, j: F.struct(F.greatest(c - 2, F.lit(0)).alias("start"), F.get(name, j + 1).alias("end"))
        return F.transform(F.slice(name, F.lit(1), F.size(name) - 1), span)

    each = [spans(f"_c{k}") for k in range(levels)]
    chunks = F.when(n > 1, F.array_distinct(F.concat(*each))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return lines.withColumn("_chunks", chunks).drop(*[f"_c{k}" for k in range(levels)])


def _chunk_lines(c: Column, column: str = "_lines") -> Column:
    return F.slice(column, c["start"] + 1, c["end"] - c["start"])


def _text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _key(c: Column, bits: int) -> Column:
    whole = F.xxhash64(_chunk_lines(c, "_h"))
    return whole if bits >= 64 else whole.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _first() -> Column:
    """The least (doc_id, row key, chunk number); rows without a doc_id come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_key").alias("key"), F.col("idx").alias("idx"))).alias("first")


def _is_first() -> Column:
    return (F.col("first.key") == F.col("_key")) & (F.col("first.idx") == F.col("idx"))


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, levels: int = LEVELS, min_lines: int = MIN_LINES, hash_bits: int = 64) -> tuple[DataFrame, str]:
    """(_key, _marks), and where it is kept: for rows with a chunk whose hash occurs elsewhere too, those chunks as (idx, hash, first)."""
    cut = _with_lines(docs.select(row_key().alias("_key"), "doc_id", "text"), divisor, levels)
    cut = cut.withColumn("_w", F.transform("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    chunk = lambda c: F.struct(_key(c, hash_bits).alias("hash"), F.size(F.filter(_chunk_lines(c, "_w"), lambda w: w)).alias("n"))
    each = cut.select("_key", "doc_id", F.posexplode(F.transform("_chunks", chunk)).alias("idx", "chunk")).filter(F.col("chunk.n") >= min_lines)
    found, found_at = settle(each.select("_key", "doc_id", "idx", F.col("chunk.hash").alias("hash")), "line-chunks")
    often, often_at = settle(found.groupBy("hash").agg(F.count("*").alias("_n"), _first()).filter("_n > 1"), "line-chunks-often")
    marks = join_hot(found, often, "hash", "_key").groupBy("_key").agg(F.collect_set(F.struct("idx", "hash", _is_first().alias("first"))).alias("_marks"))
    kept = settle(marks, "line-marks")
    forget(found_at, often_at)
    return kept


def remove_repeats(
    docs: DataFrame, divisor: int = DIVISOR, levels: int = LEVELS, min_lines: int = MIN_LINES, hash_bits: int = 64
) -> DataFrame:
    """docs with the lines of repeated chunks cut out of text, and n_lines, n_removed_lines, n_removed_chunks.

    Of equal chunks with at least min_lines lines that hold a word, the one with the least
    (doc_id, text hash, chunk number) stays; every other goes, also within one text, and a line
    goes with any chunk that it is in. A chunk is never removed on account of a later one, so
    every removed line stays somewhere. A text that is nothing but repeats becomes empty; its
    row stays. Null texts stay null and count as one empty line; rows without a doc_id come
    after all others. Rows that repeat
    doc_id and text are cut alike. Very long texts take time in proportion to their lines.
    Columns of docs other than doc_id and text pass through, whatever their names; those named
    like the three counts are replaced. An empty table gives an empty table.
    hash_bits narrows the hash, to test what happens when different chunks collide.
    """
    counts = ("n_lines", "n_removed_lines", "n_removed_chunks")
    names = [c for c in docs.columns if c not in counts]
    rest = [c for c in names if c not in ("doc_id", "text")]
    # columns that pass through travel in one struct, where their names clash with nothing
    kept = docs.select(row_key().alias("_key"), "doc_id", "text", *([F.struct(*quoted(*rest)).alias("_rest")] if rest else []))
    marks, _ = repeated_chunks(docs, divisor, levels, min_lines, hash_bits)
    sifted = likely(kept, "_key", marks)
    candidates, _ = settle(sifted.filter("_likely").drop("_likely").join(marks, "_key", "left"), "line-candidates")
    cut = _with_lines(candidates, divisor, levels)
    own = F.filter("_marks", lambda m: _key(F.get("_chunks", m["idx"]), hash_bits) == m["hash"])  # row keys may collide
    cut = cut.withColumn("_marks", F.when(F.col("_marks").isNotNull(), F.coalesce(own, F.array().cast(cut.schema["_marks"].dataType))))
    none = F.array().cast("array<int>")
    by_bytes, _ = _by_bytes(cut)
    if by_bytes is None:
        drop = F.transform(F.filter("_marks", lambda m: ~m["first"]), lambda m: m["idx"])
        cut = cut.withColumn("_drop", F.coalesce(drop, none))
    else:
        cut = cut.join(by_bytes, "_key", "left")
        sure = F.array_except(F.transform(F.filter("_marks", lambda m: ~m["first"]), lambda m: m["idx"]), F.coalesce("_unsure", none))
        cut = cut.withColumn("_drop", F.concat(F.coalesce(sure, none), F.coalesce("_proved", none)))
    gone = F.array_distinct(F.flatten(F.transform("_drop", lambda k: F.sequence(F.get("_chunks", k)["start"], F.get("_chunks", k)["end"] - 1))))
    cut = cut.withColumn("_gone", gone)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i))
    cut = cut.withColumn("text", F.when(F.size("_gone") == 0, F.col("text")).when(F.col("text").isNotNull(), _text(left)))
    changed = cut.select("doc_id", "text", *(["_rest"] if rest else []), F.size("_lines").alias("n_lines"), F.size("_gone").alias("n_removed_lines"), F.size("_drop").alias("n_removed_chunks"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    same = sifted.filter("not _likely").select("doc_id", "text", *(["_rest"] if rest else []), F.coalesce(lines, F.lit(1)).alias("n_lines"), F.lit(0).alias("n_removed_lines"), F.lit(0).alias("n_removed_chunks"))
    back = [F.col("_rest").getField(c).alias(c) if c in rest else F.col(c) for c in names]
    return same.unionByName(changed).select(*back, *counts)


def _by_bytes(cut: DataFrame) -> tuple[DataFrame | None, str | None]:
    """Compare the bytes of all chunks that share a hash.

    None if every hash stands for one text, which is then proved for all of them. Otherwise,
    for rows with chunks whose hash stands for several texts: the chunk numbers in doubt,
    and those that do repeat an earlier chunk byte by byte.
    """
    marks = F.transform("_marks", lambda m: F.struct(m["hash"].alias("hash"), m["idx"].alias("idx"), _text(_chunk_lines(F.get("_chunks", m["idx"]))).alias("chunk")))
    each = cut.filter("_marks is not null").select("_key", "doc_id", F.explode(marks).alias("m")).select("_key", "doc_id", "m.hash", "m.idx", "m.chunk")
    mixed = each.select("hash", "chunk").distinct().groupBy("hash").count().filter("count > 1").select("hash")
    if mixed.isEmpty():
        return None, None
    unsure = each.join(mixed, "hash", "left_semi")
    classes = unsure.groupBy("hash", "chunk").agg(_first())
    proved = unsure.join(classes, ["hash", "chunk"])
    return settle(proved.groupBy("_key").agg(F.collect_set("idx").alias("_unsure"), F.collect_set(F.when(~_is_first(), F.col("idx"))).alias("_proved")), "line-proved")


def query(docs: DataFrame) -> DataFrame:
    """Every document with what is left of it."""
    return remove_repeats(docs.select("doc_id", "text"))
