"""Repeated passages by a sparse suffix array over words.

Only suffixes at content-selected minimiser positions are kept: the anchor of any `least`
words lies within their first `window` positions, so equal passages share a suffix whose first
`prefix` words agree. Suffixes whose prefix hash occurs once are dropped; the others are
range-sorted by prefix hash and the words around, and each is compared with its neighbours,
extending the match to the left and right. Where a neighbour that shares only one side stands
between two that share a passage, the passage's own hash brings them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_kernel as kernel
from .common import forget, join_hot, map_rows, quoted, settle, ship

ship(kernel)

#: Words of a passage, of a gram, and grams of a minimiser window.
LEAST, GRAM, WINDOW = 50, 5, 32


def _spans(docs: DataFrame, least: int, gram: int, window: int) -> DataFrame:
    """(doc_id, mark, start_word, end_word, first_doc_id); mark is a hash of the text."""
    prefix = least - window + 1
    if prefix < gram or window > 4 * kernel.BLOCK:
        raise ValueError(f"least must be at least window + gram - 1 words, and window at most {4 * kernel.BLOCK}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").filter("doc_id is not null")
    found = map_rows(rows, lambda it: kernel.suffixes(it, gram, window, least), f"key bigint, doc_id {kind}, mark bigint, pos int, low int, high int")
    every, kept_at = settle(found, "suffixes")
    counted = every.groupBy("key").agg(F.count("*").alias("_n"), F.min("doc_id").alias("first")).filter("_n > 1")
    often, often_at = settle(counted.withColumn("n", F.col("_n")), "suffixes-often")
    place = F.struct("pos", "low", "high", "key", "n", "first")
    places = join_hot(every, often, "key", "doc_id").groupBy("doc_id", "mark").agg(F.collect_set(place).alias("places"))
    texts = rows.join(places, ["doc_id", "mark"]).select("doc_id", "mark", "text", "places")
    order = ("key", "following", "preceding", "doc_id", "mark", "pos")
    schema = f"key bigint, following bigint, preceding bigint, doc_id {kind}, mark bigint, pos int, low int, high int, n bigint, first {kind}, after binary, before binary"
    around, around_at = settle(map_rows(texts, lambda it: kernel.contexts(it, window, least), schema), "suffix-contexts")
    forget(kept_at, often_at)
    ranged = around.repartitionByRange(*order).sortWithinPartitions(*order)
    out = f"passage binary, doc_id {kind}, mark bigint, start int, `end` int, first {kind}"
    shared, shared_at = settle(map_rows(ranged, lambda it: kernel.neighbours(it, window, least), out), "suffix-spans")
    forget(around_at)
    at = F.struct("doc_id", "mark", "start")
    single = shared.filter("passage is not null")
    equal = single.groupBy("passage").agg(F.count("*").alias("_n"), F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b").select("passage", "_n")
    equal, equal_at = settle(equal, "suffix-passages")
    whole = shared.filter("passage is null").drop("passage").unionByName(join_hot(single, equal, "passage", "doc_id").drop("passage"))
    grouped = whole.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end", "first")).alias("spans"))
    merged, _ = settle(map_rows(grouped, kernel.merge, f"doc_id {kind}, mark bigint, start_word int, end_word int, first_doc_id {kind}"), "suffix-merged")
    forget(shared_at, equal_at)
    return merged


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id) for every maximal span of repeated passages.

    A passage is `least` words that occur at two places or more, in other documents or in the
    same one, overlapping or not; a span is a union of passages that overlap or touch, and all
    passages are in one. Words are runs of characters other than ASCII white space; positions
    count words, end exclusive. first_doc_id is the least doc_id in which the first words of a
    suffix of the span occur. Exact copies cost one comparison each, never pairs. Null, empty
    and short texts have no spans. Rows without a doc_id are left aside; rows that repeat doc_id
    and text count as one, and texts that share a doc_id have their spans listed together.
    Other columns of docs, whatever their names, are left aside. An empty table gives an empty
    table.
    """
    found = _spans(docs, least, gram, window)
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of text but for their first place, and n_removed_words.

    Of equal passages the one with the least (doc_id, text hash, start) stays, with every word
    in it, also where another passage overlaps it; so each passage is found once in the result,
    or more often where a cut makes it anew. White space behind a cut word goes with it. Null
    texts and rows without a doc_id stay as they are; rows that repeat doc_id and text are all
    cut alike. Columns pass through; one named n_removed_words is replaced.
    """
    names = [c for c in docs.columns if c != "n_removed_words"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = _spans(docs, least, gram, window).groupBy("doc_id", "mark").agg(F.collect_list(F.struct(F.col("start_word").alias("start"), F.col("end_word").alias("end"))).alias("spans"))
    spans, spans_at = settle(spans, "suffix-cuts")
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(spans, ["doc_id", "mark"]).select("doc_id", "mark", "text", "spans")
    each = map_rows(texts, lambda it: kernel.passages(it, least), f"passage binary, doc_id {kind}, mark bigint, start int")
    firsts = each.groupBy("passage").agg(F.min(F.struct("doc_id", "mark", "start")).alias("at")).select("at.*")
    kept = firsts.groupBy("doc_id", "mark").agg(F.collect_list("start").alias("kept"))
    plan, _ = settle(spans.join(kept, ["doc_id", "mark"], "left").select(F.struct("doc_id", "mark").alias("_at"), "spans", "kept"), "suffix-plan")
    forget(spans_at)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may clash, or hold dots
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    marked = plain.withColumn("_at", F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"))).join(plan, "_at", "left").drop("_at")
    done = marked.filter("spans is null").drop("spans", "kept").withColumn("n_removed_words", F.lit(0))
    where = plain.columns.index(text)

    def run(rows):
        for row in rows:
            *own, places, stay = row
            own[where], removed = kernel.cut(own[where], places, stay, least)
            yield *own, removed

    schema = done.schema
    left = map_rows(marked.filter("spans is not null"), run, schema)
    whole = done.unionByName(left)
    return whole.toDF(*docs.columns, "_removed").select(*quoted(*names), F.col("_removed").alias("n_removed_words"))


def query(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs)
