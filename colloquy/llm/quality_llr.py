"""Quality rules with a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and word pairs are hashed into buckets. A text scores the mean, over its n-grams, of the
log ratio between their probability among trusted documents and in the whole corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, likely, scratch, settle

#: Buckets of the multinomials, and the pseudo-count of each.
BUCKETS, SMOOTHING = 1 << 14, 1.0

#: Width of the score bins in which the threshold is sought.
BIN = 0.001


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float


def _words(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+", -1))


def _next(column: str) -> Column:
    """The array without its first element."""
    return F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0)))


def _pairs(left: str, right: Column, n: Column) -> Column:
    """Hashes of neighbouring elements, n of them."""
    return F.zip_with(F.slice(left, 1, F.greatest(n, F.lit(0))), right, lambda a, b: F.xxhash64(a, b))


def _with_grams(docs: DataFrame) -> DataFrame:
    """docs with _words, _one and _two: hashes of words and of word pairs."""
    hashed = docs.withColumn("_words", _words(F.col("text"))).withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("_two", _pairs("_one", _next("_one"), F.size("_one") - 1))


def _counts(docs: DataFrame, buckets: int) -> dict[int, int]:
    """Occurrences by bucket over all of docs: at most `buckets` numbers, summed before and after the shuffle."""
    each = _with_grams(docs.select("text")).select(F.explode(F.concat("_one", "_two")).alias("h"))
    counted = each.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return {r[0]: r[1] for r in counted.collect()}


def _raw_and_trusted(docs: DataFrame, trusted: DataFrame, buckets: int) -> tuple[dict[int, int], dict[int, int]]:
    """Occurrences by bucket over all of docs, and over rows whose doc_id is among the distinct ones of trusted.

    Texts are not shuffled to tell these rows: a filter marks them while all are counted, and
    what it marked without cause is counted by itself and taken off again.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_key"))
    marked = likely(keyed, "_key", trusted.select(F.xxhash64("doc_id").alias("_key")))
    marked = marked.select("doc_id", "text", (F.col("_likely") & F.col("doc_id").isNotNull()).alias("_in"))
    each = _with_grams(marked.select("text", "_in")).select("_in", F.explode(F.concat("_one", "_two")).alias("h"))
    both = each.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.count_if("_in").alias("hits"))
    counted = both.collect()
    wrong, _ = settle(marked.filter("_in").select("doc_id").join(trusted, "doc_id", "left_anti").distinct(), "quality-wrong")
    again = likely(marked.filter("_in").withColumn("_key", F.xxhash64("doc_id")), "_key", wrong.select(F.xxhash64("doc_id").alias("_key")))
    less = _counts(again.filter("_likely").join(wrong, "doc_id").select("text"), buckets)
    target = {r[0]: r[2] - less.get(r[0], 0) for r in counted}
    return {r[0]: r[1] for r in counted}, {b: n for b, n in target.items() if n}


def _llr(weights: tuple[float, ...]) -> Column:
    """Mean weight of the n-grams of a text; 0 for texts without words. Weights fold to one literal."""
    table = F.split(F.lit(",".join(f"{w:.4f}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(F.concat("_one", "_two"), F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(len(weights))).cast("int")))
    n = F.size("_one") + F.size("_two")
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int | None = None) -> Model:
    """Weights from all of docs against all trusted labelled ones, and the threshold.

    The threshold is set on half of all labelled documents, or with `sample` of so many whose ids
    hash lowest, with a target that has not seen their n-grams; they are added to it afterwards.
    It is the middle of the score bins that tell good from bad labelled documents best (share of good ones kept plus share of bad ones dropped). Without both kinds it lies
    below every score. Null labels and labels without a document are left aside; a label that is
    given twice counts once.
    """
    usable = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").distinct()
    chosen = usable if sample is None else usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    key = F.xxhash64("doc_id").alias("_key")
    with scratch():
        held, _ = settle(chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 1), "quality-held")
        near = likely(docs.select("doc_id", "text", key), "_key", held.select(key)).filter("_likely")
        labelled, _ = settle(near.join(held, "doc_id").select("text", "quality"), "quality-labelled")
        trusted, _ = settle(usable.filter("quality = 1").join(held.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id"), "quality-trusted")
        raw, target = _raw_and_trusted(docs, trusted, buckets)
        later = _counts(labelled.filter("quality = 1"), buckets)
        whole = {b: target.get(b, 0) + later.get(b, 0) for b in target.keys() | later.keys()}
        if not target:
            return Model(_weights(raw, whole, buckets) if whole else (0.0,) * buckets, -math.inf)
        weights = _weights(raw, target, buckets)
        unseen = labelled.withColumn("doc_id", F.lit(None).cast("bigint"))
        scored = assess(unseen, Model(weights, -math.inf), "quality").filter("not base_failed")
        bins = scored.groupBy(F.floor(F.col("llr") / BIN).alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
        return Model(_weights(raw, whole, buckets), _threshold(sorted(tuple(r) for r in bins.collect())))


def _weights(raw: dict[int, int], target: dict[int, int], buckets: int) -> tuple[float, ...]:
    all_raw, all_target = (sum(c.values()) + SMOOTHING * buckets for c in (raw, target))
    return tuple(math.log((target.get(b, 0) + SMOOTHING) / all_target) - math.log((raw.get(b, 0) + SMOOTHING) / all_raw) for b in range(buckets))


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return -math.inf
    best, first, last, dropped_good, dropped_bad = 1.0, None, None, 0, 0
    for k, (at, g, b) in enumerate(bins):
        dropped_good, dropped_bad = dropped_good + g, dropped_bad + b
        gain = (good - dropped_good) / good + dropped_bad / bad
        upto = bins[k + 1][0] if k + 1 < len(bins) else at + 1
        if gain > best:
            best, first = gain, at + 1
        if gain == best and first is not None:
            last = upto
    return -math.inf if first is None else (first + last) / 2 * BIN


def assess(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Counters, LLR and verdict for every row of docs(doc_id, text, ...); `keep` names columns to pass on.

    Null and empty texts have no words, one line without a word, LLR 0, and fail the base
    rules. Three-word windows are compared by 64-bit hash within one text. Repeated rows are
    judged one by one; an empty table gives an empty table.
    """
    words = _with_grams(docs.select("doc_id", "text", *keep))
    windows = words.withColumn("_three", _pairs("_two", F.slice("_one", 3, F.greatest(F.size("_one") - 2, F.lit(0))), F.size("_two") - 1))
    numbered = F.arrays_zip(F.col("_three").alias("h"), F.sequence(F.lit(0), F.size("_three") - 1).alias("at"))
    repeats = F.size("_three") > F.size(F.array_distinct("_three"))
    ordered = windows.withColumn("_sorted", F.when(repeats, F.sort_array(numbered)))
    twice = lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"])
    hit = ordered.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["at"]))))
    gaps = F.zip_with(F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), _next("_at"), lambda a, b: F.least(b - a, F.lit(3)))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = F.struct(
        "doc_id", *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_at") > 0, F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g)).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        _llr(model.weights).alias("llr"),
    )
    # a generator, so that a filter on the verdict is not pushed down into the array expressions
    counted = hit.select(F.explode(F.array(one)).alias("one")).select("one.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True) if model.threshold == -math.inf else F.col("llr") >= model.threshold
    return counted.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"), "llr",
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(docs, fit(docs, labels))
