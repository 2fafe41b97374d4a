"""Turn pairing, reply classes and what is counted over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.lexicon import DETECTOR, MINING, SOUNDS_APPROVAL, Lexicon

CLASSES = ("approval", "explicit_pushback", "implicit_pushback", "neutral")


#: Rows of a session that one window takes at most, where the order is a whole number.
SLAB = 1 << 20


def turn_pairs(turns: DataFrame, session: Sequence[str], order: str, wake_prefixes: Sequence[str] = (), *carry: str, slab: int = SLAB) -> DataFrame:
    """(session..., order, assistant, reply): each user text with the last assistant text since the user row before it.

    turns has role, text, the session columns and the order. Any user row, even one without
    text or an automated one, uses up what the assistant said. Where a whole-number order
    reaches `slab`, sessions are cut there, and what waits at a slab's end is handed on, so no
    session is sorted by one task.
    """
    whole = turns.schema[order].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and not turns.filter(F.col(order) >= slab).isEmpty():
        paired = _by_slabs(turns, session, order, slab)
    else:
        paired = _in_windows(turns, session, order)
    kept = paired.filter((F.col("role") == "user") & F.col("assistant").isNotNull() & ~text.is_auto_wake(F.col("text"), wake_prefixes))
    return kept.select(*session, order, "assistant", F.col("text").alias("reply"), *carry)


def _said() -> Column:
    return (F.col("role") == "assistant") & (F.col("text") != "")


def _in_windows(turns: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """turns with _group, the number of user rows before, and assistant, what was said last in the group."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grouped = turns.withColumn("_group", F.coalesce(F.count_if(F.col("role") == "user").over(before), F.lit(0)))
    return grouped.withColumn("assistant", F.last(F.when(_said(), F.col("text")), ignorenulls=True).over(inside))


def _by_slabs(turns: DataFrame, session: Sequence[str], order: str, slab: int) -> DataFrame:
    cut = turns.withColumn("_slab", F.call_function("div", F.col(order).cast("bigint"), F.lit(slab).cast("bigint")))
    own = _in_windows(cut, [*session, "_slab"], order)
    keys = [F.col(s).alias(f"_s{i}") for i, s in enumerate(session)]
    names = [f"_s{i}" for i in range(len(session))]
    ends = cut.groupBy(*keys, F.col("_slab").alias("_of")).agg(
        F.max(F.when(F.col("role") == "user", F.col(order))).alias("_user"), F.max(F.when(_said(), F.struct(F.col(order).alias("at"), "text"))).alias("_last"),
    )
    waits = F.when(F.col("_last").isNotNull() & (F.col("_user").isNull() | (F.col("_last.at") > F.col("_user"))), F.struct(F.col("_last.text").alias("text")))
    waits = waits.when(F.col("_user").isNotNull(), F.struct(F.lit(None).cast("string").alias("text")))  # a slab without either hands on what it was given
    over = Window.partitionBy(*names).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row a slab
    given = ends.withColumn("_w", waits).withColumn("_given", F.last("_w", ignorenulls=True).over(over)["text"]).filter("_given is not null").select(*names, "_of", "_given")
    same = F.col("_slab") == F.col("_of")
    for s, n in zip(session, names, strict=True):
        same = same & F.col(s).eqNullSafe(F.col(n))
    joined = own.join(given, same, "left")
    return joined.withColumn("assistant", F.coalesce("assistant", F.when(F.col("_group") == 0, F.col("_given"))))


def approved_median(pairs: DataFrame, lexicon: Lexicon = MINING) -> DataFrame:
    """One row, `anchor`: the median length of approvals, or half of all replies' median where there are none."""
    approval = text.first_word(F.col("reply")).isin(*lexicon.approval)
    found = pairs.agg(stats.percentile(F.length("reply"), 0.5, approval).alias("own"), stats.percentile(F.length("reply"), 0.5).alias("every"))
    return found.select(F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("every") / 2).alias("anchor"))


def reply_class(reply: Column, anchor: Column, lexicon: Lexicon = MINING) -> Column:
    word, n = text.first_word(reply), F.length(reply)
    implicit = (anchor > 0) & (n >= 2 * anchor) & text.has_marker(reply, lexicon.markers)
    return (
        F.when(word.isin(*lexicon.approval), "approval")
        .when(word.isin(*lexicon.pushback), "explicit_pushback")
        .when(implicit, "implicit_pushback")
        .otherwise("neutral")
    )


def classified(pairs: DataFrame, lexicon: Lexicon = MINING) -> DataFrame:
    """pairs with class, word and chars; the anchor is a one-row broadcast."""
    anchored = pairs.crossJoin(F.broadcast(approved_median(pairs, lexicon)))
    own = reply_class(F.col("reply"), F.col("anchor"), lexicon)
    return anchored.withColumn("class", own).withColumn("word", text.first_word(F.col("reply"))).withColumn("chars", F.length("reply").cast("bigint")).drop("anchor")


def class_summary(replies: DataFrame) -> DataFrame:
    return replies.groupBy("class").agg(
        F.count("*").alias("n"), stats.percentile(F.col("chars"), 0.5).alias("median_chars"), stats.percentile(F.col("chars"), 0.9).alias("p90_chars")
    )


def length_ratio(replies: DataFrame) -> DataFrame:
    """One row: the median lengths of approvals and of both pushback classes together, and their ratio; null without approvals."""
    pushback = F.col("class").isin("explicit_pushback", "implicit_pushback")
    found = replies.agg(
        stats.percentile(F.col("chars"), 0.5, F.col("class") == "approval").alias("approval_median"),
        stats.percentile(F.col("chars"), 0.5, pushback).alias("pushback_median"),
    )
    return found.withColumn("ratio", F.round(F.try_divide("pushback_median", "approval_median"), 6))


def top_words(replies: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent first words of each class; ties by word."""
    counted = replies.filter("word is not null").groupBy("class", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def longest_quotes(replies: DataFrame, k: int = 10, preview: int = 500) -> DataFrame:
    chosen = replies.filter(F.col("class").isin("explicit_pushback", "implicit_pushback"))
    return chosen.orderBy(F.desc("chars"), F.desc("reply")).limit(k).select("class", "chars", F.substring("reply", 1, preview).alias("preview"))


def detect(reply: Column, anchor: Column, lexicon: Lexicon = DETECTOR) -> Column:
    """Struct of class and confidence, by the incremental detector's rules."""
    word, n = text.first_word(reply), F.length(reply)
    implicit = (anchor > 0) & (n >= 2 * anchor) & text.has_marker(reply, lexicon.markers)
    grown = F.lit(0.4) + F.lit(0.5) * F.least(n / (anchor * 4), F.lit(1.0))
    name = lambda x: F.lit(x).alias("class")
    level = lambda x: (x if isinstance(x, Column) else F.lit(x)).alias("confidence")
    return (
        F.when(word.isin(*lexicon.pushback), F.struct(name("explicit_pushback"), level(0.9)))
        .when(word.isin(*lexicon.approval), F.struct(name("approval"), level(0.95)))
        .when((word == "sounds") & reply.rlike(SOUNDS_APPROVAL), F.struct(name("approval"), level(0.9)))
        .when(implicit, F.struct(name("implicit_pushback"), level(grown)))
        .otherwise(F.struct(name("neutral"), level(0.0)))
    )
