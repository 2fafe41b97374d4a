"""Prompt statistics: lengths, shares, vocabulary, languages, commands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.lexicon import LANGUAGE_MARKERS, SLASH_COMMANDS, STOPWORDS, Lexicon
from ..storage import settle

#: Buckets by which pairs of words are counted first, and how many of the largest are tried for each pair that is asked for.
BUCKETS, TRIED = 1 << 18, 4

ALL_STOPWORDS = tuple(dict.fromkeys(w for words in STOPWORDS.values() for w in words))


def length_stats(df: DataFrame, column: str = "text") -> DataFrame:
    n = F.length(column)
    return df.agg(
        F.count("*").alias("n"),
        stats.mean(F.sum(n), F.count(n)).alias("mean_chars"),
        stats.percentile(n, 0.5).alias("median_chars"),
        stats.percentile(n, 0.9).alias("p90_chars"),
        F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max_chars"),
    )


def group_share(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Rows and share of each of the k largest groups; ties by key. The total is summed from group counts."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    shared = counted.crossJoin(F.broadcast(total)).select(key, "n", stats.share(F.col("n"), F.col("total")).alias("share_pct"))
    return shared.orderBy(F.desc("n"), key).limit(k)


def top_k(df: DataFrame, items: Column, name: str, k: int) -> DataFrame:
    """The k most frequent elements of an array column, nulls left out; ties by element.

    The outer form makes each array once; for the other one Spark makes it a second time, to see whether it is empty.
    """
    counted = df.select(F.explode_outer(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counted.filter(F.col(name).isNotNull()).orderBy(F.desc("n"), name).limit(k)


def top_k_first_seen(df: DataFrame, items: Column, name: str, k: int, *order: str) -> DataFrame:
    """The k most frequent elements; ties go to the one that occurs first in the given row order."""
    each = df.select(*order, F.posexplode(items).alias("_at", name))
    counted = each.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct(*order, "_at")).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def content_words(column: str = "text", stop: Sequence[str] = ALL_STOPWORDS) -> Column:
    return text.without(text.tokens(F.col(column)), stop)


def top_unigrams(df: DataFrame, k: int = 50, stop: Sequence[str] = ALL_STOPWORDS) -> DataFrame:
    return top_k(df, content_words(stop=stop), "word", k)


def _neighbours(df: DataFrame, stop: Sequence[str]) -> DataFrame:
    """(word, before, bucket): each content word, the one before it in its text, and the bucket of the two; a row of nulls for a text without any."""
    words = df.select(content_words(stop=stop).alias("_w"))
    each = words.select("_w", F.posexplode_outer("_w").alias("_at", "word")).select("word", F.get("_w", F.col("_at") - 1).alias("before"))
    return each.withColumn("bucket", F.when(F.col("before").isNotNull(), F.pmod(F.xxhash64("before", "word"), F.lit(BUCKETS))))


def word_counts(df: DataFrame, stop: Sequence[str] = ALL_STOPWORDS) -> DataFrame:
    """(word, bucket, n), written once: how often each content word occurs, and each bucket of neighbours, the other one null. Texts are cut once for both."""
    counted = _neighbours(df, stop).groupingSets([["word"], ["bucket"]], "word", "bucket").agg(F.count("*").alias("n"))
    return settle(counted.filter("word is not null or bucket is not null"), "words")


def top_counted_words(counted: DataFrame, k: int = 50) -> DataFrame:
    """top_unigrams from word_counts."""
    return counted.filter("word is not null").select("word", "n").orderBy(F.desc("n"), "word").limit(k)


def top_bigrams(df: DataFrame, k: int = 50, stop: Sequence[str] = ALL_STOPWORDS, counted: DataFrame | None = None) -> DataFrame:
    """The k most frequent pairs that are neighbours once stop words are gone, within one text; ties by pair.

    Most pairs occur once or twice, so they are not shuffled one by one: a pair occurs at most as
    often as its bucket, and pairs are counted in the largest buckets only. If the k-th of them does
    not exceed each bucket left out, they are counted again in all buckets that reach it, be it all.
    `counted` is word_counts of the same texts and stop words, where it is there already.
    """
    each = _neighbours(df, stop)
    if counted is None:
        counted = settle(each.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    buckets = counted.filter("bucket is not null").select("bucket", "n")

    def top(above: int) -> list:
        """The k most frequent pairs of the buckets with more than `above` rows."""
        pairs = each.join(F.broadcast(buckets.filter(F.col("n") > above).select("bucket")), "bucket")
        return pairs.groupBy(F.concat("before", F.lit(" "), "word").alias("bigram")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(k).collect()

    edge = buckets.orderBy(F.desc("n")).offset(TRIED * k).limit(1).first()
    above = edge["n"] if edge else 0
    found = top(above)
    least = found[-1]["n"] if 0 < k <= len(found) else 1
    if least <= above:
        found = top(least - 1)
    return df.sparkSession.createDataFrame(found, "bigram string, n bigint")


def top_first_words(df: DataFrame, k: int = 30) -> DataFrame:
    return top_k(df, F.array_compact(F.array(text.first_word(F.col("text")))), "word", k)


def language_counts(df: DataFrame, markers: Mapping[str, str] = LANGUAGE_MARKERS) -> DataFrame:
    """(language, n, total): texts with a marker of each language, in one pass; a text is cut into words once, for all languages."""
    names = sorted(markers)
    cut = df.select("text", text.whole_words(F.col("text")).alias("_words"))
    one = cut.agg(*[F.count_if(text.has_marker(F.col("text"), markers[n], F.col("_words"))).alias(n) for n in names], F.count("*").alias("total"))
    pairs = F.array(*[F.struct(F.lit(n).alias("language"), F.col(n).alias("n")) for n in names])
    return one.select(F.explode(pairs).alias("p"), "total").select("p.language", "p.n", "total")


def dominant_language(counts: DataFrame, least: float = 0.05, lead: float = 2.0) -> DataFrame:
    """The top language if it has `least` of all texts and `lead` times the runner-up; else no row."""
    ranked = counts.filter("n > 0").withColumn("_next", F.lead("n").over(Window.orderBy(F.desc("n"), "language")))
    best = ranked.orderBy(F.desc("n"), "language").limit(1)
    ok = (F.col("n") >= F.lit(least) * F.col("total")) & (F.col("_next").isNull() | (F.col("n") >= F.lit(lead) * F.col("_next")))
    return best.filter(ok).select("language", "n", stats.share(F.col("n"), F.col("total")).alias("share_pct"))


def slash_usage(df: DataFrame, column: str = "text", before: str = r"[\s`]", known: Sequence[str] | None = SLASH_COMMANDS, k: int = 20) -> DataFrame:
    """The k most used commands, with the share of texts that hold any accepted command; known=None accepts all."""
    found = F.when(F.contains(column, F.lit("/")), text.slash_commands(F.col(column), before))
    accepted = found if known is None else F.filter(found, lambda c: text.is_slash_command(c, known))
    cut = df.select(accepted.alias("_c"))
    whole = cut.agg(F.count_if(F.size("_c") > 0).alias("with_command"), F.count("*").alias("total"))
    top = top_k(cut, F.col("_c"), "command", k)
    return top.crossJoin(F.broadcast(whole)).select("command", "n", stats.share(F.col("with_command"), F.col("total")).alias("share_pct"))


def steering_words(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(kind, word, n): how often each approval and pushback word begins a text."""
    word = text.first_word(F.col("text"))
    kind = F.when(word.isin(*lexicon.approval), "approval").when(word.isin(*lexicon.pushback), "pushback")
    return df.select(kind.alias("kind"), word.alias("word")).filter("kind is not null").groupBy("kind", "word").agg(F.count("*").alias("n"))


def type_matrix(df: DataFrame, row: str, kind: str) -> DataFrame:
    """Counts by row and kind with both margins; null keys stand for totals."""
    counted = df.rollup(row, kind).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    margin = df.groupBy(kind).agg(F.count("*").alias("n")).select(F.lit(None).cast(df.schema[row].dataType).alias(row), kind, "n", F.lit(2).cast("bigint").alias("level"))
    return counted.select(row, kind, "n", F.col("level").cast("bigint").alias("level")).unionByName(margin)
