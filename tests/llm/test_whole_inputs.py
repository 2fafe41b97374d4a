"""Thresholds from all labels, and the pipeline's near-dedup through the trie of fingerprints."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.llm import quality_llr, shingle_dedup

from .test_operators import frame, prose


def test_quality_threshold_sees_every_label(spark):
    """All labels but those whose ids hash highest are good, so none of the lowest 20,000 tells bad from good."""
    rank = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = spark.range(20_300).select(F.col("id").alias("doc_id")).withColumn("quality", (rank <= 20_000).cast("int"))
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.when(F.col("quality") == 1, "w").otherwise("#"), F.pmod(F.hash("doc_id", i), F.lit(900)).cast("string")))
    docs = ranked.select("doc_id", F.array_join(words, " ").alias("text"))
    assert quality_llr.fit(docs, ranked, 1 << 10).threshold > -math.inf


def test_near_copies_meet_in_the_trie(spark):
    """Without any min-hash band, what the trie links is still compared by whole shingle sets."""
    rng = random.Random(3)
    texts = [prose(400, rng) for _ in range(20)]
    docs = frame(spark, texts + [t + " end" for t in texts[:6]])
    rows, named = shingle_dedup.components(docs, bands=0)
    assert named.select("keep").distinct().count() == 20 and rows.count() == 26
