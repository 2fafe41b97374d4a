"""Frequent pairs of words: the same as counted one by one, without all pairs being shuffled."""

import random
from collections import Counter

import pytest

from colloquy.operators import quantitative
from colloquy.render import reports


def frame(spark, texts):
    return spark.createDataFrame([(t, "p") for t in texts], "text string, project string").repartition(4)


def counts(texts):
    """(word counts, pair counts) of texts of plain lower-case words."""
    words, pairs = Counter(), Counter()
    for t in texts:
        w = [x for x in (t or "").split() if len(x) > 1 and x not in quantitative.ALL_STOPWORDS]
        words.update(w)
        pairs.update(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
    return words, pairs


def top(counted, k):
    return sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:k]


def skewed(n=200):
    rng = random.Random(7)
    names = [f"w{i:03}" for i in range(200)] + ["the", "og", "x"]
    return [" ".join(rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=rng.randrange(60))) for _ in range(n)] + [None, "", "the", "alone", "nd ouble " * 50]


def flat():
    """Every pair once, so that all buckets reach the k-th pair."""
    return [f"a{i:03} b{i:03} c{i:03}" for i in range(300)]


def shuffled_rows(spark, run):
    """Rows that the stages of run wrote to shuffles."""
    sc = spark._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("buckets", [1, 16, 1 << 18])
@pytest.mark.parametrize("texts", [skewed(), flat(), [None, "", "the"]], ids=["skewed", "flat", "none"])
def test_pairs_are_exact_whatever_the_buckets(spark, monkeypatch, texts, buckets):
    monkeypatch.setattr(quantitative, "BUCKETS", buckets)
    df, (words, pairs) = frame(spark, texts), counts(texts)
    counted = quantitative.word_counts(df)
    for k in (1, 3, 5000):
        assert [tuple(r) for r in quantitative.top_bigrams(df, k).collect()] == top(pairs, k)
        assert [tuple(r) for r in quantitative.top_bigrams(df, k, counted=counted).collect()] == top(pairs, k)
        assert [tuple(r) for r in quantitative.top_counted_words(counted, k).collect()] == top(words, k)


def test_report_has_the_same_words_and_pairs(spark):
    texts = skewed()
    n, (words, pairs) = reports.numbers(frame(spark, texts)), counts(texts)
    assert (n["top_unigrams"], n["top_bigrams"]) == (top(words, 20), top(pairs, 20))


def test_rare_pairs_are_not_shuffled_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(quantitative, "BUCKETS", 256, raising=False)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(2000):04}" for _ in range(100)) + " often seen" * 40 for _ in range(200)]
    df = frame(spark, texts).persist()
    assert df.count() == len(texts) and len(counts(texts)[1]) > 15_000
    assert shuffled_rows(spark, lambda: quantitative.top_bigrams(df, 2).collect()) < 5_000
    df.unpersist()
