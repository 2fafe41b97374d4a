"""Toxicity by a weighted finite-state clause grammar whose lexicon and weights come from labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clause_kernel as kernel
from .common import map_rows, scratch, settle, ship

ship(kernel)

#: Labelled documents that the grammar is fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000

#: A lexicon entry occurs in so many toxic documents, and in so large a share of them among all.
SUPPORT, PRECISION = 3, 0.9

#: Documents that the share of an entry's shortest stem counts for, in the share of the entry.
SHRINKAGE = 20

THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: dict[str, float]
    shift: float = 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A grammar fitted on at most `sample` labelled documents, none of them held out.

    Labels that are null, or whose document is missing, are left aside; a document with
    several labels counts once for each. Scores are shifted down, on the logit scale, where a
    grammar learned from half of the sample tells the other half best above THRESHOLD. Without
    labels the lexicon is empty, and every text scores the rate of texts without clauses.
    """
    usable = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # bounded, so it may be broadcast
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).alias("fold")
    with scratch():
        train, _ = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", fold), "toxicity-train")
        half = _learn(train.filter("fold = 0"))
        seen = score(train.filter("fold = 1").select(F.lit(0).alias("doc_id"), "text", "toxic"), half, "toxic").select("toxic", "score")
        cut = _cut([(r[1], r[0] == 1) for r in seen.collect()])  # at most `sample` numbers
        whole = _learn(train)
    return Model(whole.lexicon, whole.weights, min(0.0, _logit(THRESHOLD) - _logit(cut)) if cut else 0.0)


def _counts(df: DataFrame, count) -> DataFrame:
    found = map_rows(df.select("text", "toxic"), count, "name string, yes bigint, no bigint")
    return found.groupBy("name").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def _learn(train: DataFrame) -> Model:
    """Lexicon and clause weights from labelled rows (text, toxic)."""
    likely = _counts(train.filter("toxic = 1"), lambda it: kernel.count_features(it)).filter(F.col("yes") >= SUPPORT)
    wanted = frozenset(r[0] for r in likely.select("name").collect())  # features of the bounded sample
    both = _counts(train, lambda it: kernel.count_features(it, wanted)).filter((F.col("yes") >= SUPPORT) & (F.col("yes") + 0.5 >= PRECISION * (F.col("yes") + F.col("no") + 1)))
    rate = train.filter("toxic = 1").count() / max(1, train.count())
    roots = _counts(train, lambda it: kernel.count_features(it, frozenset(w[: kernel.STEM[0]] for w in wanted)))
    root = {r[0]: _shrunk(r[1], r[2], rate) for r in roots.collect()}
    lexicon = {r[0]: _shrunk(r[1], r[2], root.get(r[0][: kernel.STEM[0]], rate)) for r in both.collect()}
    seen = {r[0]: (r[1], r[2]) for r in _counts(train, lambda it: kernel.count_clauses(it, lexicon)).collect()}
    weights = {}
    for kind, prior in {**kernel.PRIOR, "none": 0.05}.items():
        yes, no = seen.get(kind, (0, 0))
        weights[kind] = (yes + kernel.PRIOR_WEIGHT * prior) / (yes + no + kernel.PRIOR_WEIGHT)
    return Model(lexicon, weights)


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p) - math.log1p(-p)


def _cut(scored: list[tuple[float, bool]]) -> float | None:
    """The score that tells toxic from other documents best, in the middle of the gap; None without both kinds."""
    scored = sorted(scored)
    bad, good = sum(y for _, y in scored), sum(not y for _, y in scored)
    if not bad or not good:
        return None
    best, cut, left_bad, left_good = 0.0, None, 0, 0
    for (p, y), (q, _) in zip(scored, scored[1:], strict=False):
        left_bad, left_good = left_bad + y, left_good + (not y)
        gain = (bad - left_bad) / bad + left_good / good
        if q > p and gain > best:
            middle = (_logit(p) + _logit(q)) / 2
            best, cut = gain, 1 / (1 + math.exp(-middle))
    return cut


def _shrunk(yes: int, no: int, toward: float) -> float:
    """A share drawn toward what shorter stems show, so that a rare entry alone does not settle a text."""
    return (yes + SHRINKAGE * toward) / (yes + no + SHRINKAGE)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(doc_id, score, n_clauses) for every row of docs(doc_id, text, ...).

    score is in 0 to 1. n_clauses counts the insults and threats in the best reading of all
    clauses. Null and empty texts have none and score the rate of such texts; very long texts,
    and clauses, take time in proportion to their words. Repeated rows are scored one by one;
    other columns, whatever their names, are left aside; an empty table gives an empty table.
    """
    lexicon, weights, shift = model.lexicon, model.weights, model.shift
    schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in ("doc_id", *keep)) + "score double, n_clauses int"
    return map_rows(docs.select("text", "doc_id", *keep), lambda it: kernel.score_rows(it, lexicon, weights, shift), schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose text scores below threshold; each row is judged by its own text."""
    model = fit(docs, labels)
    lexicon, weights, shift = model.lexicon, model.weights, model.shift

    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        tagger = kernel.Tagger(lexicon)
        for batch in batches:
            text = batch.column(at)
            mask = [kernel.score(text[i].as_py(), tagger, weights, shift)[0] < threshold for i in range(batch.num_rows)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
