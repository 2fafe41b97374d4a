"""Language by the nearest of several centroids a language, of TF-IDF vectors of letter groups.

Document frequencies are counted over all training rows; the centroids are fitted, language
by language, on a sample whose size is bounded. A text is of the language of the centroid
nearest by cosine. It is rejected if its distance is beyond that centroid's radius, which
training texts of the cluster set.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text
where nothing could be learned; a row with a null doc_id, text or lang is not learned from;
of repeated rows each counts. Columns beside those that are named play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_kernel
from .common import map_rows, ship
from .ngram_kernel import BINS, clusters, counts, frequencies, vector

ship(ngram_kernel)

#: Texts of each language that its centroids are fitted on, about, and languages that are learned at most, those with most texts.
SAMPLE, LANGUAGES = 1_000, 256

#: Centroids a language, the share of a cluster's texts that its radius takes in, and by what factor and least distance it is wider for unseen texts.
CENTROIDS, WITHIN, WIDER, SLACK = 4, 0.995, 1.1, 1e-3

UNKNOWN = "und"


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Weight of each bin, over all texts; a row a bin reaches the driver."""
    found = dict(map_rows(texts, frequencies, "bin int, n bigint").groupBy("bin").agg(F.sum("n")).collect())
    df = np.array([found.get(b, 0) for b in range(BINS)])
    return np.log((1 + found.get(-1, 0)) / (1 + df)) + 1


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """Weights and centroids from rows (doc_id, text, lang), none of them null."""
    weights = inverse_frequencies(docs.select("text"))
    known = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not known:
        return {"weights": weights, "langs": [], "centroids": np.zeros((0, BINS), np.float32), "radii": np.zeros(0)}
    one_in = F.create_map(*[F.lit(x) for r in known for x in (r.lang, -(-r.n // sample))])
    chosen = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).withColumn("_of", one_in[F.col("lang")]).filter("_of is not null and pmod(h, _of) = 0")

    def vectors(rows):
        for lang, h, text in rows:
            found = counts(text)
            if found is not None:
                at = np.flatnonzero(found)
                yield lang, h, at.tolist(), vector(found, weights)[at].tolist()

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        x = np.zeros((len(rows), BINS), np.float32)
        for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
            x[i, at] = value
        found = clusters(x, centroids)
        near = x @ found.T
        own = near.argmax(axis=1)
        radius = [float(np.quantile(1 - near[own == k, k], WITHIN)) if (own == k).any() else 0.0 for k in range(len(found))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(found), "radius": radius})

    short = map_rows(chosen.select("lang", "h", "text"), vectors, "lang string, h bigint, at array<int>, value array<float>")
    rows = short.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, radius double").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.centroid))
    table = np.array([r.centroid for r in rows], np.float32).reshape(len(rows), BINS)
    return {"weights": weights, "langs": [r.lang for r in rows], "centroids": table, "radii": np.array([r.radius for r in rows])}


def predict(docs: DataFrame, model: dict, *more: Column | str) -> DataFrame:
    """(lang_pred, score, rejected) beside the columns `more` of docs: the nearest language, its cosine, and whether it lies too far."""
    langs, centroids, weights = model["langs"], model["centroids"], model["weights"]
    radii = np.minimum(1.0, model["radii"] * WIDER + SLACK)

    def nearest(rows):
        for text, *rest in rows:
            found = counts(text) if text is not None and langs else None
            if found is None:
                yield *rest, UNKNOWN, 0.0, True
                continue
            near = centroids @ vector(found, weights)
            best = int(near.argmax())
            score = min(1.0, max(0.0, float(near[best])))
            yield *rest, langs[best], score, bool(1 - score > radii[best])

    kept = docs.select(*more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_rows(docs.select("text", *more), nearest, f"{schema}, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row; rows where held_out holds are not learned from."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(own.filter("not held_out and doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang"))
    return predict(own.select("doc_id", "text", "held_out"), model, "doc_id", "held_out")


def query(docs: DataFrame) -> DataFrame:
    return languages(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
