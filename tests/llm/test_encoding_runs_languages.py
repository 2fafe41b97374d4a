"""Target encoding, periodic runs and languages against brute force, SQL and held-out rows."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language_id, periodic_runs, target_encoding
from colloquy.llm.ngram_kernel import counts
from colloquy.llm.runs_kernel import find_runs, rewritten

SHOP = ("sale_lines", "sales", "items", "vendors", "clients")

LINES = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, flag string, n bigint, key string"
SALES = "sale_id bigint, client_id bigint, sold_at timestamp_ntz, at bigint, fold int"
ITEMS, VENDORS, CLIENTS = "item_id bigint, kind string", "vendor_id bigint, nation_id int", "client_id bigint, segment string"


def shop(spark, seed, n_lines, n_sales):
    """Skewed keys, nulls, equal times, repeats, unknown ids and columns with clashing names."""
    from datetime import datetime, timedelta

    r = random.Random(seed)
    hot = lambda n: 7 if r.random() < 0.35 else r.randrange(n)
    some = lambda x: None if r.random() < 0.1 else x
    lines = [(some(hot(n_sales + 5)), i % 5, some(hot(12)), some(hot(6)), r.choice(["returned", "kept", None]), 1, "x") for i in range(n_lines)]
    sales = [(i, some(hot(9)), some(datetime(2024, 1, 1) + timedelta(seconds=r.randrange(max(1, n_sales // 3)))), 3, 4) for i in range(n_sales)] + [(None, 1, datetime(2024, 1, 1), 0, 0)] * min(1, n_sales)
    items = [(i, r.choice(["a", "b", "", None])) for i in range(10)]
    vendors, clients = [(i, some(i % 3)) for i in range(5)], [(i, some("s%d" % (i % 2))) for i in range(7)]
    made = zip((lines, sales, items, vendors, clients), (LINES, SALES, ITEMS, VENDORS, CLIENTS), strict=True)
    return [spark.createDataFrame(rows, schema) for rows, schema in made]


def by_sql(frames):
    con = duckdb.connect()
    for name, df in zip(SHOP, frames, strict=True):
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
        con.execute(f"CREATE TABLE {name} ({', '.join(f'"{c}" {kinds[t]}' for c, t in df.dtypes)})")
        rows = [tuple(r) for r in df.collect()]
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", rows)
    return con.execute(target_encoding.SQL)


@pytest.mark.parametrize(("seed", "n_lines", "n_sales", "parts"), [(1, 400, 60, 7), (2, 300, 4, 11), (3, 0, 3, 2), (4, 5, 0, 3), (5, 250, 200, 1), (6, 500, 30, 40)])
def test_encoding_equals_sql(spark, seed, n_lines, n_sales, parts):
    frames = shop(spark, seed, n_lines, n_sales)
    ours = target_encoding.encode(*frames, parts=parts)
    theirs = by_sql(frames)
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(map(repr, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(map(repr, theirs.fetchall()))


def test_times_need_no_zone(spark):
    """Times that a session's zone skips or repeats are as far apart as they say."""
    from datetime import datetime

    stamps = [datetime(2024, 3, 10, 1, 59, 59, 999_999), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 0), datetime(2024, 3, 10, 3, 30), datetime(2024, 11, 3, 1, 30, 0, 1), datetime(1969, 12, 31, 23, 59, 59, 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "i int, t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.i: r.m for r in df.select("i", target_encoding._micros("t").alias("m")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    delta = lambda t: (t - datetime(1970, 1, 1)) // __import__("datetime").timedelta(microseconds=1)
    assert got == {i: delta(t) for i, t in enumerate(stamps)}


def test_encoding_by_loop(spark):
    """The SQL itself against plain loops over lines, for the item column."""
    frames = shop(spark, 9, 120, 25)
    lines, sales, items, _, _ = ([r.asDict() for r in f.collect()] for f in frames)
    sold = {s["sale_id"]: s["sold_at"] for s in sales if s["sold_at"] is not None and s["sale_id"] is not None}
    kind = {i["item_id"]: i["kind"] for i in items}
    rows = [(x["sale_id"], -1 if x["item_id"] is None else x["item_id"], x["vendor_id"], x["flag"] == "returned") for x in lines if x["sale_id"] in sold]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5

    def rate(chosen, prior):
        n, s = len(chosen), sum(r[3] for r in chosen)
        return n, prior if n < 1 else (1_000_000 * s + 50 * prior) // (n + 50)

    expected = {}
    for sale, item, vendor, _ in rows:
        past = [r for r in rows if fold(r[0]) != fold(sale) and sold[r[0]] < sold[sale]]
        p = rate(past, 500_000)[1]
        p = rate([r for r in past if kind.get(r[1]) == kind.get(item)], p)[1]
        expected[sale, item, vendor] = rate([r for r in past if r[1] == item], p)
    ours = target_encoding.encode(*frames, parts=5).collect()
    assert {(r.sale_id, r.item_id, r.vendor_id): (r.item_n, r.item_rate) for r in ours} == expected


# ---- runs ----------------------------------------------------------------------------------------


def slow_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q) and (s, i + q) not in found:
                found[s, i + q] = q
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts():
    r = random.Random(5)
    out = [["a"] * n for n in (0, 1, 11, 12, 13, 400)] + [["a", "b"] * 90, ["a", "b", "a"] * 60 + ["c"] + ["a", "b", "a"] * 41]
    for _ in range(150):
        words = [r.choice("abcdefghij"[: r.randint(1, 10)]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4)):
            part = [r.choice("abcxyz") for _ in range(r.randint(1, 30))] * r.randint(1, 5)
            at = r.randint(0, len(words))
            words[at:at] = part[: len(part) - r.randint(0, 5)]
        out.append(words)
    return out


def ids(words):
    return np.array([ord(w) for w in words], np.int32)


def test_runs_equal_brute_force():
    for words in texts():
        assert sorted(find_runs(ids(words))) == slow_runs(words)


@pytest.mark.parametrize("cuts", [(1, 2, 4, 8, 10_000), (1, 5, 60, 10_000)])
def test_ranges_of_lags_give_the_same_runs(cuts):
    for words in texts():
        parts = [r for low, high in zip(cuts, cuts[1:]) for r in find_runs(ids(words), low, high)]
        assert sorted(parts) == slow_runs(words)


def test_a_text_of_one_word_is_cheap():
    assert find_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    assert find_runs(np.zeros(300_000, np.int32), 4096, 8192) == []
    assert find_runs(np.arange(300_000, dtype=np.int32) % 3000, 2048, 4096) == [(0, 300_000, 3000)]


def expected_row(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = slow_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join("%d,%d,%d\n" % r for r in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize(("long", "first"), [(1 << 21, 1 << 10), (60, 4)])
def test_run_query_equals_brute_force(spark, long, first):
    docs = [(i, " ".join(w)) for i, w in enumerate(texts())] + [(500, None), (501, ""), (502, " \n\x0b "), (None, "a " * 30), (3, "b\x1cb  " * 14), (3, "b\x1cb  " * 14)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, row string, h int")
    ours = periodic_runs.runs_of_texts(df, long, first)
    assert sorted(map(repr, (tuple(r) for r in ours.collect()))) == sorted(map(repr, (expected_row(*d) for d in docs)))


def test_rewritten_words():
    assert rewritten(5, 11) is None and rewritten(0, 10) is None and rewritten(4, None) is None
    assert rewritten(10, 20).tolist() == [0, 1, 2, 3, 2, 3, 2, 3, 2, 3]  # g 2, a 2, p 1 + 8 // 5


def test_runs_of_odd_rows(odd, none):
    rows = periodic_runs.query(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_runs for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert periodic_runs.query(none).collect() == []


# ---- languages -----------------------------------------------------------------------------------


def test_languages_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("driver tables are absent")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    n, right = found.agg(F.count("*"), F.count_if(F.expr("lang = lang_pred"))).first()
    assert n > 100 and right / n >= 0.99


def test_labels_and_ids_are_no_inputs(spark):
    """A held-out row's own lang, source and doc_id change nothing; nor does that of a row whose id tells it apart."""
    word = {"aa": "lorem ipsum dolor", "bb": "zwei drei acht"}
    rows = [(i, f"{word[lang]} {i % 7}", lang) for i in range(60) for lang in word]
    df = spark.createDataFrame([(2 * i + (lang == "bb"), t, lang) for i, t, lang in rows], "doc_id bigint, text string, lang string")
    first = {r.doc_id: r[1:] for r in language_id.query(df).select("doc_id", "held_out", "lang_pred", "score", "rejected").collect()}
    turned = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert {r.doc_id: r[1:] for r in language_id.query(turned).select("doc_id", "held_out", "lang_pred", "score", "rejected").collect()} == first
    assert {p for _, p, _, _ in first.values()} == {"aa", "bb"}


def test_languages_of_odd_rows(spark, odd, none):
    taught = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    rows = language_id.query(taught).collect()
    assert len(rows) == odd.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (2, 3, 4)} == {("und", 0.0)}
    assert {r.lang_pred for r in rows} <= {"und", "xx", "yy"} and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.query(odd).collect()} == {"und"}  # nothing to learn from
    assert language_id.query(none).collect() == []


def test_far_texts_are_rejected(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * (1 + i % 3), "en") for i in range(80)] + [(1000, "жук щёлкает", None), (1001, "12 34", None)]
    found = {r.doc_id: r for r in language_id.query(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert found[1000].rejected and found[1000].lang_pred == "en" and found[1001].lang_pred == "und"
    assert sum(found[i].rejected for i in range(80)) < 8


def test_groups_do_not_depend_on_pieces(monkeypatch):
    from colloquy.llm import ngram_kernel

    text = "Één twee, drie!  vier 5 vijf\n" * 40
    whole = counts(text)
    monkeypatch.setattr(ngram_kernel, "PIECE", 7)
    assert (counts(text) == whole).all()
