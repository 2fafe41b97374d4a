"""The pipeline on planted cases, and the queries of this package."""

import os

import pytest

import __spark_entry__
import corpus_pipeline

from colloquy.llm import line_chunks, packing

from .test_operators import line_chunks_of, prose

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("tables"))
    item = prose(30, rng)
    passage = "\n".join(prose(12, rng) for _ in range(12))
    clean = [(i, "\n".join(prose(30, rng) for _ in range(4))) for i in range(60)]
    toxic = [(100 + i, prose(20, rng) + " glarp " + prose(20, rng)) for i in range(60)]
    copies = [(200 + i, clean[i][1].replace("\n", " ")) for i in range(5)] + [(210 + i, clean[i][1]) for i in range(5)]
    leaks = [(300 + i, prose(20, rng) + " " + item.upper() + " " + prose(20, rng)) for i in range(3)]
    lines = [(400 + i, prose(30, rng) + "\n" + passage + "\n" + prose(30, rng)) for i in range(4)]
    rows = [(i, t, "en", "s", len(t)) for i, t in (*clean, *toxic, *copies, *leaks, *lines)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 160)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_planted_cases(spark, tables, tmp_path):
    docs, kept, texts = spark.read.parquet(f"{tables}/documents.parquet"), {}, {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert docs.columns == columns
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not kept["toxicity"] & set(range(100, 160)) and set(range(60)) <= kept["toxicity"]
    assert kept["line_dedup"] == kept["toxicity"]
    assert all(len(texts["line_dedup"][400 + i]) < len(texts["toxicity"][400 + i]) for i in (1, 2, 3))
    assert texts["line_dedup"][400] == texts["toxicity"][400]
    assert not kept["near_dedup"] & set(range(200, 205)) and set(range(60)) <= kept["near_dedup"]
    assert kept["decontamination"] == kept["near_dedup"] - {300, 301, 302}
    assert kept["best_fit_packing"] == kept["decontamination"]


def plain_run(docs, toxic, item):
    """The packed pieces as (doc_id, piece, start, length), from documents as (doc_id, text) by id, by loops."""
    kept = [(i, t) for i, t in docs if i not in toxic]
    # every multi-line chunk that an earlier document holds goes
    seen, cut = set(), []
    for i, t in kept:
        own, gone = t.split("\n"), set()
        for x, y in line_chunks_of(own):
            whole = "\n".join(own[x:y])
            if sum(bool(w.strip()) for w in own[x:y]) >= line_chunks.MIN_LINES:
                if whole in seen:
                    gone |= set(range(x, y))
                seen.add(whole)
        cut.append((i, "\n".join(w for k, w in enumerate(own) if k not in gone)))
    # of texts whose five-word shingles are similar the first stays, through any chain of them
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in cut]
    group = list(range(len(cut)))
    for x in range(len(cut)):
        for y in range(x):
            if shingles[x] == shingles[y] or len(shingles[x] & shingles[y]) >= 0.8 * len(shingles[x] | shingles[y]):
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = [new if g == old else g for g in group]
    single = [d for k, d in enumerate(cut) if group[k] == k]
    clean = [(i, t) for i, t in single if item.lower() not in " ".join(t.lower().split())]
    most, pieces = max(packing.CAPACITIES), []
    for i, t in clean:
        total = len(t.split()) + 1
        pieces += [(i, k, k * most, min(most, total - k * most)) for k in range(-(-total // most))]
    return sorted(pieces)


def test_run_equals_plain_python(spark, tables):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    rows = corpus_pipeline.run(spark, tables).collect()
    wanted = plain_run(docs, set(range(100, 160)), item)
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == wanted and len(wanted) > 60
    # bins are as plain best-fit makes them: filled without a gap, no wider than needed, and as many of each size
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length, r.bin_size))
    for own in bins.values():
        own.sort()
        used = sum(n for _, n, _ in own)
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
        assert {s for _, _, s in own} == {min(c for c in packing.CAPACITIES if c >= used)}
    if len(packing.CAPACITIES) > 1:
        assert sum(own[0][2] for own in bins.values()) <= sum(min(c for c in packing.CAPACITIES if c >= n) for *_, n in wanted)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")
def test_queries_of_every_operator(spark):
    found = {int(n[2:].split("_")[0]): f for n, f in __spark_entry__.queries().items() if n.startswith("op") and n[2].isdigit()}
    assert sorted(found) == list(range(1, 14))
    whole = spark.read.parquet(f"{DIR}/documents.parquet").count()
    for n in (4, 5, 6, 7, 8, 9, 12, 13):
        assert found[n](spark, DIR).select("doc_id").distinct().count() == whole


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")
def test_warc_query_equals_its_sql(spark):
    import duckdb

    from colloquy.llm import queries

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    theirs = sorted(duckdb.sql(queries.oracle_sql()["op10_warc_segments"]).fetchall())
    assert sorted(map(tuple, queries.queries()["op10_warc_segments"](spark, DIR).collect())) == theirs


def edited(words, similarity, rng):
    """words with as many single words replaced, far from one another, as leave five-word shingles just that similar."""
    words, n = list(words), len(words) - 4
    for k in range(int(n * (1 - similarity) / (1 + similarity) / 5)):
        words[7 + 9 * k] = f"edit{rng.random()}"
    return words


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_drops_edited_copies(spark):
    import random

    rng, rows, gone = random.Random(5), [], set()
    for i in range(40):
        words = prose(400, rng).split()
        rows.append((i, " ".join(words)))
        for k, similarity in enumerate((0.8, 0.85, 0.9, 0.95, 0.7)):
            rows.append((1000 + 10 * i + k, " ".join(edited(words, similarity, rng))))
            if jaccard(rows[-1][1], rows[-1 - k - 1][1]) >= 0.8:
                gone.add(rows[-1][0])
    assert len(gone) == 160
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert {i for i, _ in rows} - kept >= gone and set(range(40)) <= kept


@pytest.mark.parametrize("slice_at", [1024, 3])
def test_near_dedup_equals_brute_force(spark, slice_at):
    import random

    from colloquy.llm import shingle_dedup

    rng, base, rows = random.Random(9), [], []
    base = [prose(120, rng) for _ in range(6)]
    for i in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = "other"
        rows.append((i % 80 if i % 11 else None, " ".join(words)))
    rows += [rows[0], (None, rows[3][1]), (500, ""), (501, None), (502, "two words"), (503, "Two  words")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(root(i), []).append((doc_id is None, doc_id, text))
    kept = sorted((r.doc_id is None, -1 if r.doc_id is None else r.doc_id) for r in shingle_dedup.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"), slice_at=slice_at).collect())
    assert kept == sorted(min((a, -1 if a else b) for a, b, _ in g) for g in groups.values()) and 6 < len(kept) < 60
