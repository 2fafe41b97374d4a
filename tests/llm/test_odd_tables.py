"""Every operator on odd and empty tables."""

from colloquy.llm import (
    decontaminate, line_chunks, packing, pii_weak, quality_llr, secret_scan, simhash_trie, suffix_dedup, toxicity_fst, warc_segments,
)

from .conftest import TEXTS


def ids(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=repr)


def every(df):
    assert ids(df) == sorted(((i,) for i, _ in TEXTS), key=repr)
    return df


def bench(spark):
    return spark.createDataFrame([(1, "seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "x"), (None, "no such item here at all")], "item_id bigint, text string")


def test_decontamination(spark, odd, none):
    found = ids(decontaminate.contaminated(odd, bench(spark)), "item_id", "distance")
    assert found == sorted([(1, 1, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (5, 4, 0)], key=repr)
    left = decontaminate.remove_contaminated(odd, bench(spark))
    assert left.columns == odd.columns and {i for (i,) in ids(left)} == {2, 3, 4, 6, 8, 9, None}
    assert decontaminate.contaminated(none, bench(spark)).count() == 0 == decontaminate.contaminated(odd, bench(spark).limit(0)).count()


def test_repeated_passages(odd, none):
    spans = suffix_dedup.repeated_passages(odd)
    assert {i for (i,) in ids(spans)} <= {6, 9}
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_packing(odd, none):
    placed = packing.pack(odd)
    assert {i for (i,) in ids(placed)} == {i for i, _ in TEXTS}
    assert sorted(r.length for r in placed.filter("doc_id = 6").collect())[-1] == 4096
    assert packing.pack(none).count() == 0


def test_secrets(odd, none):
    assert all(r.spans == [] for r in every(secret_scan.find_secrets(odd)).filter("doc_id <> 8").collect())
    assert secret_scan.find_secrets(none).count() == 0
    assert every(secret_scan.query(odd)).filter("doc_id = 8").first().n_hex == 1


def test_quality(odd, none, labels):
    rows = {r.doc_id: r for r in every(quality_llr.query(odd, labels)).collect()}
    assert (rows[2].n_words, rows[2].base_failed, rows[2].kept) == (0, True, False)
    assert (rows[6].n_words, rows[6].base_failed) == (40_000, True)  # its words go round with a period
    assert quality_llr.query(none, labels).count() == 0
    assert every(quality_llr.query(odd, labels.limit(0))).filter("kept = base_failed").count() == 0


def test_near_duplicates(odd, none):
    rows = ids(simhash_trie.near_duplicates(odd), "component_id")
    assert (7, 1) in rows and (3, 2) in rows and (4, 2) in rows and (6, 6) in rows and (None, 1) in rows and (None, 2) in rows
    kept = simhash_trie.keep_first(odd)
    assert kept.columns == odd.columns and sorted(i for (i,) in ids(kept) if i) == [1, 2, 5, 6, 8, 9]
    assert simhash_trie.near_duplicates(none).count() == 0


def test_toxicity(odd, none, labels):
    assert every(toxicity_fst.query(odd, labels)).filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity_fst.query(none, labels).count() == 0
    assert toxicity_fst.remove_toxic(odd, labels.limit(0)).columns == odd.columns
    assert every(toxicity_fst.query(odd, labels.limit(0))).count()


def test_line_chunks(odd, none):
    left = every(line_chunks.remove_repeats(odd))
    by = {r.doc_id: r.text for r in left.filter("doc_id is not null").collect()}
    assert by[2] is None and by[3] == "" and by[1] == TEXTS[0][1] and len(by[6]) == len(TEXTS[5][1])
    assert set(odd.columns) <= set(left.columns)
    assert line_chunks.remove_repeats(none).count() == 0


def test_personal_data(odd, none):
    assert every(pii_weak.find_personal_data(odd)).filter("size(spans) > 0").count() == 0
    assert pii_weak.find_personal_data(none).count() == 0


def test_warc(spark, tmp_path, odd):
    from pyspark.sql import functions as F

    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://a/ b\n").alias("url"), F.col("text").alias("html"), "hash", "digest" if "digest" in odd.columns else F.lit(1).alias("digest"))
    out = str(tmp_path / "warc")
    warc_segments.write_archive(pages, out)
    back = warc_segments.read_archive(spark, out, payloads=True)
    wanted = sorted(((i, len((t or "").encode())) for i, t in TEXTS), key=repr)
    assert sorted(((r.page_id, r.payload_bytes) for r in back.collect()), key=repr) == wanted
    empty = str(tmp_path / "empty")
    warc_segments.write_archive(pages.limit(0), empty)
    assert warc_segments.read_archive(spark, empty).count() == 0


def test_line_chunks_of_rows_that_share_an_id(spark):
    passage = "\n".join(f"the line {i} of a passage" for i in range(12))
    rows = [(1, passage), (2, "begin\n" + passage), (2, "\n".join(f"line {i} of its own" for i in range(20))), (None, passage), (None, "\n".join(f"other {i} here" for i in range(20)))]
    left = line_chunks.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = {r.text for r in left}
    assert {rows[0][1], rows[2][1], rows[4][1]} <= texts and len(left) == 5
    assert sum(len(r.text) for r in left) < sum(len(t) for _, t in rows) - len(passage)
