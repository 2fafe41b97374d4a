"""Prefix suppression, coverage, split log lines and the incremental scan against brute force."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import corpus, overlaps, prefixes, proposals
from colloquy.sources import log_lines, sessions
from colloquy.streaming import pushback
from colloquy.streaming.pushback import ProposalSink, detect, dry_run

from .test_sources import said, write

# ---- cached prompts ------------------------------------------------------------------------------


def kept_by_loop(rows):
    squeeze = lambda t: " ".join((t or "").split())
    full = {(s, squeeze(t)) for _, s, t, cached in rows if not cached and squeeze(t)}

    def stays(s, t, cached):
        t = squeeze(t)
        p = t.rstrip(".… ")
        return not cached or not any(f == t or (len(p) >= 40 and f.startswith(p)) for own, f in full if own == s)

    return sorted(i for i, s, t, cached in rows if stays(s, t, cached))


def prompt_rows(seed, n, letters="ab", sessions="x"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(30, 120))) for _ in range(12)]
    out = []
    for i in range(n):
        t = r.choice(base)[: r.choice([10, 39, 40, 41, 60, 200])] + r.choice(["", "", "...", " …", "z", " tail of it"])
        out.append((i, r.choice([*sessions, None]), r.choice([t, t, t, None, "", "  "]), r.random() < 0.6))
    return out


@pytest.mark.parametrize(("seed", "parts"), [(1, 2), (2, 5), (3, 23), (4, 1)])
def test_cached_prompts_by_brute_force(spark, seed, parts):
    rows = prompt_rows(seed, 220, sessions="xxy")
    df = spark.createDataFrame(rows, "id int, s string, text string, cached boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        left = corpus.drop_cached(df, ["s"], F.col("cached"))
        assert left.columns == df.columns and sorted(r.id for r in left.collect()) == kept_by_loop(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nested_beginnings_cross_parts(spark):
    """Every text begins the next, so with as many parts as texts each waits for the end of another part."""
    texts = [("a" * n, n == 60, n != 60) for n in range(40, 61)] + [("b" * 45, False, True), ("", False, True)]
    df = spark.createDataFrame([("g", *t) for t in texts] + [(None, "a" * 50, False, True), ("h", "a" * 41, False, True)], "g string, t string, full boolean, want boolean")
    found = prefixes.beginnings(df, ["g"], "t", "full", "want", parts=30).collect()
    assert sorted((r.g, len(r.t)) for r in found) == [("g", 0), *[("g", n) for n in range(40, 60)]]


# ---- coverage ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("shared", "part"), [(1, 0.0), (2, 0.05), (4, 0.3), (3, 0.9)])
def test_coverage_by_brute_force(spark, shared, part):
    r = random.Random(7)
    words = [f"token{i}" for i in range(60)]
    text = lambda: " ".join(["everywhere", *(r.choice(words[: r.choice([6, 60])]) for _ in range(r.randint(0, 14)))])
    replies, rules = [(i, text()) for i in range(60)] + [(99, None)], [(i, text()) for i in range(25)] + [(77, "")]
    ours = proposals.covered(spark.createDataFrame(replies, "a int, reply string"), spark.createDataFrame(rules, "b int, rule string"), "a", "b", shared=shared, part=part)
    tokens = lambda t: {w for w in (t or "").split() if len(w) > 4}
    expected = [(a, b, len(tokens(x) & tokens(y)), len(tokens(x))) for (a, x), (b, y) in itertools.product(replies, rules) if len(tokens(x) & tokens(y)) >= shared and len(tokens(x) & tokens(y)) / len(tokens(x)) > part]
    assert sorted(map(tuple, ours.collect())) == sorted(expected)


def test_a_token_of_every_row_is_not_joined(spark):
    rows = [(i, f"everywhere alpha{i} beta{i} gamma{i} delta{i}".split()) for i in range(200)]
    left = spark.createDataFrame(rows, "_a int, _ta array<string>")
    right = spark.createDataFrame([(i, t) for i, t in rows if i % 2], "_b int, _tb array<string>")
    tested = overlaps.candidates(left, right, F.lit(4), 4).collect()
    assert {(r._a, r._b) for r in tested} >= {(i, i) for i in range(1, 200, 2)} and len(tested) < 150


# ---- lines ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1 << 20])
def test_lines_of_any_pieces(spark, tmp_path, piece):
    contents = {"a/s1.jsonl": "one\ntwo\n\nfour\r\nfive", "a/s2.jsonl": "", "b/s3.jsonl": "\n\nü😀\n" + "x" * 50 + "\n", "b/s4.jsonl": "no end"}
    for name, value in contents.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(value.encode())
    os.symlink(tmp_path / "a/s1.jsonl", tmp_path / "b/link.jsonl")
    got = sorted((r.path.removeprefix(f"{tmp_path}/"), r.line_no, r.value) for r in log_lines.lines(spark, str(tmp_path), piece_bytes=piece).collect())
    plain = lambda v: v.split("\n")[:-1] if v.endswith("\n") else v.split("\n") if v else []
    assert got == sorted((n, i + 1, line) for n, v in contents.items() for i, line in enumerate(plain(v)))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    write(str(tmp_path / "p/s.jsonl"), *[said("user", f"prompt {i}") for i in range(4000)])
    read = sessions.session_logs(spark, str(tmp_path), piece_bytes=20_000)
    assert len(log_lines._LineReader({"root": str(tmp_path), "piecebytes": "20000"}).partitions()) > 10
    assert [r.line_no for r in read.select("line_no").orderBy("line_no").collect()] == list(range(1, 4001))


def test_large_blocks_and_counts(monkeypatch, tmp_path):
    monkeypatch.setattr(log_lines, "READ_BYTES", 5)
    path = tmp_path / "f"
    path.write_bytes(b"ab\ncdefghijklmn\n\nop\nq")
    with open(path, "rb") as f:
        for cut in range(1, 22):
            bounds = [*range(0, 21, cut), 21]
            pieces = [list(log_lines.lines_from(f, a, b)) for a, b in itertools.pairwise(bounds)]
            assert sum(pieces, []) == [b"ab", b"cdefghijklmn", b"", b"op", b"q"]
            assert [log_lines.starts_in(f, a, b) for a, b in itertools.pairwise(bounds)] == [len(p) for p in pieces]


# ---- the incremental scan ------------------------------------------------------------------------


def pairs_by_loop(entries):
    out, waiting = [], None
    for e in entries:
        role, words = e["type"], e["message"]["content"]
        if role == "assistant" and words:
            waiting = words
        elif role == "user":
            if waiting and words:
                out.append((waiting, words))
            waiting = None
    return out


@pytest.mark.parametrize("slab", [1, 3, 7, 1000])
def test_pairs_of_cut_sessions_equal_a_loop(spark, slab):
    from colloquy.operators import pairs

    r = random.Random(slab)
    rows = [(s, i, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["", None, f"{s}-{i}", f"{s} {i}"])) for s in ["a", "b", None] for i in range(160) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "s string, turn bigint, role string, text string")
    expected = []
    for s in ["a", "b", None]:
        entries = [{"type": role, "message": {"content": t}} for own, _, role, t in sorted(rows, key=lambda x: x[1]) if own == s]
        expected += [(s, *p) for p in pairs_by_loop(entries)]
    got = [(x.s, x.assistant, x.reply) for x in pairs.turn_pairs(df, ["s"], "turn", slab=slab).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and len(got) > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_over_many_batches_equal_a_loop(spark, tmp_path, seed):
    r = random.Random(seed)
    every = {f: [said(r.choice(["user", "assistant", "system"]), r.choice(["", f"{f} says {i}", f"{f} again {i}"])) for i in range(24)] for f in "ab"}
    pattern, out = str(tmp_path / "projects/*/*.jsonl"), str(tmp_path / "out")
    for start in range(0, 24, 6):
        for f, entries in every.items():
            write(str(tmp_path / f"projects/p/{f}.jsonl"), *entries[start : start + 6], mode="a")
        stream = pushback.paired(pushback.tail(spark, pattern))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.assistant, x.reply) for x in spark.read.parquet(out).collect())
    assert got == sorted(p for entries in every.values() for p in pairs_by_loop(entries))


def test_dry_run_says_what_the_next_run_does(spark, tmp_path):
    path, pattern, cp = str(tmp_path / "projects/a/s.jsonl"), str(tmp_path / "projects/*/*.jsonl"), str(tmp_path / "cp")
    sink = ProposalSink(str(tmp_path / "out"), most=1, bound=9, approved_median=20.0)
    plan = lambda: sorted((r.reply, r.emitted) for r in dry_run(spark, pattern, sink, cp).collect())
    write(path, said("assistant", "I used spaces."), said("user", "no, use tabs"), said("assistant", "Done."))
    assert plan() == [("no, use tabs", True)] and not os.path.exists(tmp_path / "out")
    detect(spark, pattern, sink, cp)
    assert plan() == []
    write(path, said("user", "stop"), said("assistant", "ok"), said("user", "no, do not guess"), mode="a")
    expected = plan()
    assert {r for r, _ in expected} == {"stop", "no, do not guess"} and sum(e for _, e in expected) == 1
    assert plan() == expected  # nothing was taken up
    detect(spark, pattern, sink, cp)
    done, left = spark.read.parquet(str(tmp_path / "out/proposals")), spark.read.parquet(str(tmp_path / "out/backlog"))
    last = done.agg(F.max("batch")).first()[0]
    assert sorted([(r.reply, True) for r in done.filter(F.col("batch") == last).collect()] + [(r.reply, False) for r in left.filter(F.col("batch") == last).collect()]) == expected


def test_memory_is_bounded_and_history_is_not_read(spark, tmp_path):
    path, pattern, cp = str(tmp_path / "projects/a/s.jsonl"), str(tmp_path / "projects/*/*.jsonl"), str(tmp_path / "cp")
    sink = ProposalSink(str(tmp_path / "out"), most=50, bound=5, approved_median=20.0, memory=3)
    for i in range(4):
        write(path, *[x for k in range(2) for x in (said("assistant", "x"), said("user", f"no {i}{k}, please"))], mode="a")
        detect(spark, pattern, sink, cp)
    kept = sorted(os.listdir(tmp_path / "out/seen"))
    assert len(kept) == 2 and sorted(os.listdir(tmp_path / "out/backlog")) == kept
    seen = spark.read.parquet(str(tmp_path / f"out/seen/{kept[-1]}"))
    assert seen.count() == 3
    assert spark.read.parquet(str(tmp_path / "out/proposals")).count() == 8
    write(path, said("assistant", "x"), said("user", "no 31, please"), mode="a")  # one of the last three
    detect(spark, pattern, sink, cp)
    assert spark.read.parquet(str(tmp_path / "out/proposals")).count() == 8


def test_pending_text_expires(spark, tmp_path):
    import time

    path, pattern, out = str(tmp_path / "projects/a/s.jsonl"), str(tmp_path / "projects/*/*.jsonl"), str(tmp_path / "out")

    def take():
        stream = pushback.paired(pushback.tail(spark, pattern), ttl_ms=1500)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    write(path, said("assistant", "first"))
    take()
    time.sleep(2)
    write(path, said("user", "late"), said("assistant", "second"), said("user", "in time"), mode="a")
    take()
    assert [(r.assistant, r.reply) for r in spark.read.parquet(out).collect()] == [("second", "in time")]


def test_offsets_stay_where_a_complete_line_is_broken(spark, tmp_path):
    path, pattern, cp = str(tmp_path / "projects/a/s.jsonl"), str(tmp_path / "projects/*/*.jsonl"), str(tmp_path / "cp")
    sink = ProposalSink(str(tmp_path / "out"), approved_median=20.0)
    write(path, said("assistant", "x"))
    detect(spark, pattern, sink, cp)
    write(path, said("user", "no, stop"), "{broken", mode="a")
    with pytest.raises(Exception, match="not JSON"):
        detect(spark, pattern, sink, cp)
    good = open(path).read().replace("{broken", json.dumps(said("assistant", "y")))
    open(path, "w").write(good)
    detect(spark, pattern, sink, cp)
    assert [r.reply for r in spark.read.parquet(str(tmp_path / "out/proposals")).collect()] == ["no, stop"]
