"""Logs of many files: what tasks, offsets and a batch's pairs cost does not follow the number of files."""

import base64
import json
import os
import pickle
import tracemalloc
import zlib

from colloquy.sources import log_lines
from colloquy.sources.jsonl_tail import PendingReader, TailReader, digests
from colloquy.streaming.pushback import ProposalSink, committed, detect, dry_run, paired, tail

from .test_sources import said, write


def many(tmp_path, n=300):
    paths = [str(tmp_path / f"projects/p{i % 3}/s{i:03}.jsonl") for i in range(n)]
    for i, p in enumerate(paths):
        write(p, said("assistant", f"a{i}"), said("user", f"u{i}"))
        os.utime(p, (1_000_000, 1_000_000))
    return sorted(paths), str(tmp_path / "projects/*/*.jsonl")


def test_pieces_share_tasks(tmp_path):
    paths, _ = many(tmp_path)
    options = {"root": str(tmp_path / "projects"), "piecebytes": "40"}
    every = log_lines._LineReader(options | {"tasks": "4"})
    parts = every.partitions()
    assert 1 <= len(parts) <= 4 and sum(len(p.pieces) for p in parts) > 2 * len(paths)
    got = [(p, v) for part in parts for b in every.read(part) for p, v in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True)]
    assert got == [(p, line) for p in paths for line in open(p).read().splitlines()]


def test_files_share_tasks(tmp_path):
    paths, pattern = many(tmp_path)
    reader = TailReader({"path": pattern, "tasks": "8"})
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert len(parts) <= 8
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[0] for r in rows] == [p for p in paths for _ in range(2)]
    write(paths[7], said("user", "two"), mode="w")
    (reset,) = reader.partitions(end, reader.latestOffset())
    assert reset.reset and reset.path == paths[7]


def test_tasks_get_no_list_of_files_and_offsets_are_packed(tmp_path):
    paths, pattern = many(tmp_path)
    reader = TailReader({"path": pattern})
    end = reader.latestOffset()
    assert len(pickle.dumps(reader)) < 1000 and len(json.dumps(end)) < 100 * len(paths)
    pending = PendingReader({"path": pattern, "startingOffsets": json.dumps(end)})
    (nothing,) = pending.partitions()
    assert nothing.path == "" and list(pending.read(nothing)) == []
    assert len(pickle.dumps(pending)) < 2000


def test_offsets_of_earlier_checkpoints_still_count(tmp_path):
    import hashlib

    paths, pattern = many(tmp_path, 5)
    old = {}
    for p in paths:
        whole = open(p, "rb").read()
        old[p] = {"taken": len(whole), "digests": [hashlib.sha256(whole).hexdigest()] * 2, "mark": None}
    write(paths[3], said("user", "more"), mode="a")
    reader = TailReader({"path": pattern})
    (piece,) = reader.partitions({"files": json.dumps(old)}, reader.latestOffset())
    assert (piece.path, piece.start, piece.reset) == (paths[3], old[paths[3]]["taken"], False)


def test_a_batch_is_evaluated_once(spark, tmp_path):
    """State of a batch may be loaded by one task at a time, so no two plans may compute its pairs at once."""
    made = spark.sparkContext.accumulator(0)

    def pair(i):
        made.add(1)
        return f"/p/{i}", "p", i, "x", f"no {i}, please", ""

    rows = spark.sparkContext.parallelize(range(20), 2).map(pair)
    pairs = spark.createDataFrame(rows, "path string, project string, reply_start bigint, assistant string, reply string, ts string")
    ProposalSink(str(tmp_path / "out"), most=3, bound=50)(pairs, 0)
    assert made.value == 20 and spark.read.parquet(str(tmp_path / "out/proposals")).count() == 3
    assert sorted(os.listdir(tmp_path / "out")) == ["backlog", "proposals", "seen"]


def test_offsets_name_snapshots_that_do_not_grow(tmp_path):
    paths, pattern = many(tmp_path)
    options = {"path": pattern, "tasks": "8", "states": str(tmp_path / "states")}
    reader = TailReader(options)
    end = reader.latestOffset()
    assert len(json.dumps(end)) < 100 and reader.latestOffset() == end and os.listdir(tmp_path / "states") == [end["snapshot"]]
    parts = reader.partitions(reader.initialOffset(), end)
    assert [r[0] for p in parts for r in reader.read(p)] == [p for p in paths for _ in range(2)]
    assert sum(len(pickle.dumps(p)) for p in parts) < 20 * len(paths)
    write(paths[7], said("user", "more"), mode="a")
    pending = PendingReader(options | {"startingOffsets": json.dumps(end)})
    (piece,) = pending.partitions()
    assert [json.loads(r[3])["message"]["content"] for r in pending.read(piece)] == ["more"] and os.listdir(tmp_path / "states") == [end["snapshot"]]
    assert TailReader(options).partitions(end, TailReader({"path": pattern}).latestOffset()) == [piece]


def test_planning_holds_no_list_of_files(tmp_path):
    def peak(n):
        """Most bytes that planning a dry run over n files, in as many folders of 50, takes at once."""
        for i in range(n):
            write(str(tmp_path / f"{n}/p{i // 50:03}/s{i:04}.jsonl"), said("user", f"u{i}"))
        options = {"path": str(tmp_path / f"{n}/*/*.jsonl"), "tasks": "8", "states": str(tmp_path / f"states{n}")}
        start = json.dumps(TailReader(options).latestOffset())
        for i in range(n):
            write(str(tmp_path / f"{n}/p{i // 50:03}/s{i:04}.jsonl"), said("user", f"more {i}"), mode="a")
        tracemalloc.start()
        try:
            parts = PendingReader(options | {"startingOffsets": start}).partitions()
            assert sum(len(list(p.pieces)) for p in parts) == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(300)
    assert peak(3000) - peak(1000) < 300 * 2000


def test_snapshots_of_batches_long_committed_go(tmp_path):
    paths, pattern = many(tmp_path, 3)
    options = {"path": pattern, "states": str(tmp_path / "states"), "retain": "1"}
    reader, ends = TailReader(options), []
    for i in range(4):
        write(paths[0], said("user", f"more {i}"), mode="a")
        ends.append(reader.latestOffset())
        os.utime(tmp_path / "states" / ends[-1]["snapshot"], (2_000_000 + i, 2_000_000 + i))
    reader.commit(ends[2])  # the batch after it has begun
    assert set(os.listdir(tmp_path / "states")) == {e["snapshot"] for e in ends[1:]}
    reader.commit({"files": ""})


def test_offsets_packed_as_a_whole_still_count(tmp_path):
    paths, pattern = many(tmp_path, 5)
    write(str(tmp_path / "projects/p0-a/s.jsonl"), said("user", "in a folder whose name begins with another's"))
    paths.append(str(tmp_path / "projects/p0-a/s.jsonl"))
    old = {}
    for p in paths:
        old[p] = {"taken": os.path.getsize(p), "digests": digests(p, os.path.getsize(p)), "mark": None}
    packed = {"files": base64.b64encode(zlib.compress(json.dumps(old).encode())).decode()}
    for i in (0, 5):
        write(paths[i], said("user", "more"), mode="a")
    for options in ({"path": pattern}, {"path": pattern, "states": str(tmp_path / "states")}):
        reader = TailReader(options)
        assert sorted((p.path, p.start, p.reset) for p in reader.partitions(packed, reader.latestOffset())) == sorted((paths[i], old[paths[i]]["taken"], False) for i in (0, 5))


def test_checkpoints_take_up_snapshots(spark, tmp_path):
    """A checkpoint whose offsets list the files goes on; later offsets have a snapshot's name, and a dry run reads it and writes none."""
    path, pattern, cp = str(tmp_path / "projects/a/s.jsonl"), str(tmp_path / "projects/*/*.jsonl"), str(tmp_path / "cp")
    sink = ProposalSink(str(tmp_path / "out"), most=9, approved_median=20.0)
    write(path, said("assistant", "x"), said("user", "no, use tabs"), said("assistant", "y"))
    stream = paired(tail(spark, pattern), sink.lexicon)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    assert "files" in json.loads(committed(spark, cp)[1])
    for reply in ("no, do not guess", "no, read it first"):
        write(path, said("user", reply), said("assistant", "z"), mode="a")
        held = set(os.listdir(cp + "/files")) if os.path.exists(cp + "/files") else None
        assert [r.reply for r in dry_run(spark, pattern, sink, cp).collect()] == [reply]
        assert (set(os.listdir(cp + "/files")) if os.path.exists(cp + "/files") else None) == held
        detect(spark, pattern, sink, "file://" + cp)
        assert list(json.loads(committed(spark, cp)[1])) == ["snapshot"]
    assert sorted(r.reply for r in spark.read.parquet(str(tmp_path / "out/proposals")).collect()) == ["no, do not guess", "no, read it first", "no, use tabs"]
