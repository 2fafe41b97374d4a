import json
import os

import pytest

from colloquy.operators import corpus, inventory
from colloquy.sources import sessions
from colloquy.sources.jsonl_tail import TailReader
from colloquy.sources.review_comments import ReviewComments
from colloquy.streaming.pushback import BacklogOverflow, ProposalSink, detect


def write(path, *entries, mode="w", end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + end)


def said(role, content, ts="2026-05-01T10:00:00Z"):
    return {"type": role, "timestamp": ts, "message": {"role": role, "content": content}}


def test_batch_ingestion(spark, tmp_path):
    root = str(tmp_path / "projects")
    long = "please refactor the parser so that it handles nested blocks well, and add tests for it too"
    write(f"{root}/alpha/s1.jsonl", said("user", long), "", "{not json", "[1]", '{"type":"user","message":null}', {"type": "last-prompt", "lastPrompt": long[:60]},
          said("user", [{"type": "text", "text": "one"}, {"type": "tool_result"}, "raw"]), {"type": "human", "text": "old"}, said("assistant", "hi"))
    write(f"{root}/beta/s2.jsonl", said("user", "You are agent 7"), {"type": "last-prompt", "lastPrompt": "alone"})
    os.symlink(f"{root}/alpha/s1.jsonl", f"{root}/beta/s3.jsonl")
    rows = sessions.corpus(spark, root)
    assert sorted((r.project, r.session, r.line_no, r.source_type, r.text, r.is_human_typed) for r in rows.collect()) == [
        ("alpha", "s1", 1, "user", long, True), ("alpha", "s1", 7, "user", "one\nraw", True), ("alpha", "s1", 8, "human", "old", True),
        ("beta", "s2", 1, "user", "You are agent 7", False), ("beta", "s2", 2, "last-prompt", "alone", True),
    ]
    first = corpus.first_prompts(rows, ["path"], "line_no")
    assert [r.text for r in corpus.human_first(first).collect()] == [long]
    assert corpus.timestamped(rows).count() == 3
    corpus.write_corpora(rows, ["path"], "line_no", str(tmp_path / "out"))
    good, bad = corpus.read_corpus(spark, str(tmp_path / "out"))
    assert good.count() == 5 and bad.count() == 0 and good.filter("line_no = 7").first().text == "one\nraw"
    assert corpus.read_corpus(spark, str(tmp_path / "out"), "first-prompts")[0].count() == 2
    turns = sessions.turns(sessions.session_logs(spark, root))
    assert [r.text for r in turns.filter("line_no = 7").collect()] == ["one"]


def test_notes_plans_reports_comments(spark, tmp_path):
    root = str(tmp_path / "projects")
    write(f"{root}/alpha/memory/a.md", "---\nname: n\ndescription: 'short commits'\ntype: feedback\n---\n**Why:** x")
    write(f"{root}/alpha/memory/deep/b.md", "no front matter")
    write(f"{root}/alpha/memory/MEMORY.md", "---\nname: index\n---\n")
    files = sessions.note_files(spark, root)
    assert [(r.project, r["name"], r.description, r.type, r.body) for r in inventory.notes(files).collect()] == [("alpha", "n", "short commits", "feedback", "**Why:** x")]
    assert [r.description for r in inventory.descriptions(files).collect()] == ["short commits"]
    write(f"{root}/alpha/plans/p.md", "## Phase 1\n## Phase 2\n## Out of scope\n- [ ] a")
    plans = inventory.plans(sessions.plan_files(spark, str(tmp_path / "none"), root, [f"{root}/alpha/plans"]))
    assert [(r.archetype, r.has_oos, r.ac_count, r.phase_count) for r in plans.collect()] == [("multi-phase", True, 1, 2)]
    assert inventory.plan_summary(plans).first().has_oos_pct == 100.0
    write(f"{root}/reports/1.md", "one")
    write(f"{root}/reports/2.md", "two")
    assert sessions.reports(spark, f"{root}/reports").first().packet.split() == ["##", "1", "one", "##", "2", "two"]
    spark.dataSource.register(ReviewComments)
    write(f"{root}/c.jsonl", *[{"repo": "a/b", "pr": 1, "body": "## H\n| P1 |", "author": "me"}, {"repo": "a/b", "pr": 2, "body": "x", "author": "you"}])
    mine = spark.read.format("review_comments").option("path", f"{root}/c.jsonl").option("author", "me").load()
    style = inventory.comment_style(inventory.valid_pull_requests(mine)).first()
    assert (style.n_comments, style.h2_share_pct, style.priority_table_share_pct) == (1, 100.0, 100.0)


def test_tail_reader_offsets(tmp_path):
    path = str(tmp_path / "projects/a/s.jsonl")
    write(path, said("user", "one"), '{"partial', end="")
    reader = TailReader({"path": path})
    start, end = reader.initialOffset(), reader.latestOffset()
    (piece,) = reader.partitions(start, end)
    assert [json.loads(r[3])["message"]["content"] for r in reader.read(piece)] == ["one"]
    assert reader.partitions(end, reader.latestOffset()) == []
    write(path, said("user", "two"), mode="w")
    (reset,) = reader.partitions(end, reader.latestOffset())
    assert reset.reset and [r[4] for r in reader.read(reset)] == [True]
    write(path, "broken}", mode="a")
    (bad,) = reader.partitions(TailReader({"path": path, "startingOffsets": "earliest"}).initialOffset(), reader.latestOffset())
    with pytest.raises(ValueError, match="not JSON"):
        list(reader.read(bad))
    with pytest.raises(ValueError, match="not among"):
        TailReader({"path": path, "onlyPath": "/etc/hosts"}).latestOffset()


def test_files_that_stay_are_not_opened_again(tmp_path, monkeypatch):
    from colloquy.sources import jsonl_tail

    paths = [str(tmp_path / f"projects/a/s{i}.jsonl") for i in range(3)]
    for p in paths:
        write(p, said("user", "one"))
        os.utime(p, (1_000_000, 1_000_000))
    reader, opened = TailReader({"path": str(tmp_path / "projects/*/*.jsonl")}), []
    first = reader.latestOffset()
    for name in ("digests", "last_line_end"):
        monkeypatch.setattr(jsonl_tail, name, lambda path, *more, f=getattr(jsonl_tail, name): opened.append(path) or f(path, *more))
    assert reader.latestOffset() == first and reader.partitions(first, reader.latestOffset()) == [] and opened == []
    write(paths[1], said("user", "two"), mode="a")
    (piece,) = reader.partitions(first, reader.latestOffset())
    assert piece.path == paths[1] and set(opened) == {paths[1]}
    assert TailReader({"path": paths[0]}).partitions(first, first) == []


def test_pull_requests_and_pushed_filters(spark, tmp_path):
    from colloquy.sources.review_comments import newest_pull_requests, review_comments

    root = str(tmp_path / "export")
    write(f"{root}/prs.jsonl", *[{"repo": f"a/r{i % 2}", "pr": i, "created_at": f"2026-01-{i:02d}"} for i in range(1, 30)], "broken", {"pr": 3})
    for e in ("issues", "pulls"):
        write(f"{root}/{e}/c.jsonl", *[{"repo": f"a/r{i % 2}", "pr": i, "author": "me" if i % 3 else "you", "body": "text" if i % 4 else " "} for i in range(1, 30)], "{broken")
    assert newest_pull_requests(f"{root}/prs.jsonl", 2) == {("a/r1", 29), ("a/r0", 28)}
    read = review_comments(spark, root).filter("author = 'me' and endpoint = 'pulls' and pr < 28")
    assert sorted(r.pr for r in read.collect()) == [i for i in range(10, 28) if i % 3 and i % 4]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "= me" not in plan and "= pulls" not in plan  # pushed, not filtered again
    spark.dataSource.register(ReviewComments)
    assert sorted(r.pr for r in spark.read.format("review_comments").option("path", root).option("newest", 1).load().collect()) == [29, 29]


def test_incremental_detection(spark, tmp_path):
    path, pattern = str(tmp_path / "projects/a/s.jsonl"), str(tmp_path / "projects/*/*.jsonl")
    sink = ProposalSink(str(tmp_path / "out"), most=1, bound=5, approved_median=20.0)
    run = lambda: detect(spark, pattern, sink, str(tmp_path / "checkpoint"))
    table = lambda name: sorted((r.batch, r.reply) for r in spark.read.parquet(str(tmp_path / f"out/{name}")).collect())
    write(path, said("assistant", "I used spaces."))
    run()
    write(path, said("user", "no, use tabs"), said("assistant", "Done."), said("user", "stop"), mode="a")
    run()
    assert len([b for b, _ in table("proposals")]) == 1 and {r for _, r in table("proposals")} <= {"no, use tabs", "stop"}
    run()  # nothing new, so nothing is published
    write(path, said("assistant", "Again."), said("user", "no, use tabs"), mode="a")
    run()
    assert sorted(r for _, r in table("proposals")) == ["no, use tabs", "stop"]  # the deferred one, and no repeat
    write(path, *[x for i in range(8) for x in (said("assistant", "x"), said("user", f"no {i} please"))], mode="a")
    with pytest.raises(Exception, match="deferred candidates|BacklogOverflow"):
        run()
    assert len(table("proposals")) == 2
    assert issubclass(BacklogOverflow, RuntimeError)
