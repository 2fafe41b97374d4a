"""Queries over session logs that are made from the conversations: parsing, prompts, turns, discovery, tailing."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import BENCH
from ..operators import corpus
from ..session import table
from ..sources import sessions
from ..storage import exists, local_path, settle
from ..streaming import pushback
from .catalogue import query
from .shared_sql import PAIRS, first_word, marker, words


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in shared storage, by path; deleted when Python ends."""
    return local_path(spark, label)


def json_text(x: Column) -> Column:
    """x as a JSON string, with its quotes."""
    listed = F.to_json(F.array(x))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def lines(turns: DataFrame) -> DataFrame:
    """turns with `line`: entries of all shapes that logs have, by turn."""
    t, kind = json_text(F.col("text")), (F.col("conv_id") + F.col("turn")) % 8
    stamp = F.concat(F.lit('"timestamp":"2026-05-01T10:00:'), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit('Z"'))
    said = lambda role, content: F.concat(F.lit(f'{{"type":"{role}",'), stamp, F.lit(f',"message":{{"role":"{role}","content":'), content, F.lit("}}"))
    blocks = F.concat(F.lit('[{"type":"text","text":'), t, F.lit('},{"type":"tool_result","content":"x"},"tail"]'))
    other = F.concat(F.lit('{"type":"summary","text":'), t, F.lit("}"))
    line = (
        F.when(kind == 6, F.concat(F.lit("{not json "), t))
        .when(F.col("role") == "system", other)
        .when(kind == 3, F.when(F.col("role") == "user", said("user", blocks)).otherwise(said("assistant", blocks)))
        .when((kind == 4) & (F.col("role") == "user"), F.concat(F.lit('{"type":"human","content":"","text":'), t, F.lit("}")))
        .when((kind == 5) & (F.col("role") == "user"), F.concat(F.lit('{"type":"last-prompt",'), stamp, F.lit(',"lastPrompt":'), t, F.lit("}")))
        .when((kind == 7) & (F.col("role") == "user"), F.lit('{"type":"user","message":null}'))
        .when(F.col("role") == "user", said("user", t))
        .otherwise(said("assistant", t))
    )
    return turns.withColumn("line", line)


def files(df: DataFrame, line: str = "line", root: str = "/logs/projects") -> DataFrame:
    """(path, value): one session file for each conversation, lines in order of turns."""
    path = F.concat(F.lit(f"{root}/p"), (F.col("conv_id") % 5).cast("string"), F.lit("/s"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    joined = F.expr(f"listagg({line}, '\n') WITHIN GROUP (ORDER BY turn)")
    return df.groupBy("conv_id").agg(joined.alias("value")).select(path.alias("path"), F.concat("value", F.lit("\n")).alias("value"))


def write_files(df: DataFrame, mode: str = "w") -> None:
    """Write, or append, each row's value to its path; every task writes its own files."""

    def run(rows):
        for r in rows:
            os.makedirs(os.path.dirname(r["path"]), exist_ok=True)
            with open(r["path"], mode, encoding="utf-8") as f:
                f.write(r["value"])

    df.select("path", "value").foreachPartition(run)


def _entries(spark, d):
    return sessions.entries(sessions.lines_of(files(lines(table(spark, d, "conversations")))))


_NUMBERED = """n AS (SELECT *, 'p' || conv_id % 5 AS project, 's' || conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no, (conv_id + turn) % 8 AS kind,
        '2026-05-01T10:00:' || lpad((turn % 60)::varchar, 2, '0') || 'Z' AS stamp FROM conversations)"""


@query(
    "session_entries",
    f"""WITH {_NUMBERED} SELECT project, session, line_no, CASE WHEN role = 'system' THEN 'summary' WHEN role = 'user' AND kind = 4 THEN 'human' WHEN role = 'user' AND kind = 5 THEN 'last-prompt' ELSE role END AS type
        FROM n WHERE kind <> 6""",
)
def session_entries(spark, d):
    """From files on disk, cut into pieces far smaller than they are."""
    root = folder(spark, "entries") + "/projects"
    write_files(files(lines(table(spark, d, "conversations")), root=root))
    return sessions.session_logs(spark, root, piece_bytes=1 << 10).select("project", "session", "line_no", F.try_variant_get("entry", "$.type", "string").alias("type"))


@query(
    "session_prompts",
    f"""WITH {_NUMBERED} SELECT project, session, line_no, CASE kind WHEN 4 THEN 'human' WHEN 5 THEN 'last-prompt' ELSE 'user' END AS source_type, CASE WHEN kind = 3 THEN text || chr(10) || 'tail' ELSE text END AS text,
        CASE WHEN kind <> 4 THEN stamp END AS ts FROM n WHERE role = 'user' AND kind NOT IN (6, 7) AND text <> ''""",
)
def session_prompts(spark, d):
    return sessions.prompts(_entries(spark, d)).select("project", "session", "line_no", "source_type", "text", "ts")


@query(
    "session_turns",
    f"""WITH {_NUMBERED} SELECT project, session, line_no, role, CASE WHEN role = 'user' AND kind = 7 THEN NULL ELSE text END AS text
        FROM n WHERE role <> 'system' AND kind <> 6 AND NOT (role = 'user' AND kind IN (4, 5))""",
)
def session_turns(spark, d):
    return sessions.turns(_entries(spark, d)).select("project", "session", "line_no", "role", "text")


@query(
    "session_discovery",
    f"WITH {_NUMBERED} SELECT project, session, count(*) FILTER (WHERE kind <> 6) AS n_entries FROM n GROUP BY project, session HAVING count(*) FILTER (WHERE kind <> 6) > 0",
)
def session_discovery(spark, d):
    """Logs on disk: files two levels down are read, links and deeper files are not."""
    root = folder(spark, "logs") + "/projects"
    made = files(lines(table(spark, d, "conversations")), root=root)
    write_files(made)
    write_files(made.withColumn("path", F.regexp_replace("path", r"/(s\d+\.jsonl)$", r"/deeper/$1")))
    one = next(os.path.join(root, p, f) for p in sorted(os.listdir(root)) for f in sorted(os.listdir(os.path.join(root, p))) if f.endswith(".jsonl"))
    os.symlink(one, os.path.join(os.path.dirname(one), "link.jsonl"))
    return sessions.session_logs(spark, root).groupBy("project", "session").agg(F.count("*").alias("n_entries"))


@query(
    "recent_sessions",
    f"WITH {_NUMBERED} SELECT project, count(DISTINCT session) AS n_sessions FROM n WHERE conv_id % 2 = 0 AND kind <> 6 GROUP BY project",
)
def recent_sessions(spark, d):
    """Files older than a day given are pruned before they are read."""
    root = folder(spark, "aged") + "/projects"
    made = files(lines(table(spark, d, "conversations")), root=root)
    write_files(made)

    def age(rows):
        for r in rows:
            if int(r["path"].rsplit("/s", 1)[1].removesuffix(".jsonl")) % 2:
                os.utime(r["path"], (86_400, 86_400))

    made.select("path").foreachPartition(age)
    return sessions.session_logs(spark, root, modified_after="2000-01-01T00:00:00").groupBy("project").agg(F.countDistinct("session").alias("n_sessions"))


@query(
    "session_corpus",
    f"""WITH {_NUMBERED}, k AS (SELECT project, session, line_no, kind, trim(regexp_replace(CASE WHEN kind = 3 THEN text || chr(10) || 'tail' ELSE text END, '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM n WHERE role = 'user' AND kind NOT IN (6, 7) AND text <> '')
        SELECT project, session, line_no FROM k WHERE kind <> 5 OR NOT EXISTS (SELECT 1 FROM k f WHERE f.session = k.session AND f.kind <> 5 AND (f.t = k.t OR (length(rtrim(k.t, '.… ')) >= 40 AND starts_with(f.t, rtrim(k.t, '.… ')))))""",
)
def session_corpus(spark, d):
    read = sessions.prompts(_entries(spark, d))
    return corpus.drop_cached(read, ["path"], F.col("source_type") == "last-prompt").select("project", "session", "line_no")


@query(
    "timestamped_prompts",
    """SELECT count(*) AS n, count(*) FILTER (WHERE turn % 3 = 2) AS n_parsed, max(CASE WHEN turn % 3 = 2 THEN TIMESTAMP '2026-05-01 10:00:00' + (turn % 60) * INTERVAL 1 SECOND END) AS last_ts FROM conversations WHERE turn % 3 <> 0""",
)
def timestamped_prompts(spark, d):
    iso = F.concat(F.lit("2026-05-01T10:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("Z"))
    rows = table(spark, d, "conversations").withColumn("ts", F.when(F.col("turn") % 3 == 2, iso).when(F.col("turn") % 3 == 1, "some day").otherwise(""))
    return corpus.timestamped(rows).agg(F.count("*").alias("n"), F.count("ts_utc").alias("n_parsed"), F.max("ts_utc").cast("timestamp_ntz").alias("last_ts"))


_BARE = r"regexp_replace({c}, '^[\s\p{{Z}}]*[#*>-]*[\s\p{{Z}}]*', '')"


def _strict(c: str) -> str:
    inside = " OR ".join(f"contains(substring({_BARE.format(c=c)}, 1, 100), '{p}')" for p in BENCH.wake_prefixes)
    return rf"(coalesce({c}, '') = '' OR regexp_matches({c}, '^[\s\p{{Z}}]*<[a-z][a-z0-9-]+>') OR {inside})"


@query("strict_wake", f"SELECT conv_id, turn, {_strict('text')} AS wake FROM conversations")
def strict_wake(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_auto_wake_strict(F.col("text"), BENCH.wake_prefixes).alias("wake"))


# ---- following logs ------------------------------------------------------------------------------


def _plain_lines(spark, d) -> DataFrame:
    t = json_text(F.col("text"))
    return table(spark, d, "conversations").withColumn("line", F.concat(F.lit('{"type":"'), F.col("role"), F.lit('","message":{"content":'), t, F.lit("}}")))


def _followed(spark, d, label: str, take) -> None:
    """Write the first part of every log, take it up, append the rest, take that up; a last line without its end waits in between."""
    home = folder(spark, label)
    root, every = home + "/projects", _plain_lines(spark, d)
    cut = F.col("turn") < 3
    write_files(files(every.filter(cut), root=root))
    partial = files(every.filter(~cut), root=root).withColumn("value", F.substring("value", 1, 5))
    write_files(partial, "a")
    take(home, f"{root}/*/*.jsonl")
    write_files(files(every.filter(~cut), root=root).withColumn("value", F.expr("substring(value, 6)")), "a")
    take(home, f"{root}/*/*.jsonl")


_UNFILTERED = PAIRS.rsplit(" AND NOT ", 1)[0] + ")"


@query("tailed_pairs", f"WITH {_UNFILTERED} SELECT 'p' || conv_id % 5 AS project, assistant, reply FROM pairs WHERE NOT {_strict('reply')}")
def tailed_pairs(spark, d):
    """Pairs across two runs of the streaming tail, with what waits for a reply kept in the query's state."""
    out = folder(spark, "tailed-out")

    def take(home: str, pattern: str) -> None:
        stream = pushback.paired(pushback.tail(spark, pattern, home + "/checkpoint"), BENCH)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", home + "/checkpoint").trigger(availableNow=True)
        writer.start().awaitTermination()

    _followed(spark, d, "tailed", take)
    return spark.read.parquet(out).select("project", "assistant", "reply")


_ANCHOR = 40.0


_PROPOSED = f"""WITH {_UNFILTERED}, w AS (SELECT *, {first_word('reply')} AS word, length(reply) AS n FROM pairs WHERE NOT {_strict('reply')}),
        c AS (SELECT reply, n, CASE WHEN word IN ({words(BENCH.pushback)}) THEN 'explicit_pushback' WHEN word IN ({words(BENCH.approval)}) THEN 'approval' WHEN n >= {2 * _ANCHOR} AND {marker('reply', BENCH.markers)} THEN 'implicit_pushback' ELSE 'neutral' END AS class FROM w)
        SELECT DISTINCT substring(sha256(reply), 1, 16) AS hash, class, round(CASE class WHEN 'explicit_pushback' THEN 0.9::double ELSE 0.4::double + 0.5::double * least(n / {4 * _ANCHOR}::double, 1.0::double) END, 6) AS confidence FROM c WHERE class LIKE '%pushback'"""


@query("streamed_proposals", _PROPOSED)
def streamed_proposals(spark, d):
    """Every proposal that two runs emit or defer, each reply once; at most five are emitted in a run."""
    home = folder(spark, "proposals")
    sink = pushback.ProposalSink(home, most=5, bound=1_000_000, approved_median=_ANCHOR, lexicon=BENCH)
    _followed(spark, d, "detected", lambda at, pattern: pushback.detect(spark, pattern, sink, at + "/checkpoint"))
    done, backlog = spark.read.parquet(home + "/proposals"), spark.read.parquet(home + "/backlog")
    waiting = backlog.join(backlog.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    emitted = done.groupBy("batch").count().filter("count > 5")
    if not emitted.isEmpty():
        raise RuntimeError("more than five proposals in a run")
    return done.select("hash", "class", "confidence").unionByName(waiting.select("hash", "class", "confidence")).select("hash", "class", F.round("confidence", 6).alias("confidence"))


@query("baseline_tail", "SELECT 'p' || conv_id % 5 AS project, role, text FROM conversations WHERE turn >= 3")
def baseline_tail(spark, d):
    """A tail that starts at the logs' present end gives only what is appended later."""
    out = folder(spark, "baseline-out")

    def take(home: str, pattern: str) -> None:
        stream = pushback.tail(spark, pattern, home + "/checkpoint", startingOffsets="latest")
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", home + "/checkpoint").trigger(availableNow=True)
        writer.start().awaitTermination()

    _followed(spark, d, "baseline", take)
    return spark.read.parquet(out).filter("not reset").select("project", "role", "text")


@query("reset_logs", "SELECT 'p' || conv_id % 5 AS project, count(*) AS n_reset FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn < 3 AND conv_id % 2 = 1) GROUP BY 1")
def reset_logs(spark, d):
    """Logs that are rewritten between two runs give one reset row each, and nothing of what replaced them."""
    out, home = folder(spark, "reset-out"), folder(spark, "reset")
    root = home + "/projects"
    every = _plain_lines(spark, d).filter("turn < 3")
    write_files(files(every, root=root))

    def take() -> None:
        stream = pushback.tail(spark, f"{root}/*/*.jsonl", home + "/checkpoint")
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", home + "/checkpoint").trigger(availableNow=True)
        writer.start().awaitTermination()

    take()
    write_files(files(every.filter("conv_id % 2 = 1").withColumn("line", F.lit('{"type":"user","message":{"content":"rewritten"}}')), root=root))
    take()
    return spark.read.parquet(out).filter("reset").groupBy("project").agg(F.count("*").alias("n_reset"))


def _both_parts(spark, d, label: str) -> tuple[str, str]:
    """(folder, pattern) of logs that are complete."""
    home = folder(spark, label)
    write_files(files(_plain_lines(spark, d), root=home + "/projects"))
    return home, home + "/projects/*/*.jsonl"


@query("dry_run_proposals", _PROPOSED)
def dry_run_proposals(spark, d):
    """What one run proposed, and what a dry run says of the next, which is then made and held against it."""
    home, runs = folder(spark, "dry"), []
    sink = pushback.ProposalSink(home, most=5, bound=1_000_000, approved_median=_ANCHOR, lexicon=BENCH)

    def take(at: str, pattern: str) -> None:
        if runs:
            runs.append(settle(pushback.dry_run(spark, pattern, sink, at + "/checkpoint"), "dry-run"))
        pushback.detect(spark, pattern, sink, at + "/checkpoint")
        if not runs:
            runs.append(settle(spark.read.parquet(home + "/proposals"), "first-run"))

    _followed(spark, d, "dry-logs", take)
    first, planned = runs
    done, left = spark.read.parquet(home + "/proposals"), spark.read.parquet(home + "/backlog")
    last = left.agg(F.max("batch")).first()[0]
    real = done.filter(F.col("batch") == last).select("hash", F.lit(True).alias("emitted")).unionByName(left.filter(F.col("batch") == last).select("hash", F.lit(False).alias("emitted")))
    if not real.exceptAll(planned.select("hash", "emitted")).isEmpty() or real.count() != planned.count():
        raise RuntimeError("the run differs from its dry run")
    every = first.select("hash", "class", "confidence").unionByName(planned.select("hash", "class", "confidence"))
    return every.select("hash", "class", F.round("confidence", 6).alias("confidence"))


@query("remembered_proposals", f"SELECT count(*) AS n_proposed, least(3, count(*)) AS n_remembered FROM ({_PROPOSED})")
def remembered_proposals(spark, d):
    """Of all proposals of a run, as many hashes are remembered as the memory has room for."""
    home, pattern = _both_parts(spark, d, "memory")
    sink = pushback.ProposalSink(home + "/out", most=1_000_000, approved_median=_ANCHOR, lexicon=BENCH, memory=3)
    pushback.detect(spark, pattern, sink, home + "/checkpoint")
    seen = spark.read.parquet(home + "/out/seen").agg(F.count("*").alias("n_remembered"))
    return spark.read.parquet(home + "/out/proposals").agg(F.count("*").alias("n_proposed")).crossJoin(seen)  # one row each


@query("overflowing_backlog", f"SELECT count(*) > 1 AS failed, CASE WHEN count(*) > 1 THEN 0 ELSE count(*) END AS n_published FROM ({_PROPOSED})")
def overflowing_backlog(spark, d):
    """A run that would defer more than the bound fails and publishes nothing."""
    home, pattern = _both_parts(spark, d, "overflow")
    sink, failed = pushback.ProposalSink(home + "/out", most=1, bound=0, approved_median=_ANCHOR, lexicon=BENCH), False
    try:
        pushback.detect(spark, pattern, sink, home + "/checkpoint")
    except Exception as e:  # noqa: BLE001  the stream wraps it
        if "deferred candidates" not in str(e):
            raise
        failed = True
    n = spark.read.parquet(home + "/out/proposals").count() if exists(spark, home + "/out/proposals") else 0
    return spark.createDataFrame([(failed, n)], "failed boolean, n_published bigint")


@query("mended_logs", f"WITH {_UNFILTERED} SELECT 'p' || conv_id % 5 AS project, assistant, reply FROM pairs WHERE NOT {_strict('reply')}")
def mended_logs(spark, d):
    """A complete line that is not JSON fails the run and moves no offset; once it is mended every pair comes, once."""
    home, out = folder(spark, "mended"), folder(spark, "mended-out")
    root, pattern = home + "/projects", home + "/projects/*/*.jsonl"
    every = _plain_lines(spark, d)

    def take() -> None:
        stream = pushback.paired(pushback.tail(spark, pattern, home + "/checkpoint"), BENCH)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", home + "/checkpoint").trigger(availableNow=True)
        writer.start().awaitTermination()

    first, last = files(every.filter("turn < 2"), root=root), files(every.filter("turn >= 2"), root=root)
    write_files(first)
    take()
    broken = last.withColumn("value", F.concat(F.lit('{"type":"summary")\n'), "value"))
    write_files(broken, "a")
    try:
        take()
    except Exception as e:  # noqa: BLE001  the stream wraps it
        if "not JSON" not in str(e):
            raise
    else:
        raise RuntimeError("a broken line was passed over")
    mended = last.withColumn("value", F.concat(F.lit('{"type":"summary"}\n'), "value"))
    whole = first.withColumn("at", F.lit(0)).unionByName(mended.withColumn("at", F.lit(1)))
    write_files(whole.groupBy("path").agg(F.expr("listagg(value, '') WITHIN GROUP (ORDER BY at)").alias("value")))
    take()
    return spark.read.parquet(out).select("project", "assistant", "reply")


@query("one_log", "SELECT role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def one_log(spark, d):
    """The source follows one file alone, which must be among those of the pattern."""
    home, pattern = _both_parts(spark, d, "one")
    out = folder(spark, "one-out")
    least = table(spark, d, "conversations").agg(F.min("conv_id").alias("conv_id"))
    path = files(least.withColumn("turn", F.lit(0)).withColumn("line", F.lit("")), root=home + "/projects").first()["path"]
    stream = pushback.tail(spark, pattern, home + "/checkpoint", onlyPath=path)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", home + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("role", "text")
