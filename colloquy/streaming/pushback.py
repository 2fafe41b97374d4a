"""Incremental pushback detection: tailing, pairing across micro-batches, the proposal sink, and a dry run.

A piece of a file is paired by the task that reads it. Only its edges go through the state:
the reply that comes before any assistant text of the piece, and the assistant text that
still waits at its end. So a batch's rows are never gathered for a file, and a file's state
takes a few rows a batch.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..functions.lexicon import DETECTOR, Lexicon
from ..operators import proposals
from ..sources.jsonl_tail import JsonlTail
from ..sources.sessions import message_text, project_of
from ..storage import exists, file_system, map_rows, settle

PAIR = "path string, project string, reply_start bigint, assistant string, reply string, ts string"
PENDING = "assistant string, ts string"

#: What a piece gives: whole pairs; a reply to whatever waits; what waits from here on; and that nothing does.
_PAIR, _REPLY, _SAID, _NONE = "pair", "reply", "said", "none"
STEP = "path string, project string, start bigint, kind string, assistant string, reply string, ts string"
_Step = namedtuple("_Step", "path project start kind assistant reply ts")

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BacklogOverflow(RuntimeError):
    """More deferred candidates than the bound; nothing of the batch was published."""


def tail(spark: SparkSession, pattern: str, checkpoint: str | None = None, **options: str) -> DataFrame:
    """Streaming turns (path, project, start, role, text, ts, reset) of the files that match pattern.

    With the checkpoint of the query that reads them, what is known of each file lies there, and not in offsets.
    """
    spark.dataSource.register(JsonlTail)
    raw = spark.readStream.format("jsonl_tail").options(path=pattern, **{"tasks": _tasks(spark)} | _states(spark, checkpoint) | options).load()
    return decoded(raw)


def _states(spark: SparkSession, checkpoint: str | None) -> dict[str, str]:
    """The source's options for its snapshots, in a folder of the checkpoint; none where plain file calls do not reach that."""
    if checkpoint is None:
        return {}
    files, target = file_system(spark, checkpoint)
    if files.getScheme() != "file":
        return {}
    return {"states": files.makeQualified(target).toUri().getPath() + "/files", "retain": spark.conf.get("spark.sql.streaming.minBatchesToRetain")}


def _tasks(spark: SparkSession) -> str:
    """How many tasks the files of a batch are dealt to."""
    return str(4 * spark.sparkContext.defaultParallelism)


def decoded(raw: DataFrame) -> DataFrame:
    entry = raw.withColumn("entry", F.try_parse_json("value"))
    get = lambda at: F.try_variant_get("entry", at, "string")
    return entry.select("path", project_of(F.col("path")).alias("project"), "start", get("$.type").alias("role"), message_text(F.col("entry")).alias("text"),
                        F.coalesce(get("$.timestamp"), get("$.ts"), F.lit("")).alias("ts"), "reset")


def pair_piece(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Steps (STEP) of turns (path, project, start, role, text, ts, reset) that come in order, file by file."""
    path = project = said = when = None
    start, open_edge = 0, True  # open_edge: what waited before this piece may still be replied to

    def ending():
        if said is not None:
            yield path, project, start, _SAID, said, None, when

    for own, own_project, at, role, words, ts, reset in rows:
        if own != path:
            yield from ending()
            path, project, said, open_edge = own, own_project, None, True
        if reset:
            said, open_edge = None, False
            yield path, project, at, _NONE, None, None, None
        elif role == "assistant" and words:
            if open_edge:
                yield path, project, at, _NONE, None, None, None
            said, when, start, open_edge = words, ts, at, False
        elif role == "user":
            if open_edge:
                yield path, project, at, _REPLY, None, words, ts
            elif said is not None and words:
                yield path, project, at, _PAIR, said, words, when or ts
            said, open_edge = None, False
    yield from ending()


def replay(steps: Iterable, waiting: tuple[str, str] | None) -> tuple[list[tuple], tuple[str, str] | None]:
    """Pairs that the edges of a file's pieces make with what waits, and what waits then."""
    out = []
    for step in sorted(steps, key=lambda s: (s.start, s.kind != _NONE)):
        if step.kind == _REPLY and waiting and step.reply:
            out.append((step.path, step.project, step.start, waiting[0], step.reply, waiting[1] or step.ts))
        waiting = (step.assistant, step.ts or "") if step.kind == _SAID else None
    return out, waiting


class PendingText(StatefulProcessor):
    """For each file what the assistant said last and nobody has replied to, optionally for a time only."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", PENDING, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        edges = []
        for r in rows:
            if r.kind == _PAIR:
                yield Row(path=r.path, project=r.project, reply_start=r.start, assistant=r.assistant, reply=r.reply, ts=r.ts)
            else:
                edges.append(r)
        if not edges:
            return
        before = tuple(self.pending.get()) if self.pending.exists() else None
        made, after = replay(edges, before)
        for path, project, start, assistant, reply, ts in made:
            yield Row(path=path, project=project, reply_start=start, assistant=assistant, reply=reply, ts=ts)
        if after:
            self.pending.update(after)
        elif before:
            self.pending.clear()

    def close(self) -> None:
        pass


def steps(turns: DataFrame) -> DataFrame:
    return map_rows(turns.select("path", "project", "start", "role", "text", "ts", "reset"), pair_piece, T._parse_datatype_string(STEP))


def paired(turns: DataFrame, lexicon: Lexicon = DETECTOR, ttl_ms: int | None = None) -> DataFrame:
    """Streaming pairs; automated replies use up the assistant's text without making a pair.

    State is kept in RocksDB; with ttl_ms an assistant text waits no longer than that.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "ProcessingTime" if ttl_ms else "None"
    found = steps(turns).groupBy("path").transformWithState(PendingText(ttl_ms), PAIR, "append", mode)
    return found.filter(~text.is_auto_wake_strict(F.col("reply"), lexicon.wake_prefixes))


@dataclass
class ProposalSink:
    """foreachBatch sink: at most `most` new proposals a batch, the rest deferred, each reply once.

    Tables under `path`, each written by batch number, so a batch that runs again replaces
    its own output: proposals/batch=N; backlog/batch=N, the whole backlog after that batch, at
    most `bound` rows; seen/batch=N, the hashes of the `memory` replies proposed last. A batch
    reads the latter two of the batch before it, so what it reads does not grow with history;
    older ones are deleted. A reply that the memory has lost may be proposed again. Rules are
    descriptions that already cover a reply.
    """

    path: str
    most: int = 10
    bound: int = 200
    min_confidence: float = 0.4
    approved_median: float | None = None
    rules: DataFrame | None = None
    lexicon: Lexicon = DETECTOR
    memory: int = 10_000

    COLUMNS = ("hash", "confidence", "class", "assistant", "reply", "project", "ts")
    _ROW = "hash string, confidence double, class string, assistant string, reply string, project string, ts string"

    def _batches(self, spark: SparkSession, name: str) -> list[int]:
        """Numbers of the batches that have this table, ascending; those that were begun and not finished are left out."""
        if not exists(spark, f"{self.path}/{name}"):
            return []
        files, target = file_system(spark, f"{self.path}/{name}")
        return sorted(int(n[6:]) for s in files.listStatus(target) if (n := s.getPath().getName()).startswith("batch=") and exists(spark, f"{self.path}/{name}/{n}/_SUCCESS"))

    def _before(self, spark: SparkSession, name: str, schema: str, batch: int) -> DataFrame:
        """The table of the last batch before this one."""
        known = [n for n in self._batches(spark, name) if n < batch]
        return spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={known[-1]}") if known else spark.createDataFrame([], schema)

    def decide(self, pairs: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """(candidates with rank flag `emitted`, hashes seen before (hash, batch)); nothing is written."""
        spark = pairs.sparkSession
        waiting, seen = self._before(spark, "backlog", self._ROW, batch), self._before(spark, "seen", "hash string, batch bigint", batch)
        fresh = proposals.candidates(pairs, self.lexicon, self.min_confidence, self.approved_median)
        if self.rules is not None:
            hit = proposals.covered(fresh, self.rules, "hash", "rule")
            fresh = fresh.join(hit.select("hash").distinct(), "hash", "left_anti")
        pool = proposals.merge_backlog(waiting.select(*self.COLUMNS), fresh.select(*self.COLUMNS)).join(seen.select("hash"), "hash", "left_anti")
        return proposals.split_spill(pool, self.most, "source", F.desc("confidence"), "hash").select(*self.COLUMNS, "emitted"), seen

    def __call__(self, pairs: DataFrame, batch: int) -> None:
        spark = pairs.sparkSession
        # the plans below read the pairs several times and at once, while a batch's state may be loaded by one task at a time
        taken = f"{self.path}/taken"
        pairs.write.mode("overwrite").parquet(taken)
        split = None
        try:
            split, seen = self.decide(spark.read.schema(pairs.schema).parquet(taken), batch)
            split = split.persist()
            if split.filter("not emitted").count() > self.bound:
                raise BacklogOverflow(f"batch {batch}: more than {self.bound} deferred candidates; nothing was published")
            done = split.filter("emitted")
            known = seen.unionByName(done.select("hash", F.lit(batch).cast("bigint").alias("batch"))).orderBy(F.desc("batch"), "hash").limit(self.memory)
            deferred = split.filter("not emitted")
            # each of these tables has a bound, so one file holds it
            for name, rows in (("proposals", done.select(*self.COLUMNS)), ("backlog", deferred.select(*self.COLUMNS)), ("seen", known)):
                rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        finally:
            if split is not None:
                split.unpersist()
            files, target = file_system(spark, taken)
            files.delete(target, True)
        for name in ("backlog", "seen"):
            for old in [n for n in self._batches(spark, name) if n < batch][:-1]:
                files, target = file_system(spark, f"{self.path}/{name}/batch={old}")
                files.delete(target, True)


def detect(spark: SparkSession, pattern: str, sink: ProposalSink, checkpoint: str, **options: str):
    """Take up what is new in the files, once, and return the finished query."""
    stream = paired(tail(spark, pattern, checkpoint, **options), sink.lexicon)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# ---- dry run -------------------------------------------------------------------------------------


def committed(spark: SparkSession, checkpoint: str) -> tuple[int, str | None]:
    """(number of the last committed batch, its offset as JSON); (-1, None) where there is none."""
    if not exists(spark, f"{checkpoint}/commits"):
        return -1, None
    files, target = file_system(spark, f"{checkpoint}/commits")
    done = [int(n) for s in files.listStatus(target) if (n := s.getPath().getName()).isdigit()]
    if not done:
        return -1, None
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{max(done)}", wholetext=True).collect()]
    return max(done), lines[0].strip().split("\n")[2]  # version, settings, then the one source's offset


def _replay_files(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The pairs of steps that come file by file."""
    for _, own in groupby(map(_Step._make, rows), key=lambda s: s.path):
        yield from replay(own, None)[0]


def pending_pairs(spark: SparkSession, pattern: str, checkpoint: str, lexicon: Lexicon = DETECTOR) -> DataFrame:
    """The pairs that the next run on this checkpoint would make; offsets and state stay as they are."""
    batch, offset = committed(spark, checkpoint)
    spark.dataSource.register(JsonlTail)
    raw = spark.read.format("jsonl_tail").options(path=pattern, startingOffsets=offset or "earliest", tasks=_tasks(spark), **_states(spark, checkpoint)).load()
    found = settle(steps(decoded(raw)), "pending-steps")  # read twice below, while reading the logs takes a look at every file
    whole = found.filter(F.col("kind") == _PAIR).select("path", "project", F.col("start").alias("reply_start"), "assistant", "reply", "ts")
    edges = found.filter(F.col("kind") != _PAIR)
    if batch >= 0:
        state = spark.read.format("statestore").option("stateVarName", "pending").option("batchId", batch).load(checkpoint)
        said = state.select(F.col("key.path").alias("path"), F.lit(None).cast("string").alias("project"), F.lit(-1).cast("bigint").alias("start"), F.lit(_SAID).alias("kind"),
                            F.col("value.assistant").alias("assistant"), F.lit(None).cast("string").alias("reply"), F.col("value.ts").alias("ts"))
        edges = edges.unionByName(said)
    # a file has a few edges
    ordered = edges.select(*_Step._fields).repartition("path").sortWithinPartitions("path")
    made = map_rows(ordered, _replay_files, T._parse_datatype_string(PAIR))
    return whole.unionByName(made).filter(~text.is_auto_wake_strict(F.col("reply"), lexicon.wake_prefixes))


def dry_run(spark: SparkSession, pattern: str, sink: ProposalSink, checkpoint: str) -> DataFrame:
    """What the next run of detect() would propose and defer (`emitted`); nothing is committed, and nothing written but scratch tables."""
    batch, _ = committed(spark, checkpoint)
    return sink.decide(settle(pending_pairs(spark, pattern, checkpoint, sink.lexicon), "pending-pairs"), batch + 1)[0]
