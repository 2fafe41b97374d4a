"""Texts that begin another text of their group, found by one global sort.

In byte order all texts that begin with p stand together directly after p. So p begins some
full text of its group exactly if the first full text after it does so. Texts of all groups
are range-partitioned and sorted together by group, text and kind; a task walks its part once
and keeps only the lengths of the texts that still wait, each of which begins the next. What
waits at a part's end is compared with the first full text of the next part that has one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import map_rows, settle

#: Kinds of rows that a part gives: a text that begins a full one, what waits at its end, and its first full text.
_HIT, _OPEN, _FIRST = 0, 1, 2


def walk(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(kind, part, lengths, *group, text) from one sorted part of (*group, text, is_full, is_wanted)."""
    part = TaskContext.get().partitionId()
    group, last, waiting, first = None, "", [], True
    for *own, text, full, wanted in rows:
        if own != group:
            waiting = []
        while waiting and not text.startswith(last[: waiting[-1]]):
            waiting.pop()
        group, last = own, text
        if wanted:
            waiting.append(len(text))
        if full:
            if first:
                yield _FIRST, part, None, *own, text
                first = False
            for n in waiting:
                yield _HIT, part, None, *own, text[:n]
            waiting = []
    if waiting:
        yield _OPEN, part, waiting, *group, last


def beginnings(texts: DataFrame, group: Sequence[str], text: str, full: str, wanted: str, parts: int | None = None) -> DataFrame:
    """(group, text) of the wanted texts that begin, or equal, a full text of their group.

    Each (group, text) stands once in `texts`, with two flags: it is a full text, it is
    wanted; it may be both. Null groups are a group. Bytes shuffled are those of the texts,
    once; the driver reads two numbers of each part.
    """
    spark = texts.sparkSession
    names = [f"_g{i}" for i in range(len(group))]
    own = texts.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col(text).alias("_text"), F.col(full).alias("_full"), F.col(wanted).alias("_wanted"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, *names, "_text").sortWithinPartitions(*names, "_text")
    fields = [T.StructField("_kind", T.IntegerType()), T.StructField("_part", T.IntegerType()), T.StructField("_lengths", T.ArrayType(T.IntegerType()))]
    walked = settle(map_rows(dealt, walk, T.StructType([*fields, *[own.schema[n] for n in (*names, "_text")]])), "prefixes")
    hits = walked.filter(F.col("_kind") == _HIT).select(*names, "_text")
    edges = sorted((r[0], r[1]) for r in walked.filter(F.col("_kind") != _HIT).select("_part", "_kind").collect())  # two rows a part at most
    after = {p: next((q for q, k in edges if q > p and k == _FIRST), None) for p, k in edges if k == _OPEN}
    pairs = [(p, q) for p, q in after.items() if q is not None]
    if pairs:
        ends = walked.filter(F.col("_kind") == _OPEN).join(F.broadcast(spark.createDataFrame(pairs, "_part int, _next int")), "_part")
        heads = walked.filter(F.col("_kind") == _FIRST).select(F.col("_part").alias("_next"), *[F.col(n).alias(f"{n}n") for n in names], F.col("_text").alias("_textn"))
        same = [F.col(n).eqNullSafe(F.col(f"{n}n")) for n in names]
        met = ends.join(heads, ["_next"]).filter(_all(same)).select(*names, "_textn", F.explode(F.transform("_lengths", lambda n: F.substring("_text", F.lit(1), n))).alias("_text"))
        hits = hits.unionByName(met.filter(F.startswith("_textn", "_text")).select(*names, "_text"))
    return hits.select(*[F.col(n).alias(g) for g, n in zip(group, names, strict=True)], F.col("_text").alias(text))


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
