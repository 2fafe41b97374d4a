"""From raw session entries to the corpus and its derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, time
from ..functions.lexicon import CORPUS_WAKE_PREFIXES
from ..storage import settle
from .prefixes import beginnings

#: Characters from which a truncated copy is told by its beginning, and from which a first prompt counts as written by hand.
LEAST_PREFIX, LEAST_FIRST = 40, 80


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?<![.… ])[.… ]++$", "")


def drop_cached(rows: DataFrame, session: Sequence[str], is_cached: Column, column: str = "text") -> DataFrame:
    """rows without cached ones that equal, or by 40 characters or more begin, a full text of the same session.

    Blank-only and null cached texts stay. Texts are made distinct first, so one that recurs
    everywhere costs a row a task; short ones are then told by equality, and the others by a
    global sort of all texts (`prefixes.beginnings`), so neither a session nor a beginning that
    many texts share brings them together, and what is shuffled is linear in the texts.
    """
    names = [f"_s{i}" for i in range(len(session))]
    keyed = rows.withColumn("_t", text.squeeze(F.col(column))).withColumn("_cached", F.coalesce(is_cached, F.lit(False)))
    keyed = keyed.withColumn("_p", _trimmed(F.col("_t"))).withColumn("_long", F.length("_p") >= LEAST_PREFIX)
    keyed = keyed.withColumn("_p", F.when(F.col("_cached") & F.col("_long"), F.col("_p")).otherwise(F.col("_t")))
    owner = [F.col(s).alias(n) for s, n in zip(session, names, strict=True)]
    flags = {"_full": ~F.col("_cached"), "_begins": F.col("_cached") & F.col("_long"), "_equals": F.col("_cached") & ~F.col("_long")}
    distinct = keyed.filter("_p <> ''").groupBy(*owner, F.col("_p").alias("_text")).agg(*[F.bool_or(x).alias(c) for c, x in flags.items()])
    distinct = settle(distinct, "texts")
    begun = beginnings(distinct.filter((F.col("_full") | F.col("_begins")) & (F.length("_text") >= LEAST_PREFIX)), names, "_text", "_full", "_begins")
    known = begun.withColumn("_of_long", F.lit(True)).unionByName(distinct.filter("_full and _equals").select(*names, "_text").withColumn("_of_long", F.lit(False)))
    mark = known.withColumn("_mark", F.xxhash64(*names, "_text"))
    cached = keyed.filter("_cached").withColumn("_own", F.xxhash64(*session, "_p"))
    same = [cached[s].eqNullSafe(mark[n]) for s, n in zip(session, names, strict=True)]
    left = cached.join(mark, [F.col("_own") == F.col("_mark"), F.col("_p") == F.col("_text"), F.col("_long") == F.col("_of_long"), *same], "left_anti").drop("_own")
    return keyed.filter("not _cached").unionByName(left).drop("_t", "_cached", "_p", "_long")


def annotate(rows: DataFrame, prefixes: Sequence[str] = CORPUS_WAKE_PREFIXES, column: str = "text") -> DataFrame:
    """rows with is_auto_wake and is_human_typed."""
    wake = text.is_auto_wake(F.col(column), prefixes)
    return rows.withColumn("is_auto_wake", wake).withColumn("is_human_typed", ~wake)


def first_prompts(corpus: DataFrame, session: Sequence[str], order: str) -> DataFrame:
    """The first row of each session, kept by partial aggregation, so no session is sorted in one task."""
    rest = [c for c in corpus.columns if c not in session]
    first = corpus.groupBy(*session).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*session, "_first.*").select(*corpus.columns)


def human_first(first: DataFrame, least: int = LEAST_FIRST) -> DataFrame:
    """First rows that a person typed, of at least `least` characters."""
    return first.filter(F.col("is_human_typed") & (F.length("text") >= least))


def timestamped(corpus: DataFrame) -> DataFrame:
    """Rows with any timestamp text, parseable or not; ts_utc is null where it does not parse."""
    return corpus.filter(F.coalesce("ts", F.lit("")) != "").withColumn("ts_utc", time.parse_iso(F.col("ts")))


def summary(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count("*").alias("n_prompts"), F.count_if("is_human_typed").alias("n_human"), F.count_if("is_auto_wake").alias("n_auto"),
        F.countDistinct("project").alias("n_projects"), F.countDistinct("project", "session").alias("n_sessions"),
    )


#: Where a row of the corpus goes, beside the corpus itself.
ROUTES = ("corpus", "first-prompts", "human-first", "timestamped")

RECORD = "project string, session string, path string, line_no bigint, source_type string, text string, ts string, is_auto_wake boolean, is_human_typed boolean"


def routed(corpus: DataFrame, session: Sequence[str], order: str) -> DataFrame:
    """corpus with `route`, a row for each table that it belongs to.

    First rows are told by their least order, which is aggregated before it is shuffled, so a
    session with very many rows is sorted by no task.
    """
    least = corpus.groupBy(*[F.col(s).alias(f"_{i}") for i, s in enumerate(session)]).agg(F.min(order).alias("_least"))
    same = F.col(order) == F.col("_least")
    for i, s in enumerate(session):
        same = same & F.col(s).eqNullSafe(F.col(f"_{i}"))
    first = F.col("_least").isNotNull()
    into = {"first-prompts": first, "human-first": first & F.col("is_human_typed") & (F.length("text") >= LEAST_FIRST), "timestamped": F.coalesce("ts", F.lit("")) != ""}
    routes = F.array(F.lit("corpus"), *[F.when(x, name) for name, x in into.items()])
    found = corpus.join(least, same, "left").withColumn("route", F.explode(F.array_compact(routes)))
    return found.drop("_least", *[f"_{i}" for i in range(len(session))])


def write_corpora(corpus: DataFrame, session: Sequence[str], order: str, out: str) -> None:
    """The corpus and its first-prompt, human-first and timestamped tables as JSON under `out`/route=..., in one job, and the summary."""
    routed(corpus, session, order).write.mode("overwrite").partitionBy("route").json(f"{out}/tables")
    summary(corpus).write.mode("overwrite").json(f"{out}/summary")


def read_corpus(spark: SparkSession, out: str, route: str = "corpus", schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """(records with text, lines that are no such record) of one written table."""
    lines = spark.read.text(f"{out}/tables/route={route}").filter(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter("_r._bad is null and coalesce(_r.text, '') <> ''").select("_r.*").drop("_bad")
    return good, parsed.filter("_r._bad is not null").select("value")
