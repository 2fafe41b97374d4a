"""Queries that write and read back: corpora by routes, exported review comments, specs of older and broken documents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.lexicon import BENCH
from ..operators import corpus
from ..session import table
from ..sources import review_comments as comments
from ..sources import sessions
from ..validate import migration
from .catalogue import query
from .logs import _NUMBERED, _entries, folder, json_text, write_files
from .shared_sql import WAKE

# ---- corpora ---------------------------------------------------------------------------------------

_PROMPTS = f"""{_NUMBERED}, k AS (SELECT *, CASE WHEN kind = 3 THEN text || chr(10) || 'tail' ELSE text END AS said FROM n WHERE role = 'user' AND kind NOT IN (6, 7) AND text <> ''),
    c AS (SELECT session, line_no, said AS text, kind <> 4 AS timed, line_no = min(line_no) OVER (PARTITION BY session) AS first FROM k)"""


@query(
    "corpus_round_trip",
    f"""WITH {_PROMPTS} SELECT route, count(*) AS n, sum(length(text)) AS chars, 1 AS n_bad FROM (
        SELECT 'corpus' AS route, text FROM c UNION ALL SELECT 'first-prompts', text FROM c WHERE first
        UNION ALL SELECT 'human-first', text FROM c WHERE first AND length(text) >= 80 AND NOT {WAKE} UNION ALL SELECT 'timestamped', text FROM c WHERE timed) GROUP BY route""",
)
def corpus_round_trip(spark, d):
    """The corpora as written in one job, with a broken line in each, read back without it."""
    out = folder(spark, "corpora")
    rows = corpus.annotate(sessions.prompts(_entries(spark, d)), BENCH.wake_prefixes)
    corpus.write_corpora(rows, ["path"], "line_no", out)
    found = None
    for route in corpus.ROUTES:
        write_files(spark.createDataFrame([(f"{out}/tables/route={route}/part-x.json", '{"text": broken\n\n{"text": ""}\n')], "path string, value string"))
        good, bad = corpus.read_corpus(spark, out, route)
        own = good.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).withColumn("route", F.lit(route))
        own = own.crossJoin(bad.agg(F.count("*").cast("int").alias("n_bad"))).filter("n > 0")  # one row each
        found = own if found is None else found.unionByName(own)
    return found


# ---- review comments ---------------------------------------------------------------------------------

_PULL = "'o/r' || doc_id % 3 AS repo, 1 + doc_id // 3 % 40 AS pr"


@query(
    "review_comments",
    f"""WITH c AS (SELECT {_PULL}, CASE WHEN doc_id % 5 < 2 THEN 'pulls' ELSE 'issues' END AS endpoint, 'a' || doc_id % 2 AS author, text AS body FROM documents WHERE regexp_matches(text, '\\S')),
        p AS (SELECT DISTINCT repo, pr, '2026-01-' || lpad((1 + pr % 28)::varchar, 2, '0') AS made FROM (SELECT {_PULL} FROM documents)),
        w AS (SELECT repo, pr FROM p ORDER BY made DESC, repo DESC, pr DESC LIMIT 20)
        SELECT repo, pr, endpoint, count(*) AS n, sum(length(body)) AS chars FROM c JOIN w USING (repo, pr) WHERE author = 'a1' AND endpoint = 'pulls' GROUP BY ALL""",
)
def review_comments(spark, d):
    """Comments of one author on the newest pull requests, with the filters pushed into the source."""
    root = folder(spark, "comments")
    pull = table(spark, d, "documents").select("*", F.concat(F.lit("o/r"), (F.col("doc_id") % 3).cast("string")).alias("repo"), (1 + F.floor(F.col("doc_id") / 3) % 40).alias("pr"))
    endpoint = F.when(F.col("doc_id") % 5 < 2, "pulls").otherwise("issues")
    fields = F.struct("repo", "pr", F.concat(F.lit("a"), (F.col("doc_id") % 2).cast("string")).alias("author"), F.col("text").alias("body"))
    path = F.concat(F.lit(root + "/"), endpoint, F.lit("/f"), (F.col("doc_id") % 16).cast("string"), F.lit(".jsonl"))
    # one file holds a sixteenth of the export; its lines are written by one task, as an exporter does
    lines = pull.select(path.alias("path"), F.concat(F.to_json(fields), F.lit("\n")).alias("value"))
    write_files(lines.repartition("path").sortWithinPartitions("path"), "a")
    stamp = F.concat(F.lit("2026-01-"), F.lpad((1 + F.col("pr") % 28).cast("string"), 2, "0"))
    search = pull.select("repo", "pr").distinct().select(F.lit(f"{root}/prs.jsonl").alias("path"), F.concat(F.to_json(F.struct("repo", "pr", stamp.alias("created_at"))), F.lit("\n")).alias("value"))
    write_files(search.coalesce(1), "a")  # 120 rows
    read = comments.review_comments(spark, root).filter("author = 'a1' and endpoint = 'pulls'")
    return read.groupBy("repo", "pr", "endpoint").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


# ---- specs --------------------------------------------------------------------------------------------

_SAID = "list_filter(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda x: trim(x)), lambda x: x <> '')"
_SPECS = f"WITH s AS (SELECT item_id, length(text) % 3 AS kind, {_SAID} AS said FROM benchmark)"


def _documents(spark, d):
    """Older documents that quote the table's texts, current ones, and texts that are no document."""
    said = F.filter(F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. "), F.trim), lambda x: x != "")
    legacy = json.dumps({k: {} for k in migration.LEGACY_FIELDS if k not in ("never_rules", "decision_policy")})
    current = json.dumps({"$schema_version": migration.CURRENT} | {s: {"x": 1} for s in migration.ADDED_SECTIONS})
    quoting = lambda base, name: F.concat(F.lit(base[:-1] + f', "{name}": '), F.to_json("said"), F.lit(', "decision_policy": {"escalate": '), F.to_json(F.slice("said", 1, 1)), F.lit("}}"))
    rows = table(spark, d, "benchmark").withColumn("said", said).withColumn("kind", F.length("text") % 3)
    document = F.when(F.col("kind") == 0, quoting(legacy, "never_rules")).when(F.col("kind") == 1, quoting(current, "said")).otherwise(F.col("text"))
    return rows.select("item_id", document.alias("document"), F.concat(F.lit("user "), json_text(F.col("item_id").cast("string"))).alias("person"))


@query(
    "degraded_specs",
    f"""{_SPECS} SELECT item_id, kind <> 1 AS defaulted, CASE kind WHEN 2 THEN 'not JSON' END AS problem, CASE kind WHEN 0 THEN to_json(said[1:5])::varchar WHEN 2 THEN '[]' END AS limits,
        CASE kind WHEN 0 THEN 'never_rules' WHEN 2 THEN 'caution' END AS limits_from, CASE kind WHEN 0 THEN to_json(said[1:1])::varchar WHEN 2 THEN '["Whatever cannot be undone"]' END AS reserved FROM s""",
)
def degraded_specs(spark, d):
    done = migration.migrated(_documents(spark, d), "item_id", "document", name="person")
    at = lambda path, name: F.get_json_object("spec", f"$.{path}").alias(name)
    return done.select("item_id", "defaulted", "problem", at("constitution.limits", "limits"), F.col("sources")["constitution.limits"].alias("limits_from"), at("substitution_contract.user_reserved_authority", "reserved"))


@query("strict_specs", f"""{_SPECS} SELECT item_id, kind = 1 AS ok, CASE kind WHEN 0 THEN 'sections missing' WHEN 2 THEN 'not JSON' END AS problem, CASE WHEN kind = 1 THEN to_json(said)::varchar END AS said FROM s""")
def strict_specs(spark, d):
    done = migration.migrated(_documents(spark, d), "item_id", "document", strict=True)
    return done.select("item_id", F.col("spec").isNotNull().alias("ok"), F.regexp_extract("problem", "^(sections missing|not JSON)", 1).alias("problem"), F.get_json_object("spec", "$.said").alias("said"))
