"""Queries over notes, plans and reports that are made from documents, pages and benchmark items."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import inventory
from ..session import table
from ..sources import sessions
from .catalogue import query
from .logs import folder, write_files
from .shared_sql import pct

_HEAD = r"trim(regexp_replace(substring(text, 1, 60), '[^A-Za-z]+', ' ', 'g'))"


def _notes(spark, d):
    """Notes with front matter in most documents; keys in odd case, quotes and a repeated key among them."""
    k = F.col("doc_id")
    head = F.trim(F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z]+", " "))
    kind = F.get(F.array(*[F.lit(t) for t in (*inventory.NOTE_TYPES, "")]), (k % 5).cast("int"))
    front = F.concat(F.lit("---\nName: n"), k.cast("string"), F.lit("\ndescription: first\ndescription: \""), head, F.lit('"\n'), F.when(kind != "", F.concat(F.lit("type: "), kind, F.lit("\n"))).otherwise(""), F.lit("---\n"))
    value = F.concat(F.when(k % 4 == 3, "").otherwise(front), "text")
    name = F.when(k % 9 == 0, "MEMORY").otherwise(F.concat(F.lit("n"), k.cast("string")))
    project = F.concat(F.lit("p"), (k % 6).cast("string"))
    path = F.concat(F.lit("/h/projects/"), project, F.lit("/memory/d"), k.cast("string"), F.lit("/"), name, F.lit(".md"))
    return table(spark, d, "documents").select(project.alias("project"), path.alias("path"), value.alias("value"))


_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'feedback' WHEN 2 THEN 'project' WHEN 3 THEN 'reference' ELSE 'unknown' END"


@query(
    "note_inventory",
    rf"""SELECT 'p' || doc_id % 6 AS project, 'n' || doc_id AS name, {_HEAD} AS description, {_TYPE} AS type, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body
        FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 9 <> 0""",
)
def note_inventory(spark, d):
    both = _notes(spark, d).unionByName(_notes(spark, d))  # a path that two searches find counts once
    return inventory.notes(both).select("project", "name", "description", "type", F.sha2(F.col("body").cast("binary"), 256).alias("body"))


@query("note_types", f"SELECT type, count(*) AS n FROM (SELECT {_TYPE} AS type FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 9 <> 0) WHERE type IN ('feedback', 'unknown') GROUP BY type")
def note_types(spark, d):
    return inventory.notes(_notes(spark, d)).filter(F.col("type").isin("feedback", "unknown")).groupBy("type").agg(F.count("*").alias("n"))


@query("note_descriptions", "SELECT doc_id, 'first' AS description FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, trim(regexp_extract(substring(text, 1, 2048), '(?m)^description:[ \\t]*(.+)$', 1)) FROM documents WHERE doc_id % 4 = 3 AND regexp_matches(substring(text, 1, 2048), '(?m)^description:[ \\t]*(.+)$')")
def note_descriptions(spark, d):
    found = inventory.descriptions(_notes(spark, d))
    return found.select(F.regexp_extract("path", r"/d(\d+)/", 1).cast("bigint").alias("doc_id"), "description")


_PLAN = r"""(CASE WHEN doc_id % 7 = 0 THEN '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) ELSE '' END || repeat('## Phase x' || chr(10), (doc_id % 4)::int) || CASE WHEN doc_id % 2 = 0 THEN '### Non-goals' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN '## how we know' || chr(10) ELSE '' END || repeat('- [ ] a' || chr(10) || '1. b' || chr(10) || '- [x] c' || chr(10), (doc_id % 3)::int) || text)"""


def _plans(spark, d):
    k = F.col("doc_id")
    value = F.concat(
        F.when(k % 7 == 0, "---\na: b\n---\n").otherwise(""), F.expr("repeat('## Phase x\n', int(doc_id % 4))"), F.when(k % 2 == 0, "### Non-goals\n").otherwise(""),
        F.when(k % 5 == 0, "## how we know\n").otherwise(""), F.expr("repeat('- [ ] a\n1. b\n- [x] c\n', int(doc_id % 3))"), F.col("text"),
    )
    files = table(spark, d, "documents").select(k.cast("string").alias("path"), value.alias("value"), F.length(value).cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("mtime"))
    return inventory.plans(files.unionByName(files))  # found twice, kept once


_PROBED = rf"""SELECT doc_id, v, len(regexp_extract_all(v, '(?mi)^##+\s+(?:Phase|Step|Stage)\b')) AS phases FROM (SELECT doc_id, {_PLAN} AS v FROM documents)"""


@query(
    "plan_probes",
    rf"""SELECT doc_id, CASE WHEN phases >= 2 OR length(v) > 6000 THEN 'multi-phase' ELSE 'surgical' END AS archetype, regexp_matches(v, '(?s)\A---\s*\n.*?\n---\s*\n') AS has_frontmatter,
        regexp_matches(v, '(?mi)^##+\s+(?:out[\s-]?of[\s-]?scope|non[\s-]?goals?|will not)\b') AS has_oos, regexp_matches(v, '(?mi)^##+\s+(?:verification|verification evidence|acceptance|how we know)\b') AS has_verification,
        len(regexp_extract_all(v, '(?m)^[^\S\n]*(?:[-*]\s*\[\s?\]|\d+\.)\s+'))::int AS ac_count, phases::int AS phase_count FROM ({_PROBED})""",
)
def plan_probes(spark, d):
    found = _plans(spark, d).withColumn("doc_id", F.col("path").cast("bigint"))
    return found.select("doc_id", "archetype", "has_frontmatter", "has_oos", "has_verification", "ac_count", "phase_count")


@query(
    "plan_summary",
    rf"""WITH p AS (SELECT v, phases, regexp_matches(v, '(?mi)^##+\s+(?:out[\s-]?of[\s-]?scope|non[\s-]?goals?|will not)\b') AS oos, regexp_matches(v, '(?mi)^##+\s+(?:verification|verification evidence|acceptance|how we know)\b') AS ver,
        len(regexp_extract_all(v, '(?m)^[^\S\n]*(?:[-*]\s*\[\s?\]|\d+\.)\s+')) AS ac FROM ({_PROBED}))
        SELECT count(*) AS n_plans, count(*) FILTER (WHERE phases >= 2 OR length(v) > 6000) AS n_multi_phase, count(*) FILTER (WHERE oos) AS has_oos_count, {pct('count(*) FILTER (WHERE oos)', 'count(*)')} AS has_oos_pct,
        count(*) FILTER (WHERE ver) AS has_verification_count, round_even(sum(ac)::double / count(*), 2) AS avg_ac_count FROM p""",
)
def plan_summary(spark, d):
    return inventory.plan_summary(_plans(spark, d))


@query("front_matter_fields", f"SELECT doc_id, 'n' || doc_id AS name, {_HEAD} AS description FROM documents WHERE doc_id % 4 <> 3")
def front_matter_fields(spark, d):
    read = _notes(spark, d).withColumn("_f", markdown.front_matter(F.col("value"))).filter("_f is not null")
    return read.select(F.regexp_extract("path", r"/d(\d+)/", 1).cast("bigint").alias("doc_id"), F.try_element_at("_f", F.lit("name")).alias("name"), F.try_element_at("_f", F.lit("description")).alias("description"))


# ---- files on disk -----------------------------------------------------------------------------


def _page_files(spark, d, path):
    value = F.concat(F.lit("---\nname: n"), F.col("page_id").cast("string"), F.lit("\n---\n"), "html")
    return table(spark, d, "pages").select(path.alias("path"), value.alias("value"))


@query("note_scan", "SELECT 'p' || page_id % 3 AS project, count(*) AS n FROM pages WHERE page_id % 10 <> 0 GROUP BY 1")
def note_scan(spark, d):
    """Notes of all depths below memory folders, without the index files."""
    root = folder(spark, "notes") + "/projects"
    k = F.col("page_id")
    inner = F.when(k % 10 == 0, F.concat(F.lit("x"), k.cast("string"), F.lit("/MEMORY"))).when(k % 2 == 0, F.concat(F.lit("deep/er/n"), k.cast("string"))).otherwise(F.concat(F.lit("n"), k.cast("string")))
    write_files(_page_files(spark, d, F.concat(F.lit(root + "/p"), (k % 3).cast("string"), F.lit("/memory/"), inner, F.lit(".md"))))
    return inventory.notes(sessions.note_files(spark, root)).groupBy("project").agg(F.count("*").alias("n"))


@query("plan_scan", "SELECT count(*) AS n_files, sum(strlen(html) + strlen('---' || chr(10) || 'name: n' || page_id || chr(10) || '---' || chr(10)))::bigint AS bytes FROM pages WHERE page_id % 4 < 3")
def plan_scan(spark, d):
    """Plans of the home folder, of projects and of a search folder that another search covers too; sizes come from the files."""
    home = folder(spark, "plans")
    k = F.col("page_id")
    place = F.when(k % 4 == 0, "/home/plans/").when(k % 4 == 1, "/projects/p/docs/plans/").when(k % 4 == 2, "/search/a/b/").otherwise("/search/a/b/c/")
    write_files(_page_files(spark, d, F.concat(F.lit(home), place, k.cast("string"), F.lit(".md"))))
    found = sessions.plan_files(spark, home + "/home", home + "/projects", [home + "/search", home + "/search/a"])
    kept = found.filter(~F.col("path").contains("/b/c/"))  # the nearer search folder reaches one level further down
    return kept.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


@query("report_packet", "SELECT sha256(string_agg('## r' || lpad(item_id::varchar, 6, '0') || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY item_id)) AS digest FROM benchmark")
def report_packet(spark, d):
    root = folder(spark, "reports")
    name = F.concat(F.lit(root + "/r"), F.lpad(F.col("item_id").cast("string"), 6, "0"), F.lit(".md"))
    write_files(table(spark, d, "benchmark").select(name.alias("path"), F.col("text").alias("value")))
    return sessions.reports(spark, root).select(F.sha2(F.col("packet").cast("binary"), 256).alias("digest"))


@query("json_documents", "SELECT count(*) AS n, sum(item_id)::bigint AS total FROM benchmark")
def json_documents(spark, d):
    """A statistics document that is there, and one that is not."""
    root = folder(spark, "json")
    whole = table(spark, d, "benchmark").agg(F.to_json(F.struct(F.count("*").alias("n"), F.sum("item_id").alias("total"))).alias("value"), F.lit(root + "/s.json").alias("path"))
    write_files(whole)
    there, gone = (sessions.json_document(spark, os.path.join(root, f), "n bigint, total bigint") for f in ("s.json", "gone.json"))
    return there.unionByName(gone)
