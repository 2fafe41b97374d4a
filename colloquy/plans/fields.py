"""Queries of text functions and nested-document checks, over rows made from the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import BENCH
from ..operators import findings, inventory, proposals
from ..session import table
from ..validate import extraction, migration, schema
from .catalogue import query
from .conversation import _CANDIDATES, _candidates
from .shared_sql import first_word, words

_KNOWN = tuple("/" + w for w in BENCH.approval)


@query(
    "known_commands",
    f"""SELECT command, command IN ({words(_KNOWN)}) OR contains(command, ':') AS known, count(*) AS n
        FROM (SELECT '/' || {first_word('text')} || CASE WHEN doc_id % 7 = 0 THEN ':go' ELSE '' END AS command FROM documents) WHERE command IS NOT NULL GROUP BY ALL""",
)
def known_commands(spark, d):
    command = F.concat(F.lit("/"), text.first_word(F.col("text")), F.when(F.col("doc_id") % 7 == 0, ":go").otherwise(""))
    found = table(spark, d, "documents").select(command.alias("command")).filter("command is not null")
    return found.withColumn("known", text.is_slash_command(F.col("command"), _KNOWN)).groupBy("command", "known").agg(F.count("*").alias("n"))


@query(
    "valid_pull_requests",
    r"""SELECT repo, pr FROM (SELECT source || CASE doc_id % 3 WHEN 0 THEN '/' || lang WHEN 1 THEN '/a b' ELSE '/' || lang || '/x' END AS repo, CASE WHEN doc_id % 4 = 0 THEN '-1' WHEN doc_id % 4 = 1 THEN 'x' ELSE doc_id::varchar END AS pr FROM documents)
       WHERE regexp_full_match(repo, '[A-Za-z0-9._-]+/[A-Za-z0-9._-]+') AND try_cast(pr AS bigint) > 0""",
)
def valid_pull_requests(spark, d):
    k = F.col("doc_id")
    tail = F.when(k % 3 == 0, F.concat(F.lit("/"), "lang")).when(k % 3 == 1, F.lit("/a b")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/x")))
    pr = F.when(k % 4 == 0, "-1").when(k % 4 == 1, "x").otherwise(k.cast("string"))
    return inventory.valid_pull_requests(table(spark, d, "documents").select(F.concat("source", tail).alias("repo"), pr.alias("pr")))


_FLAT = r"trim(regexp_replace(substring(text, 1, 60), '[^A-Za-z]+', ' ', 'g'))"


def _flat():
    return F.trim(F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z]+", " "))


@query("labelled_rules", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'last ' || {_FLAT} ELSE {_FLAT} END AS why, 'use ' || source AS how FROM documents WHERE {_FLAT} <> ''")
def labelled_rules(spark, d):
    again = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n**why:** last "), "_x")).otherwise("")
    body = F.concat(F.lit("intro\n**Why:** "), "_x", F.lit("\n**How to apply:** use  "), "source", again)
    rows = table(spark, d, "documents").withColumn("_x", _flat()).filter("_x <> ''").withColumn("_s", text.labelled_sections(body))
    return rows.select("doc_id", F.try_element_at("_s", F.lit("why")).alias("why"), F.try_element_at("_s", F.lit("how to apply")).alias("how"))


@query(
    "quoted_parts",
    """SELECT doc_id, CASE WHEN length(q) BETWEEN 25 AND 400 THEN q END AS quote FROM (SELECT doc_id, replace(replace(replace(substring(text, 1, (doc_id % 500)::int), '"', ''), '“', ''), '”', '') AS q FROM documents)""",
)
def quoted_parts(spark, d):
    inner = F.regexp_replace(F.expr("substring(text, 1, int(doc_id % 500))"), "[\"“”]", "")
    return table(spark, d, "documents").select("doc_id", text.quoted_part(F.concat(F.lit('he said "'), inner, F.lit('" and left'))).alias("quote"))


@query("short_projects", "SELECT doc_id, source || '-' || lang AS project FROM documents")
def short_projects(spark, d):
    slug = F.concat(F.lit("-home--work-"), "source", F.lit("-"), "lang")
    return table(spark, d, "documents").select("doc_id", text.short_project(slug).alias("project"))


_SAFE = r"substring(trim(regexp_replace(regexp_replace(substring(text, 1, 90) || '<b>', '[^\p{L}\p{N} ._''-]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')), 1, 64)"


@query("safe_names", f"SELECT doc_id, {_SAFE} AS name FROM documents")
def safe_names(spark, d):
    return table(spark, d, "documents").select("doc_id", text.safe_name(F.concat(F.substring("text", 1, 90), F.lit("<b>"))).alias("name"))


_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("page_text", r"SELECT page_id, sha256(trim(regexp_replace(" + _ENTITIES.format(x=r"regexp_replace(html, '(?s)<[^>]*>', ' ', 'g')") + r", '[\s\p{Z}]+', ' ', 'g'))) AS digest FROM pages")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.html_to_text(F.col("html")).cast("binary"), 256).alias("digest"))


@query("escaped_html", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def escaped_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")).cast("binary"), 256).alias("digest"))


@query(
    "proposal_readiness",
    f"""WITH {_CANDIDATES} SELECT hash, CASE WHEN conv_id % 2 = 0 THEN 6 ELSE 5 END AS n_unfilled FROM candidates""",
)
def proposal_readiness(spark, d):
    body = proposals.proposal_body(F.col("reply"), F.col("assistant"), F.lit("p"), F.lit("2026-05-01"))
    filled = F.when(F.col("conv_id") % 2 == 0, body).otherwise(F.replace(body, F.lit("**Rationale:** _Fill in._"), F.lit("**Rationale:** because")))
    return _candidates(spark, d).select("hash", F.size(proposals.unfilled_sections(filled)).alias("n_unfilled"))


@query(
    "comment_examples",
    "SELECT source AS repo, doc_id AS pr, 'u' || doc_id AS url, substring(text, 1, 500) AS preview FROM documents ORDER BY length(text) DESC, doc_id LIMIT 5",
)
def comment_examples(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("pr"), F.concat(F.lit("u"), "doc_id").alias("url"), F.col("text").alias("body"))
    return inventory.longest_comments(rows, "pr")


_HINTS = (("shared hosts", ("thequick", "zzzz")), ("common words", ("the", "qqqq")), ("rare words", ("xyzzyx",)), ("endings", ("ing ",)))


@query(
    "uncovered_suggestions",
    " UNION ALL ".join(f"SELECT '{t}' AS title WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE {' OR '.join(f'contains(lower(text), {chr(39)}{h}{chr(39)})' for h in hints)})" for t, hints in _HINTS),
)
def uncovered_suggestions(spark, d):
    rows = spark.createDataFrame([(t, "", list(h)) for t, h in _HINTS], "title string, body string, hints array<string>")
    notes = table(spark, d, "benchmark").select(F.lit("").alias("name"), F.col("text").alias("description"))
    return findings.uncovered(rows, notes).select("title")


@query("most_striking", "SELECT greatest(n_user, n_hour) AS score FROM (SELECT count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations), (SELECT max(n) AS n_hour FROM (SELECT count(*) AS n FROM events GROUP BY extract(hour FROM ts)))")
def most_striking(spark, d):
    users = table(spark, d, "conversations").agg(F.count_if(F.col("role") == "user").alias("n_explicit"))
    hours = table(spark, d, "events").groupBy(F.hour("ts").alias("peak_hour")).agg(F.count("*").alias("peak_hour_n")).orderBy(F.desc("peak_hour_n"), "peak_hour").limit(1)
    return findings.most_striking(users.crossJoin(F.broadcast(hours))).select("score")  # one row each


# ---- nested documents -----------------------------------------------------------------------------

_SCHEMA = {
    "type": "object", "required": ["id", "quality"],
    "properties": {"id": {"type": "integer", "minimum": 10}, "quality": {"type": "integer"}, "tags": {"type": "array", "maxItems": 1, "items": {"type": "string", "pattern": "t[0-9]+"}}},
}


@query(
    "document_errors",
    """SELECT doc_id, path, message FROM (
        SELECT doc_id, '$.id' AS path, 'expected >= 10, got ' || doc_id AS message FROM labels WHERE doc_id < 10
        UNION ALL SELECT doc_id, '$.quality', 'missing required field' FROM labels WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, '$.quality', 'expected integer, got string' FROM labels WHERE doc_id % 3 = 1
        UNION ALL SELECT doc_id, '$.tags', 'expected at most 1 items, got 2' FROM labels WHERE doc_id % 5 = 0
        UNION ALL SELECT doc_id, '$.tags[1]', 'expected to match ''t[0-9]+'', got ''x''' FROM labels WHERE doc_id % 5 = 0)""",
)
def document_errors(spark, d):
    k = F.col("doc_id").cast("string")
    quality = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, ',"quality":"good"').otherwise(F.concat(F.lit(',"quality":'), F.coalesce("quality", F.lit(0)).cast("string")))
    tags = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(',"tags":["t'), k, F.lit('","x"]'))).otherwise(F.concat(F.lit(',"tags":["t'), k, F.lit('"]')))
    docs = table(spark, d, "labels").select("doc_id", F.concat(F.lit('{"id":'), k, quality, tags, F.lit("}")).alias("document"))
    return schema.schema_errors(docs, "doc_id", "document", _SCHEMA)


_SECTIONS = sorted(schema.insights_schema()["required"])


@query(
    "insight_errors",
    "SELECT item_id, '$.' || s AS path, 'missing required field' AS message FROM benchmark, (SELECT unnest([" + ", ".join(f"'{s}'" for s in _SECTIONS) + f"]) AS s, unnest(range({len(_SECTIONS)})) AS i) WHERE i = item_id % {len(_SECTIONS)} OR item_id % 2 = 0",
)
def insight_errors(spark, d):
    whole = {}
    for name, rule in schema.insights_schema()["properties"].items():
        whole[name] = [] if rule["type"] == "array" else {f: [] if (rule["properties"].get(f) or {}).get("type") == "array" else "x" for f in rule["required"]}
    made = [json.dumps({k: v for k, v in whole.items() if k != s}) for s in _SECTIONS]
    own = F.get(F.array(*[F.lit(m) for m in made]), (F.col("item_id") % len(_SECTIONS)).cast("int"))
    docs = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "{}").otherwise(own).alias("document"))
    return schema.schema_errors(docs, "item_id", "document", schema.insights_schema())


@query(
    "missing_fields",
    "SELECT doc_id, list_filter(['id', 'quality', 'toxic', 'note'], lambda x: NOT list_contains(CASE WHEN doc_id % 2 = 0 THEN ['toxic', 'id'] ELSE ['quality', 'id', 'extra'] END, x)) AS missing FROM labels",
)
def missing_fields(spark, d):
    names = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("toxic"), F.lit("id"))).otherwise(F.array(F.lit("quality"), F.lit("id"), F.lit("extra")))
    return table(spark, d, "labels").select("doc_id", schema.missing_keys(names, ("id", "quality", "toxic", "note")).alias("missing"))


@query(
    "repaired_answers",
    """SELECT item_id, CASE item_id % 4 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '{"a": {"b": 1}, "horizon": 2}' WHEN 2 THEN '{"a": 3}' END AS document FROM benchmark""",
)
def repaired_answers(spark, d):
    answers = {"ask0": '```json\n{"a": 1}\n```', "ask1": '{"a": {"b": 1}},"horizon": 2}', "ask2": 'Here: {"a": 3} and {"b"', "ask3": "nothing"}
    prompts = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("ask"), (F.col("item_id") % 4).cast("string"), F.lit(": "), "text").alias("prompt"))
    return extraction.extract(prompts, "item_id", "prompt", extraction.canned(answers)).select("item_id", "document")


@query(
    "migrated_specs",
    """SELECT item_id, item_id % 3 <> 2 AS ok, item_id % 3 = 0 AS defaulted, CASE WHEN item_id % 3 = 0 THEN '["never ' || item_id || '","b"]' END AS limits FROM benchmark""",
)
def migrated_specs(spark, d):
    legacy = {k: {} for k in migration.LEGACY_FIELDS}
    current = legacy | {"$schema_version": migration.CURRENT} | {s: {"x": 1} for s in migration.ADDED_SECTIONS}
    old = json.dumps(legacy | {"never_rules": [" - never @ID ", {"rule": "2) b"}, ""]})
    own = F.get(F.array(F.lit(old), F.lit(json.dumps(current)), F.lit('{"$schema_version": "v9"}')), (F.col("item_id") % 3).cast("int"))
    docs = table(spark, d, "benchmark").select("item_id", F.replace(own, F.lit("@ID"), F.col("item_id").cast("string")).alias("document"))
    done = migration.migrated(docs, "item_id", "document")
    return done.select("item_id", F.col("spec").isNotNull().alias("ok"), "defaulted", F.get_json_object("spec", "$.constitution.limits").alias("limits"))
