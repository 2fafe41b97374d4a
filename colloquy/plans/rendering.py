"""Queries that render rows of the tables: Markdown, clean HTML, templates, charts, cards, sections, rule files and statistics documents."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ..operators import temporal
from ..render import charts, documents, markup, reports
from ..render.frames import rendered
from ..session import spread, table
from ..sources import sessions
from ..validate import migration
from .catalogue import query
from .exports import _SPECS, _documents
from .conversation import _classified
from .logs import folder
from .shared_sql import CLASSIFIED, quantile

#: Three lower-case words of a text, which need no escaping.
_WORDS = "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents), x AS (SELECT doc_id, w[1] AS a, w[2] AS b, w[3] AS c FROM w WHERE len(w) > 2)"


def _words(spark, d):
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", found.alias("w")).filter(F.size("w") > 2)
    return rows.select("doc_id", *[F.get("w", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query(
    "markdown_as_html",
    f"{_WORDS} SELECT doc_id, '<h3>' || a || '</h3>' || chr(10) || '<ul><li>' || b || '</li><li><strong>' || c || '</strong> x</li></ul>' || chr(10) || '<p><code>' || a || '</code> &amp; &lt;' || b || '&gt;</p>' AS text FROM x",
)
def markdown_as_html(spark, d):
    body = F.concat(F.lit("# "), "a", F.lit("\n\n- "), "b", F.lit("\n- **"), "c", F.lit("** x\n\n`"), "a", F.lit("` & <"), "b", F.lit(">"))
    return rendered(_words(spark, d).select("doc_id", body.alias("body")), markup.to_html, "body")


@query("cleaned_fragments", f"{_WORDS} SELECT doc_id, '<p>' || a || '</p>' || c AS text FROM x")
def cleaned_fragments(spark, d):
    """Attributes, tags that are not allowed, and scripts with what they hold, go; an element that is not closed goes to the end."""
    dirty = F.concat(F.lit('<p onclick="go()">'), "a", F.lit("</p><script>"), "b", F.lit("</script><b>"), "c", F.lit("</b><iframe src=x>"), "b")
    return rendered(_words(spark, d).select("doc_id", dirty.alias("dirty")), markup.clean_html, "dirty")


@query("filled_templates", f"{_WORDS} SELECT doc_id, a || ' and &lt;' || b || '&gt; of _TBD_C_' AS text FROM x")
def filled_templates(spark, d):
    fill = lambda a, b: markup.fill("{{A}} and {{ B }} of {{C}}", markup.escaped({"A": a, "B": f"<{b}>"}))
    return rendered(_words(spark, d).select("doc_id", "a", "b"), fill, "a", "b")


@query("rendered_cards", f"{_WORDS} SELECT doc_id, '<section><h4>' || upper(a[1]) || a[2:] || '</h4><p>' || b || '&lt;&amp;&#x27;' || c || '</p></section>' AS text FROM x")
def rendered_cards(spark, d):
    card = lambda a, b, c: documents.cards_html([{"name": a, "text": f"{b}<&'{c}"}])
    return rendered(_words(spark, d), card, "a", "b", "c")


@query(
    "hour_bars",
    """WITH h AS (SELECT extract(hour FROM ts) AS h, count(*) AS n FROM events GROUP BY 1), f AS (SELECT i AS h, coalesce(n, 0) AS n FROM range(24) r(i) LEFT JOIN h ON h.h = i)
       SELECT lpad(h::varchar, 2, '0') || ' ' || repeat('█', round_even(40.0::double * n / (SELECT max(n) FROM f), 0)::int) || ' ' || n AS line FROM f""",
)
def hour_bars(spark, d):
    """The bars of the day's 24 hours."""
    found = {r.hour: r.n for r in temporal.hour_histogram(table(spark, d, "events"), "ts").collect()}
    return spark.createDataFrame([(line,) for line in charts.hour_text(found).split("\n")], "line string")


@query(
    "stat_documents",
    f"SELECT count(*) AS n, max(length(text)) AS max_chars, {quantile('length(text)', 0.5)} AS median_chars, count(DISTINCT source) AS n_sources FROM documents",
)
def stat_documents(spark, d):
    """The statistics document as it is written, read back."""
    home = folder(spark, "numbers")
    os.makedirs(home)
    docs = spread(table(spark, d, "documents").select("text", "source"))
    reports.write_json(reports.numbers(docs, "source", k=1_000), f"{home}/numbers.json")
    read = sessions.json_document(spark, f"{home}/numbers.json", "n bigint, max_chars bigint, median_chars double, per_project array<array<string>>")
    return read.select("n", "max_chars", F.round("median_chars", 6).alias("median_chars"), F.size("per_project").cast("bigint").alias("n_sources"))


@query(
    "spec_sections",
    f"""{_SPECS} SELECT item_id, '## Substitution contract' || chr(10) || chr(10) || '**User reserved authority:** ' || chr(10) || CASE kind WHEN 0 THEN '- ' || said[1] ELSE '- Whatever cannot be undone' END AS text FROM s WHERE kind <> 1""",
)
def spec_sections(spark, d):
    """A section of each spec, filled in or degraded, as Markdown."""
    done = migration.migrated(_documents(spark, d), "item_id", "document", name="person").filter("defaulted")

    def one(spec: str) -> str:
        own = json.loads(spec)["substitution_contract"]
        return documents.sections({"substitution_contract": {"user_reserved_authority": own["user_reserved_authority"]}}, ["substitution_contract"])

    return rendered(done.select("item_id", "spec"), one, "spec")


@query("written_rule_files", f"""{_SPECS} SELECT f AS name, count(*) AS n_holding, 0 AS n_written_again FROM s, (SELECT unnest(['preferences', 'recovery', 'substitution', 'verification', 'workflows']) AS f) WHERE kind <> 1 GROUP BY f""")
def written_rule_files(spark, d):
    """Every task writes the rule files of its specs, whole or not at all; written again nothing changes."""
    home = folder(spark, "rules")
    specs = migration.migrated(_documents(spark, d), "item_id", "document", name="person").filter("defaulted").select("item_id", "spec")

    def write(item_id: int, spec: str) -> str:
        files = documents.rule_files(json.loads(spec), "2026-05-01")
        documents.write_all(f"{home}/{item_id}", files)
        return str(len(documents.write_all(f"{home}/{item_id}", files)))

    again = rendered(specs, write, "item_id", "spec", name="again").agg(F.sum(F.col("again").cast("int")).cast("int").alias("n")).first()["n"]
    read = spark.read.text(f"{home}/*/rules/*.md", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"/([a-z]+)\.md$", 1).alias("name"), "value")
    title = F.concat(F.lit("# "), F.initcap("name"))
    return read.filter(F.startswith("value", title)).groupBy("name").agg(F.count("*").alias("n_holding")).withColumn("n_written_again", F.lit(again))


@query(
    "output_documents",
    f"""WITH {CLASSIFIED}, w AS (SELECT class, word, count(*) AS n FROM classified WHERE word IS NOT NULL AND class LIKE '%pushback' GROUP BY ALL),
        r AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY n DESC, word) AS k, word, n FROM w)
        SELECT 'gotchas.md' AS name, k || '. `' || word || '` (' || n || ')' AS line FROM r WHERE k <= 10
        UNION ALL SELECT 'twin.md', 'pairs: ' || count(*) || ', still open: _TBD_LATER_' FROM classified
        UNION ALL SELECT 'profile.html', '<p>a &lt;b&gt; of ' || count(*) || '</p>' FROM classified
        UNION ALL SELECT 'numbers.md', '| n_pairs | ' || count(*) || ' |' FROM classified
        UNION ALL SELECT 'run.json', '"n_pairs": ' || count(*) || ',' FROM classified""",
)
def output_documents(spark, d):
    """The telling lines of all documents of a run, as they stand on disk."""
    home, c = folder(spark, "outputs"), reports.convergence(_classified(spark, d))
    templates = {"twin.md": "pairs: {{PAIRS}}, still open: {{LATER}}", "profile.html": "<p>{{NAME}} of {{PAIRS}}</p>"}
    made, open_keys = documents.output_set(templates, {"PAIRS": c["n_pairs"], "NAME": "a <b>"}, c["first_words"], {"n_pairs": c["n_pairs"]}, "2026-05-01")
    if open_keys != ["LATER"] or documents.write_all(home, made) != sorted(made) or documents.write_all(home, made):
        raise RuntimeError("documents were not written once")
    lines = spark.read.text(f"{home}/*").select(F.regexp_extract("_metadata.file_path", "/([^/]+)$", 1).alias("name"), F.trim("value").alias("line"))
    return lines.filter(F.col("line").rlike(r"^[0-9]+\. `|^pairs:|^<p>|^\| n_pairs|^\"n_pairs"))
