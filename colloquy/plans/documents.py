"""Queries over documents, pages and labels: vocabulary, languages, structure, suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import DESTRUCTIVE, LANGUAGE_MARKERS
from ..operators import corpus, inventory, quantitative, temporal
from ..session import spread, table
from .catalogue import query
from .shared_sql import first_word, marker, pct, quantile, tokens, words

_STOP = words(sorted(quantitative.ALL_STOPWORDS))
_WORDS = f"list_filter({tokens('text')}, lambda x: x NOT IN ({_STOP}))"


@query("prompt_length_stats", f"SELECT count(*) AS n, coalesce(round_even(sum(length(text))::double / nullif(count(text), 0), 1), 0.0::double) AS mean_chars, {quantile('length(text)', 0.5)} AS median_chars, {quantile('length(text)', 0.9)} AS p90_chars, coalesce(max(length(text)), 0)::bigint AS max_chars FROM documents")
def prompt_length_stats(spark, d):
    return quantitative.length_stats(table(spark, d, "documents"))


@query("per_project_share", f"SELECT source, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM documents)')} AS share_pct FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20")
def per_project_share(spark, d):
    return quantitative.group_share(table(spark, d, "documents"), "source")


@query("top_unigrams", f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def top_unigrams(spark, d):
    return quantitative.top_unigrams(spread(table(spark, d, "documents").select("text")))


@query("top_bigrams", f"SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM (SELECT {_WORDS} AS w FROM documents)) GROUP BY bigram ORDER BY n DESC, bigram LIMIT 50")
def top_bigrams(spark, d):
    return quantitative.top_bigrams(spread(table(spark, d, "documents").select("text")))


@query("first_words", f"SELECT word, count(*) AS n FROM (SELECT {first_word('text')} AS word FROM documents) WHERE word IS NOT NULL GROUP BY word ORDER BY n DESC, word LIMIT 30")
def first_words(spark, d):
    return quantitative.top_first_words(spread(table(spark, d, "documents").select("text")))


@query(
    "first_words_first_seen",
    f"SELECT word, n FROM (SELECT word, count(*) AS n, min(doc_id) AS f FROM (SELECT doc_id, {first_word('text')} AS word FROM documents) WHERE word IS NOT NULL GROUP BY word ORDER BY n DESC, f LIMIT 30)",
)
def first_words_first_seen(spark, d):
    return quantitative.top_k_first_seen(table(spark, d, "documents"), F.array_compact(F.array(text.first_word(F.col("text")))), "word", 30, "doc_id")


_BENCH_MARKERS = {**LANGUAGE_MARKERS, "english": "the|and|that", "german": "der|und|nicht", "french": "le|et|que", "spanish": "la|de|el"}
_LANGS = " UNION ALL ".join(f"SELECT '{k}' AS language, count(*) FILTER (WHERE {marker('text', v)}) AS n, count(*) AS total FROM documents" for k, v in sorted(_BENCH_MARKERS.items()))


@query("language_markers", _LANGS)
def language_markers(spark, d):
    return quantitative.language_counts(spread(table(spark, d, "documents").select("text")), _BENCH_MARKERS)


@query(
    "dominant_language",
    f"""WITH c AS ({_LANGS}), r AS (SELECT *, lead(n) OVER (ORDER BY n DESC, language) AS nx, row_number() OVER (ORDER BY n DESC, language) AS k FROM c WHERE n > 0)
        SELECT language, n, {pct('n', 'total')} AS share_pct FROM r WHERE k = 1 AND n >= 0.05 * total AND (nx IS NULL OR n >= 1.05 * nx)""",
)
def dominant_language(spark, d):
    return quantitative.dominant_language(quantitative.language_counts(spread(table(spark, d, "documents").select("text")), _BENCH_MARKERS), lead=1.05)


@query(
    "slash_commands",
    f"""WITH c AS (SELECT list_transform(regexp_extract_all(html, '(?i)(?:^|["\\s`])(/[a-z][a-z0-9_:-]*)', 1), lambda x: lower(x)) AS c FROM pages),
        w AS (SELECT count(*) FILTER (WHERE len(c) > 0) AS k, count(*) AS total FROM c), t AS (SELECT command, count(*) AS n FROM (SELECT unnest(c) AS command FROM c) GROUP BY command ORDER BY n DESC, command LIMIT 20)
        SELECT command, n, {pct('k', 'total')} AS share_pct FROM t, w""",
)
def slash_commands(spark, d):
    return quantitative.slash_usage(table(spark, d, "pages"), "html", r"[\"\s`]", known=None)


@query(
    "vocab_drift",
    f"""WITH p AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents),
        e AS (SELECT CASE WHEN i <= greatest(1, n // 4) THEN 1 ELSE 0 END AS early, CASE WHEN i > n - greatest(1, n // 4) THEN 1 ELSE 0 END AS late, unnest(list_filter({tokens('text')}, lambda x: length(x) >= 4)) AS word FROM p),
        a AS (SELECT word FROM e WHERE early = 1 GROUP BY word ORDER BY count(*) DESC, word LIMIT 25), b AS (SELECT word FROM e WHERE late = 1 GROUP BY word ORDER BY count(*) DESC, word LIMIT 25)
        SELECT 'rising' AS direction, word FROM (SELECT word FROM b EXCEPT SELECT word FROM a) UNION ALL SELECT 'falling', word FROM (SELECT word FROM a EXCEPT SELECT word FROM b)""",
)
def vocab_drift(spark, d):
    return temporal.vocabulary_drift(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


_SQUEEZE = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"


@query(
    "dedup_prefix",
    f"""WITH k AS (SELECT doc_id, source, lang, doc_id % 2 = 1 AS cached, {_SQUEEZE} AS t FROM documents), f AS (SELECT DISTINCT lang, t FROM k WHERE NOT cached AND t <> ''),
        p AS (SELECT *, rtrim(t, '.… ') AS pre FROM k)
        SELECT doc_id FROM p WHERE NOT cached OR NOT EXISTS (SELECT 1 FROM f WHERE f.lang = p.lang AND (f.t = p.t OR (length(p.pre) >= 40 AND starts_with(f.t, p.pre))))""",
)
def dedup_prefix(spark, d):
    return corpus.drop_cached(spread(table(spark, d, "documents").select("doc_id", "lang", "text")), ["lang"], F.col("doc_id") % 2 == 1).select("doc_id")


@query("content_hash_dedup", "SELECT substring(sha256(text), 1, 16) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY substring(sha256(text), 1, 16)")
def content_hash_dedup(spark, d):
    return table(spark, d, "documents").groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "doc_structure",
    """SELECT page_id, len(regexp_extract_all(html, '<h[1-6]')) AS headings, contains(html, '<!--') AS has_marker, len(regexp_extract_all(html, '<li>')) AS items,
       CASE WHEN len(regexp_extract_all(html, '<h[1-6]')) >= 2 OR length(html) > 6000 THEN 'multi-phase' ELSE 'surgical' END AS archetype FROM pages""",
)
def doc_structure(spark, d):
    html, heads = F.col("html"), F.regexp_count("html", F.lit("<h[1-6]"))
    many = (heads >= 2) | (F.length(html) > 6000)
    return table(spark, d, "pages").select(
        "page_id", heads.cast("bigint").alias("headings"), F.contains(html, F.lit("<!--")).alias("has_marker"),
        F.regexp_count("html", F.lit("<li>")).cast("bigint").alias("items"), F.when(many, "multi-phase").otherwise("surgical").alias("archetype"),
    )


@query(
    "comment_style",
    f"""WITH b AS (SELECT source, doc_id % 7 AS pr, text, length(text) AS n FROM documents), s AS (SELECT list_sort(list(n)) AS x, count(*) AS n FROM b),
        j AS (SELECT x, n, least(greatest(9 * (n + 1) // 10, 1), n - 1) AS j FROM s)
        SELECT count(*) AS n_comments, count(DISTINCT (source, pr)) AS n_prs_with_comments, floor({quantile('n', 0.5)})::bigint AS median_length_chars,
          (SELECT CASE WHEN n >= 10 THEN floor((x[j] * (10 - (9 * (n + 1) - 10 * j)) + x[j + 1] * (9 * (n + 1) - 10 * j))::double / 10)::bigint ELSE list_max(x) END FROM j) AS p90_length_chars,
          {pct("count(*) FILTER (WHERE regexp_matches(text, '(?m)^##\\s+\\S'))", 'count(*)')} AS h2_share_pct, {pct("count(*) FILTER (WHERE regexp_matches(text, '(?i)\\|\\s*P[123]\\s*\\|'))", 'count(*)')} AS priority_table_share_pct,
          {pct("count(*) FILTER (WHERE regexp_matches(text, '<!--\\s*\\w+'))", 'count(*)')} AS html_marker_share_pct, {pct("count(*) FILTER (WHERE regexp_matches(text, '(?m)^\\s*-\\s*\\[\\s?[xX]?\\s?\\]'))", 'count(*)')} AS checklist_share_pct FROM b""",
)
def comment_style(spark, d):
    return inventory.comment_style(table(spark, d, "documents").select(F.col("source").alias("repo"), (F.col("doc_id") % 7).alias("pr"), F.col("text").alias("body")))


@query(
    "plan_drift",
    f"""WITH p AS (SELECT length(text) > 6000 AS f, length(text) - length(replace(text, chr(10), '')) AS k, row_number() OVER (ORDER BY doc_id) > count(*) OVER () - count(*) OVER () // 2 AS late FROM documents)
        SELECT count(*) FILTER (WHERE late) AS late_n, count(*) FILTER (WHERE NOT late) AS early_n, {pct('count(*) FILTER (WHERE late AND f)', 'count(*) FILTER (WHERE late)')} AS late_pct,
        {pct('count(*) FILTER (WHERE NOT late AND f)', 'count(*) FILTER (WHERE NOT late)')} AS early_pct, coalesce(sum(k) FILTER (WHERE late), 0)::bigint AS late_sum, coalesce(sum(k) FILTER (WHERE NOT late), 0)::bigint AS early_sum FROM p""",
)
def plan_drift(spark, d):
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", (F.length("text") > 6000).alias("f"), lines.alias("k"))
    return inventory.halves(rows, "doc_id", "doc_id", F.col("f"), F.col("k"))


@query(
    "project_glossary",
    """WITH t AS (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5), e AS (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS r FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1)
       SELECT t.source, n, coalesce(string_agg(doc_id::varchar, ',' ORDER BY r), '') AS items FROM t LEFT JOIN (SELECT * FROM e WHERE r <= 3) e ON t.source = e.source GROUP BY t.source, n""",
)
def project_glossary(spark, d):
    docs = table(spark, d, "documents")
    top = docs.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)
    good = docs.select("doc_id", "source").join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("source", "doc_id", F.col("doc_id").cast("string").alias("item"))
    return inventory.glossary(top, good, "source", "doc_id", "item").select("source", "n", F.array_join("items", ",").alias("items"))


@query("type_matrix", "SELECT lang, event_type, n, level FROM (SELECT source AS lang, lang AS event_type, count(*) AS n, GROUPING(source, lang)::bigint AS level FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ()))")
def type_matrix(spark, d):
    found = quantitative.type_matrix(table(spark, d, "documents"), "source", "lang")
    return found.select(F.col("source").alias("lang"), F.col("lang").alias("event_type"), "n", "level")


@query("path_union", "SELECT url, min(k) AS first_source FROM (SELECT url, 0 AS k FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 1 FROM pages WHERE page_id % 2 = 1 OR page_id % 4 = 0) GROUP BY url")
def path_union(spark, d):
    pages = table(spark, d, "pages")
    both = pages.filter("page_id % 2 = 0").select("url", F.lit(0).alias("k")).unionByName(pages.filter("page_id % 2 = 1 or page_id % 4 = 0").select("url", F.lit(1).alias("k")))
    return both.groupBy("url").agg(F.min("k").alias("first_source"))


@query(
    "report_lines",
    r"""SELECT line, min(doc_id) AS doc_id FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\s\p{Z}]+', ' ', 'g')) AS line FROM documents) WHERE regexp_matches(line, '^(Licensed|This work)') GROUP BY line""",
)
def report_lines(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("value"))
    return inventory.report_lines(files, "^(Licensed|This work)").select("line", F.col("first.path").alias("doc_id"))


_DENIED = " OR ".join(f"contains(' ' || lower(x) || ' ', '{p}')" for p in (*DESTRUCTIVE, "th "))


@query("allowed_items", f"SELECT item_id, len(list_filter(string_split(text, '.'), lambda x: NOT ({_DENIED}))) AS kept FROM benchmark")
def allowed_items(spark, d):
    items = text.allowed(F.split("text", r"\.", -1), (*DESTRUCTIVE, "th "))
    return table(spark, d, "benchmark").select("item_id", F.size(items).cast("bigint").alias("kept"))
