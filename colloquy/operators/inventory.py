"""Inventories of notes, plans and review comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown, stats, text
from .ordering import key_at, with_position

NOTE_TYPES = ("user", "feedback", "project", "reference")


def notes(files: DataFrame) -> DataFrame:
    """(project, path, name, description, type, body) of files(path, project, value) with front matter; type defaults to 'unknown'."""
    read = files.withColumn("_f", markdown.front_matter(F.col("value"))).filter("_f is not null and path not like '%/MEMORY.md'")
    field = lambda k: F.try_element_at("_f", F.lit(k))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    own = read.select("project", "path", F.coalesce(field("name"), stem).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"),
                      F.coalesce(field("type"), F.lit("unknown")).alias("type"), markdown.body(F.col("value")).alias("body"))
    return own.dropDuplicates(["path"])


def descriptions(files: DataFrame, head: int = 2048) -> DataFrame:
    """(path, description) from the first characters of each file; files without one are left out."""
    found = F.regexp_extract(F.substring("value", 1, head), r"(?dm)^description:[ \t]*(.+)$", 1)
    bare = F.regexp_replace(F.trim(found), "^[\"']|[\"']$", "")
    return files.select("path", bare.alias("description")).filter("description <> ''")


def glossary(projects: DataFrame, entries: DataFrame, key: str, order: str, item: str, most: int = 3) -> DataFrame:
    """projects with up to `most` items of each, in order, as one array; empty where there are none."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    few = entries.withColumn("_r", rank).filter(F.col("_r") <= most)
    lists = few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item]).alias("items"))
    return projects.join(lists, key, "left").withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def plans(files: DataFrame) -> DataFrame:
    """Probes of plan files(path, value, size_bytes, mtime)."""
    value = F.col("value")
    return files.dropDuplicates(["path"]).select(
        "path", "size_bytes", "mtime", markdown.archetype(value).alias("archetype"), value.rlike(markdown.FRONT_MATTER).alias("has_frontmatter"),
        value.rlike(markdown.OUT_OF_SCOPE).alias("has_oos"), value.rlike(markdown.VERIFICATION).alias("has_verification"),
        markdown.count(value, markdown.ACCEPTANCE_LINE).alias("ac_count"), markdown.count(value, markdown.PHASE).alias("phase_count"),
    )


def halves(df: DataFrame, order: str, tie: str, flag: Column, number: Column, least: int = 4) -> DataFrame:
    """One row: share of flag and sum of number in the newer n // 2 rows and in the older rest; none below `least` rows.

    The border is found with a bounded ordering of the key, and ties by `tie`.
    """
    n = df.count()
    if n < least:
        empty = "late_n bigint, early_n bigint, late_pct double, early_pct double, late_sum bigint, early_sum bigint"
        return df.sparkSession.createDataFrame([], empty)
    key, before, _ = key_at(df.select(order), order, n - n // 2 + 1, rows=n)
    if before == n - n // 2:  # the border does not part rows of one key
        placed, late = df, F.col(order) >= F.lit(key)
    else:
        placed = with_position(df, order, tie)
        late = F.col("position") > n - n // 2
    return placed.agg(
        F.count_if(late).alias("late_n"), F.count_if(~late).alias("early_n"),
        stats.share(F.count_if(late & flag), F.count_if(late)).alias("late_pct"), stats.share(F.count_if(~late & flag), F.count_if(~late)).alias("early_pct"),
        F.coalesce(F.sum(F.when(late, number)), F.lit(0)).cast("bigint").alias("late_sum"), F.coalesce(F.sum(F.when(~late, number)), F.lit(0)).cast("bigint").alias("early_sum"),
    )


def plan_summary(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count("*").alias("n_plans"), F.count_if(F.col("archetype") == "multi-phase").alias("n_multi_phase"),
        F.count_if("has_oos").alias("has_oos_count"), stats.share(F.count_if("has_oos"), F.count("*")).alias("has_oos_pct"),
        F.count_if("has_verification").alias("has_verification_count"), stats.mean(F.sum("ac_count"), F.count("*"), 2).alias("avg_ac_count"),
    )


def comment_style(comments: DataFrame) -> DataFrame:
    """One row of structure shares over review comments(repo, pr, body); they are counted first, as the decile rule depends on it."""
    body = F.col("body")
    pct = lambda p: stats.share(F.count_if(body.rlike(p)), F.count("*"))
    return comments.agg(
        F.count("*").alias("n_comments"), F.countDistinct("repo", "pr").alias("n_prs_with_comments"),
        F.floor(stats.percentile(F.length(body), 0.5)).cast("bigint").alias("median_length_chars"),
        stats.decile_90_of(F.length(body), comments.filter("body is not null").count()).alias("p90_length_chars"),
        pct(markdown.HEADING_2).alias("h2_share_pct"), pct(markdown.PRIORITY_TABLE).alias("priority_table_share_pct"),
        pct(markdown.HTML_MARKER).alias("html_marker_share_pct"), pct(markdown.CHECKLIST).alias("checklist_share_pct"),
    )


def longest_comments(comments: DataFrame, *order: str, k: int = 5, preview: int = 500) -> DataFrame:
    """(repo, pr, url, preview) of the k longest comments; equal lengths in the given order."""
    top = comments.orderBy(F.desc(F.length("body")), *order).limit(k)
    return top.select("repo", "pr", "url", F.substring("body", 1, preview).alias("preview"))


def valid_pull_requests(rows: DataFrame) -> DataFrame:
    """Rows whose repo is owner/name in plain characters and whose pr is a positive whole number."""
    return rows.filter(F.col("repo").rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$") & (F.col("pr").cast("string").try_cast("bigint") > 0))


def report_lines(files: DataFrame, pattern: str) -> DataFrame:
    """Distinct lines of report files(path, value) that match a pattern, in order of first appearance: (line, first)."""
    each = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "raw")).select("path", "at", text.squeeze(F.col("raw")).alias("line"))
    return each.filter(F.col("line").rlike(pattern)).groupBy("line").agg(F.min(F.struct("path", "at")).alias("first"))
