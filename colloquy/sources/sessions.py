"""Batch reading of session logs, notes, plans, reports and review comments."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .log_lines import PIECE_BYTES, lines, safe_files


def whole_files(spark: SparkSession, paths: str | Sequence[str], modified_after: str | None = None) -> DataFrame:
    """(path, value, size_bytes, mtime): a row for each file; files older than modified_after are pruned before reading."""
    reader = spark.read
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], "path string, value string, size_bytes bigint, mtime timestamp")
    read = reader.text(paths, wholetext=True)
    return read.select(
        F.regexp_replace(F.url_decode("_metadata.file_path"), "^file:/+", "/").alias("path"), "value",
        F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("mtime"),
    )


def project_of(path: Column) -> Column:
    """The path component after the first `projects`; 'unknown' without one."""
    found = F.regexp_extract(path, "(?:^|/)projects/([^/]+)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def session_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def entries(numbered: DataFrame) -> DataFrame:
    """(path, project, session, line_no, entry) from lines (path, line_no, value): a variant for each that parses to an object; others are skipped."""
    parsed = numbered.select("path", F.col("line_no").cast("bigint").alias("line_no"), F.try_parse_json(F.regexp_replace("value", r"\r$", "")).alias("entry"))
    kept = parsed.filter(F.schema_of_variant("entry").startswith("OBJECT"))
    return kept.select("path", project_of(F.col("path")).alias("project"), session_of(F.col("path")).alias("session"), "line_no", "entry")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, value) of whole files (path, value) that are rows already."""
    split = files.select("path", F.posexplode(F.split("value", "\n", -1)).alias("at", "value"))
    return split.select("path", (F.col("at") + 1).cast("bigint").alias("line_no"), "value")


def _text(entry: Column, at: str) -> Column:
    """The string at a path; null where something else stands there."""
    node = F.try_variant_get(entry, at, "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(entry, at, "string"))


def _blocks(entry: Column, raw_strings: bool) -> Column:
    """Text blocks of message.content joined by line ends, raw string blocks among them if asked; null if there is no text."""
    parts = F.try_variant_get(entry, "$.message.content", "array<variant>")
    raw = (lambda b: F.try_variant_get(b, "$", "string")) if raw_strings else (lambda b: F.lit(None).cast("string"))
    one = lambda b: F.when(F.schema_of_variant(b) == "STRING", raw(b)).when(F.try_variant_get(b, "$.type", "string") == "text", F.try_variant_get(b, "$.text", "string"))
    joined = F.array_join(F.filter(F.transform(parts, one), lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(joined != "", joined)


def message_text(entry: Column, raw_strings: bool = False) -> Column:
    """Text of message.content, a string or a list of blocks."""
    return F.coalesce(_text(entry, "$.message.content"), _blocks(entry, raw_strings))


def prompt_text(entry: Column) -> Column:
    """Text of an entry that holds a prompt, by its type; null for other entries and empty texts."""
    kind = F.try_variant_get(entry, "$.type", "string")
    legacy = F.coalesce(F.nullif(_text(entry, "$.content"), F.lit("")), _text(entry, "$.text"))
    found = F.when(kind == "last-prompt", _text(entry, "$.lastPrompt")).when(kind == "user", message_text(entry, raw_strings=True)).when(kind == "human", legacy)
    return F.when(found != "", found)


def prompts(read: DataFrame) -> DataFrame:
    """(path, project, session, line_no, source_type, text, ts) of entries that hold a prompt."""
    own = read.select("path", "project", "session", "line_no", F.try_variant_get("entry", "$.type", "string").alias("source_type"), prompt_text(F.col("entry")).alias("text"), _text(F.col("entry"), "$.timestamp").alias("ts"))
    return own.filter("text is not null")


def turns(read: DataFrame) -> DataFrame:
    """(path, project, session, line_no, role, text, ts) of user and assistant entries; text may be null."""
    role = F.try_variant_get("entry", "$.type", "string")
    stamp = F.coalesce(_text(F.col("entry"), "$.timestamp"), _text(F.col("entry"), "$.ts"))
    return read.select("path", "project", "session", "line_no", role.alias("role"), message_text(F.col("entry")).alias("text"), stamp.alias("ts")).filter(F.col("role").isin("user", "assistant"))


def session_logs(spark: SparkSession, root: str, modified_after: str | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Entries of every <root>/<project>/<session>.jsonl that is a plain file; files above piece_bytes are read by several tasks."""
    return entries(lines(spark, root, "*/*.jsonl", modified_after, piece_bytes))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Prompts of all sessions, without cached copies of full ones, with the automation flags."""
    from ..operators.corpus import annotate, drop_cached

    read = prompts(session_logs(spark, root))
    return annotate(drop_cached(read, ["path"], F.col("source_type") == "last-prompt"))


def note_files(spark: SparkSession, root: str) -> DataFrame:
    """Files for inventory.notes(): <project>/memory/**/*.md, without MEMORY.md."""
    paths = [p for p in safe_files(root, "*/memory/*.md", "*/memory/**/*.md") if os.path.basename(p) != "MEMORY.md"]
    return whole_files(spark, paths).withColumn("project", project_of(F.col("path")))


def plan_files(spark: SparkSession, home: str, projects: str, search: Iterable[str] = ()) -> DataFrame:
    """Files for inventory.plans(): global plans, plans inside projects, and search folders down to three levels, each once."""
    paths = [*safe_files(home, "plans/*.md"), *safe_files(projects, "*/plans/*.md", "*/memory/plans/*.md", "*/docs/plans/*.md")]
    for folder in search:
        paths += safe_files(folder, "*.md", "*/*.md", "*/*/*.md")
    return whole_files(spark, list(dict.fromkeys(paths)))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """One row, `packet`: all report files in name order, each under a heading with its name."""
    read = whole_files(spark, safe_files(folder, "*.md"))
    headed = read.select("path", F.concat(F.lit("## "), session_of(F.col("path")), F.lit("\n\n"), "value").alias("part"))
    return headed.agg(F.expr("listagg(part, '\n\n') WITHIN GROUP (ORDER BY path)").alias("packet"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row; an empty frame where the file is missing."""
    if not os.path.exists(path.removeprefix("file://")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)
