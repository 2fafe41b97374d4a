"""Reports from the statistics frames; each collects a handful of aggregate rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import DAYS
from ..operators import inventory, quantitative, temporal
from ..operators.pairs import CLASSES, class_summary, length_ratio, longest_quotes, top_words
from . import charts, markup


def one_row(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict(recursive=True) if row else {}


def pairs(df: DataFrame, name: str, n: str = "n") -> list[tuple]:
    return [(r[name], r[n]) for r in df.collect()]


def numbers(prompts: DataFrame, project: str = "project", k: int = 20) -> dict:
    """Statistics of prompts(text, project): lengths, shares, vocabulary, languages, commands."""
    kept = prompts.select("text", project).persist()
    try:
        words, languages = quantitative.word_counts(kept), quantitative.language_counts(kept)
        counts = kept.sparkSession.createDataFrame(languages.collect(), languages.schema)  # a row a language
        return {
            **one_row(quantitative.length_stats(kept)),
            "per_project": pairs(quantitative.group_share(kept, project, k), project),
            "top_unigrams": pairs(quantitative.top_counted_words(words, k), "word"), "top_bigrams": pairs(quantitative.top_bigrams(kept, k, counted=words), "bigram"),
            "top_first_words": pairs(quantitative.top_first_words(kept, k), "word"), "top_slash_commands": pairs(quantitative.slash_usage(kept), "command"),
            "language_marker_counts": pairs(counts, "language"), "dominant_second_language": one_row(quantitative.dominant_language(counts)),
        }
    finally:
        kept.unpersist()


def activity(events: DataFrame, ts: str, order: str, offset_hours: int = 0, gap_minutes: int = 120) -> dict:
    """Statistics of timestamped rows: histograms, peaks, bursts, drift of their text."""
    drift = temporal.vocabulary_drift(events, order).collect()
    return {
        **one_row(temporal.activity_range(events, ts)), **one_row(temporal.peaks(events, ts, offset_hours)),
        "hour_histogram": dict(pairs(temporal.hour_histogram(events, ts, offset_hours), "hour")),
        "dow_histogram": {DAYS[k]: n for k, n in pairs(temporal.day_histogram(events, ts, offset_hours), "day")},
        "work_bursts": one_row(temporal.size_stats(temporal.bursts(events, ts, gap_minutes), "size", 0.5, 0.9)),
        "rising": sorted(r.word for r in drift if r.direction == "rising"), "falling": sorted(r.word for r in drift if r.direction == "falling"),
    }


def numbers_markdown(n: dict) -> str:
    head = markup.table(("measure", "value"), [(k, n.get(k)) for k in ("n", "mean_chars", "median_chars", "p90_chars", "max_chars")])
    parts = ["# Prompts", head]
    for title, key in (("Words", "top_unigrams"), ("Word pairs", "top_bigrams"), ("First words", "top_first_words"), ("Commands", "top_slash_commands"), ("Projects", "per_project")):
        parts += [f"## {title}", "```\n" + charts.text_bars(n.get(key) or []) + "\n```"]
    return "\n\n".join(parts) + "\n"


def activity_markdown(a: dict) -> str:
    parts = ["# Activity", "```\n" + charts.hour_text(a.get("hour_histogram") or {}) + "\n```", "```\n" + charts.day_text(a.get("dow_histogram") or {}) + "\n```"]
    parts += ["## Vocabulary", charts.drift_text(a.get("rising") or [], a.get("falling") or [])]
    return "\n\n".join(parts) + "\n"


def inventory_markdown(notes: DataFrame, plans: DataFrame) -> str:
    types = pairs(notes.groupBy("type").count().orderBy("type"), "type", "count")
    summary = one_row(inventory.plan_summary(plans))
    return "\n\n".join(["# Inventory", markup.table(("type", "notes"), types), markup.table(("measure", "value"), summary.items())]) + "\n"


def convergence(replies: DataFrame, k: int = 15, quotes: int = 10) -> dict:
    """Statistics of classified replies: sizes and lengths of the classes, pushback against approval, first words, longest pushback."""
    kept = replies.persist()
    try:
        sizes = {r["class"]: {"n": r.n, "median_chars": r.median_chars, "p90_chars": r.p90_chars} for r in class_summary(kept).collect()}
        words = top_words(kept, k).orderBy("class", "rank").collect()
        return {
            "n_pairs": sum(x["n"] for x in sizes.values()), "classes": sizes, **one_row(length_ratio(kept)),
            "first_words": {c: [(r.word, r.n) for r in words if r["class"] == c] for c in CLASSES},
            "quotes": {c: [(r.chars, r.preview) for r in longest_quotes(kept.filter(F.col("class") == c), quotes).collect()] for c in CLASSES if "pushback" in c},
        }
    finally:
        kept.unpersist()


def convergence_markdown(c: dict) -> str:
    sizes = [(name, x.get("n", 0), x.get("median_chars"), x.get("p90_chars")) for name in CLASSES for x in (c["classes"].get(name, {}),)]
    parts = ["# Replies", f"{c['n_pairs']} answers that got a reply.", markup.table(("class", "replies", "median chars", "p90 chars"), sizes)]
    if c.get("ratio"):
        parts.append(f"The median pushback is {c['ratio']:g} times as long as the median approval.")
    parts += [x for name, words in c["first_words"].items() if words for x in (f"## First words: {name}", markup.table(("word", "replies"), words))]
    for name, quotes in c["quotes"].items():
        if quotes:
            parts += [f"## Longest: {name}", markup.bullets(f"{n} chars: {' '.join(quote.split())}" for n, quote in quotes)]
    return "\n\n".join(parts) + "\n"


def plans_markdown(plans: DataFrame) -> Iterator[str]:
    """Lines of the report on a plan inventory, every plan with the newest first; they come one partition at a time."""
    yield "# Plans\n"
    yield markup.table(("measure", "value"), one_row(inventory.plan_summary(plans)).items()) + "\n"
    drift = one_row(inventory.halves(plans, "mtime", "path", F.col("has_oos"), F.col("ac_count")))
    if drift:
        yield "## Out-of-scope sections over time\n"
        rows = [(x, drift[f"{x}_n"], drift[f"{x}_pct"], round(drift[f"{x}_sum"] / drift[f"{x}_n"], 2)) for x in ("early", "late")]
        yield markup.table(("half", "plans", "with section %", "criteria a plan"), rows) + "\n"
    yield "## All plans\n"
    yield markup.table(("date", "archetype", "out of scope", "verification", "criteria", "path"), ())
    for p in plans.orderBy(F.desc("mtime"), "path").toLocalIterator():
        marks = ["yes" if x else "no" for x in (p.has_oos, p.has_verification)]
        yield f"| {str(p.mtime)[:10]} | {p.archetype} | {' | '.join(marks)} | {p.ac_count} | {p.path} |"


def comments_markdown(comments: DataFrame, k: int = 5) -> str:
    """Report on review comments(repo, pr, url, body): their structure, and the longest ones."""
    parts = ["# Review comments", markup.table(("measure", "value"), one_row(inventory.comment_style(comments)).items()), "## Longest"]
    for c in inventory.longest_comments(comments, "repo", "pr", "url", k=k).collect():
        parts += [f"### {c.repo}#{c.pr}", f"<{c.url}>", "~~~\n" + (c.preview or "") + "\n~~~"]
    return "\n\n".join(parts) + "\n"


def write_json(document: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2, default=str)
