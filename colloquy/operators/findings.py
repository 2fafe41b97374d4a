"""Findings: threshold rules over one row of statistics, suggestions that no note covers yet, the most striking fact."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the one-row packet that the rules read; missing statistics are null and fire nothing.
PACKET = (
    "slash_share_pct double, n_pairs bigint, n_approval bigint, n_explicit bigint, n_implicit bigint, n_plans bigint, has_oos_pct double, "
    "n_multi_phase bigint, n_notes bigint, early_oos_pct double, late_oos_pct double, peak_hour int, peak_hour_n bigint"
)


@dataclass(frozen=True)
class Rule:
    """Fires where `when` holds; `value` is the figure it is about; text shows it at %s."""

    card: str
    name: str
    when: Column
    value: Column
    text: str


def _share(part: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), "n_pairs"), F.lit(0.0))


def rules() -> list[Rule]:
    """The thresholds are fixed values; the wording is ours."""
    c = F.col
    return [
        Rule("works", "approval_share", c("n_pairs") > 0, F.bround(100 * _share("n_approval"), 1), "%s %% of replies begin with an approval."),
        Rule("works", "scope_sections", c("n_plans") > 0, c("has_oos_pct"), "%s %% of plans say what is out of scope."),
        Rule("works", "rising_rigor", c("late_oos_pct") > c("early_oos_pct") + 5, c("late_oos_pct"), "Recent plans say what is out of scope in %s %% of cases, more than early ones."),
        Rule("try", "saved_commands", c("slash_share_pct") < 40, c("slash_share_pct"), "Only %s %% of prompts use a command; recurring ones could be saved."),
        Rule("try", "confirm_scope", _share("n_implicit") > 0.1, F.bround(100 * _share("n_implicit"), 1), "%s %% of replies push back at length; confirming scope first would save turns."),
        Rule("try", "name_limits", (c("n_plans") > 0) & (c("has_oos_pct") < 60), c("has_oos_pct"), "%s %% of plans name their limits; all could."),
        Rule("try", "review_proposals", c("n_notes") > 0, c("n_notes"), "%s notes are kept; proposed rules can be reviewed each week."),
        Rule("keep", "approvals", c("n_approval") > 200, c("n_approval"), "%s approvals: work is carried through to the end."),
        Rule("keep", "phases", c("n_multi_phase") > 0, c("n_multi_phase"), "%s plans proceed by phases."),
        Rule("horizon", "plan_library", c("n_multi_phase") >= 5, c("n_multi_phase"), "%s plans with phases share a shape that could be a template."),
    ]


def fired(packet: DataFrame, among: Iterable[Rule] | None = None) -> DataFrame:
    """(card, name, value, text) of every rule that holds for a packet row."""
    each = [
        F.when(r.when, F.struct(F.lit(r.card).alias("card"), F.lit(r.name).alias("name"), r.value.cast("double").alias("value"), F.format_string(r.text, r.value.cast("string")).alias("text")))
        for r in (rules() if among is None else among)
    ]
    return packet.select(F.explode(F.array_compact(F.array(*each))).alias("f")).select("f.*")


#: Hints that are held in memory at once; beyond that they are met by their first GRAM characters.
MOST_HINTS, GRAM = 10_000, 3


def uncovered(suggestions: DataFrame, notes: DataFrame, most: int = MOST_HINTS) -> DataFrame:
    """suggestions(title, body, hints) none of whose hints occurs in any note(name, description); each title once.

    A short list of hints is broadcast. A longer one is joined on its first characters with
    those at each place of a note; only hints that are shorter still are broadcast then, of
    which there cannot be many different ones.
    """
    hints = suggestions.select("title", F.explode("hints").alias("hint")).select("title", F.lower("hint").alias("hint"))
    known = notes.select(F.lower(F.concat_ws(" ", "description", "name")).alias("about")).distinct()
    holds = F.contains(F.col("about"), F.col("hint"))
    if hints.limit(most + 1).count() <= most:
        hit = known.join(F.broadcast(hints), holds).select("title")
    else:
        places = F.sequence(F.lit(1), F.greatest(F.length("about") - GRAM + 1, F.lit(1)))
        grams = known.select("about", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("about", i, F.lit(GRAM))))).alias("gram"))
        long = hints.filter(F.length("hint") >= GRAM).withColumn("gram", F.substring("hint", 1, GRAM))
        tiny = hints.filter(F.length("hint") < GRAM)
        found = known.join(F.broadcast(tiny.select("hint").distinct()), holds).select("hint").distinct()
        hit = grams.join(long, "gram").filter(holds).select("title").unionByName(tiny.join(found, "hint").select("title"))
    return suggestions.join(hit.distinct(), "title", "left_anti")


def most_striking(packet: DataFrame, rising: DataFrame | None = None) -> DataFrame:
    """One row (score, text): the fact with the highest count; drift of vocabulary counts 300."""
    facts = [
        F.when(F.col("peak_hour_n") > 0, F.struct(F.col("peak_hour_n").alias("score"), F.format_string("Most happens at %d:00.", "peak_hour").alias("text"))),
        F.when(F.col("n_explicit") > 0, F.struct(F.col("n_explicit").alias("score"), F.format_string("%d replies push back in their first word.", "n_explicit").alias("text"))),
    ]
    found = packet.select(F.explode(F.array_compact(F.array(*facts))).alias("f")).select("f.*")
    if rising is not None:
        words = rising.agg(F.count_if(F.col("direction") == "rising").alias("up"), F.count_if(F.col("direction") == "falling").alias("down"))
        found = found.unionByName(words.filter("up > 0 and down > 0").select(F.lit(300).cast("bigint").alias("score"), F.lit("The vocabulary is moving.").alias("text")))
    return found.orderBy(F.desc("score"), "text").limit(1)


def quoted_lines(reports: DataFrame, keywords: Iterable[str], most: int = 3) -> DataFrame:
    """The first bullet lines of reports(path, value) that hold a keyword, without their marks."""
    each = reports.select("path", F.posexplode(F.split("value", "\n")).alias("at", "raw")).select("path", "at", F.trim("raw").alias("line"))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower("line"), F.lit(k.lower()))
    return each.filter(F.col("line").rlike(r"^[-*] ") & hit).orderBy("path", "at").limit(most).select(F.regexp_replace("line", r"^[-* ]+", "").alias("line"))
