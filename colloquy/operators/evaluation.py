"""Deterministic scoring of responses against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import whole_word

# ---- fixed values ---------------------------------------------------------------------------

VERIFY = whole_word("test|tests|verify|verified|fresh|ci|browser|screenshot|type ?check|lint")
RECOVERY = whole_word("fair pushback|you'?re right|what i claimed|actually true|gap")
FILLER = whole_word("i understand|certainly|absolutely|happy to help|great question")
EMOJI = r"[\x{1F300}-\x{1FAFF}]"
MAX_CHARS = 900

#: Fields of an expectation; those absent count as empty or false.
EXPECTED = (
    "decision_keywords array<string>, avoid_unnecessary_questions boolean, verification_required boolean, recovery_required boolean, "
    "pushback_trigger boolean, avoid_phrases array<string>, concept_groups array<array<string>>, forbidden_phrases array<string>, max_chars int"
)

BASE_AXES = ("decision_match", "autonomy_match", "verification_rigor", "recovery_quality", "voice_match", "avoidance_match")

# ---------------------------------------------------------------------------------------------


def _any_in(whole: Column, phrases: Column) -> Column:
    low = F.lower(whole)
    return F.coalesce(F.exists(phrases, lambda p: F.contains(low, F.lower(p))), F.lit(False))


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def score(response: Column, expected: Column) -> Column:
    """Struct of six 0/1 axes, two more that are null unless asked for, total and max."""
    r = text.strip(response)
    some = lambda f: F.coalesce(F.size(expected[f]), F.lit(0)) > 0
    wanted = lambda f: F.coalesce(expected[f], F.lit(False))
    questions = F.length(r) - F.length(F.replace(r, F.lit("?"), F.lit("")))
    low = F.lower(r)
    recovers = r.rlike(RECOVERY) & F.contains(r, F.lit("|")) & (F.contains(low, F.lit("claimed")) | F.contains(low, F.lit("gap"))) & (questions <= 1)
    axes = {
        "decision_match": ~some("decision_keywords") | _any_in(r, expected["decision_keywords"]),
        "autonomy_match": ~wanted("avoid_unnecessary_questions") | (questions == 0),
        "verification_rigor": ~wanted("verification_required") | r.rlike(VERIFY),
        "recovery_quality": ~wanted("recovery_required") | recovers,
        "voice_match": (F.length(r) <= F.coalesce(expected["max_chars"], F.lit(MAX_CHARS))) & ~r.rlike(FILLER) & ~r.rlike(EMOJI),
        "avoidance_match": ~_any_in(r, expected["avoid_phrases"]),
    }
    more = {
        "concept_coverage": F.when(some("concept_groups"), _flag(F.forall(expected["concept_groups"], lambda g: _any_in(r, g)))),
        "forbidden_match": F.when(some("forbidden_phrases"), _flag(~_any_in(r, expected["forbidden_phrases"]))),
    }
    values = {k: _flag(v) for k, v in axes.items()} | more
    total, most = F.lit(0), F.lit(0)
    for v in values.values():
        total, most = total + F.coalesce(v, F.lit(0)), most + v.isNotNull().cast("int")
    return F.struct(*[v.alias(k) for k, v in values.items()], total.alias("total"), most.alias("max"))


def scored(cases: DataFrame) -> DataFrame:
    """cases(id, category, expected, twin_response, generic_response) with twin and generic scores."""
    return cases.withColumn("twin", score(F.col("twin_response"), F.col("expected"))).withColumn("generic", score(F.col("generic_response"), F.col("expected")))


def roll_up(scores: DataFrame, *by: str) -> DataFrame:
    """Mean of each case's share of points, win rate, and the rates of triggers hit and avoided (null without triggers)."""
    share = lambda s: F.try_divide(F.col(f"{s}.total").cast("double"), F.col(f"{s}.max"))
    trigger = F.coalesce(F.col("expected.pushback_trigger"), F.lit(False))
    return scores.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(share("twin")), 6).alias("twin_mean"), F.round(F.avg(share("generic")), 6).alias("generic_mean"),
        F.round(F.try_divide(F.count_if(share("twin") > share("generic")).cast("double"), F.count("*")), 6).alias("win_rate"),
        F.round(F.try_divide(F.count_if(trigger & (F.col("twin.decision_match") == 1)).cast("double"), F.count_if(trigger)), 6).alias("trigger_hit_rate"),
        F.round(F.try_divide(F.count_if(trigger & (F.col("twin.avoidance_match") == 1)).cast("double"), F.count_if(trigger)), 6).alias("trigger_avoidance_rate"),
    )


