"""Rule proposals from pushback: coverage by existing rules, ranking, spill, decisions, bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import DETECTOR, SOUNDS_APPROVAL, Lexicon
from . import overlaps
from .pairs import detect

#: What a proposal must fill in before it can be approved.
SECTIONS = ("Underlying principle", "Rationale", "Applies when", "Does not apply when", "Failure mode", "Trust/delegation implication")


def key_tokens(column: Column, longer_than: int = 4) -> Column:
    return F.filter(F.array_distinct(text.tokens(column)), lambda t: F.length(t) > longer_than)


def covered(replies: DataFrame, rules: DataFrame, reply_key: str, rule_key: str, reply: str = "reply", rule: str = "rule", shared: int = 4, part: float = 0.3) -> DataFrame:
    """(reply_key, rule_key, overlap, tokens): rules that share at least `shared` key tokens, and more than `part` of the reply's.

    Keys are distinct. A set-similarity join by prefix filter (`overlaps.candidates`): only the
    rarest tokens of each side are joined, so a token that all rows hold is none of them, and
    only pairs that meet there are counted, exactly, over all their tokens.
    """
    left = replies.select(F.col(reply_key).alias("_a"), key_tokens(F.col(reply)).alias("_ta")).filter(F.size("_ta") >= shared)
    right = rules.select(F.col(rule_key).alias("_b"), key_tokens(F.col(rule)).alias("_tb")).filter(F.size("_tb") >= shared)
    # a little less than the least overlap that counts, so that no rounding loses a pair
    need = F.greatest(F.lit(shared), F.ceil(F.size("_ta") * F.lit(part) - F.lit(1e-6)))
    pairs = overlaps.candidates(left, right, need, shared)
    found = pairs.join(left, "_a").join(right, "_b").withColumn("overlap", F.size(F.array_intersect("_ta", "_tb")).cast("bigint")).withColumn("tokens", F.size("_ta").cast("bigint"))
    found = found.filter((F.col("overlap") >= shared) & (F.col("overlap") / F.col("tokens") > part))
    return found.select(F.col("_a").alias(reply_key), F.col("_b").alias(rule_key), "overlap", "tokens")


def anchor(pairs: DataFrame, lexicon: Lexicon = DETECTOR) -> DataFrame:
    """One row: the upper median of approvals' lengths, or half of all replies' upper median; 50 without replies."""
    word = text.first_word(F.col("reply"))
    approval = word.isin(*lexicon.approval) | ((word == "sounds") & F.col("reply").rlike(SOUNDS_APPROVAL))
    # percentile_disc picks the lower of two middle elements, so the order is turned round
    ranked = pairs.select(F.length("reply").alias("n"), approval.alias("ok"))
    found = ranked.agg(
        (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN ok THEN -n END)")).alias("own"),
        (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -n)")).alias("every"),
    )
    return found.select(F.coalesce(F.col("own"), F.col("every") * 0.5, F.lit(50.0)).cast("double").alias("anchor"))


def candidates(pairs: DataFrame, lexicon: Lexicon = DETECTOR, min_confidence: float = 0.4, approved_median: float | None = None) -> DataFrame:
    """pairs that push back with enough confidence, with class, confidence and hash; of equal hashes the most confident."""
    base = F.lit(float(approved_median)) if approved_median else F.col("anchor")
    with_anchor = pairs if approved_median else pairs.crossJoin(F.broadcast(anchor(pairs, lexicon)))
    found = with_anchor.withColumn("_d", detect(F.col("reply"), base, lexicon)).drop("anchor")
    found = found.select("*", "_d.class", "_d.confidence").drop("_d").filter(F.col("class").isin("explicit_pushback", "implicit_pushback"))
    found = found.filter((F.col("confidence") >= min_confidence) & (text.strip(F.col("reply")) != ""))
    hashed = found.withColumn("hash", text.content_hash(F.col("reply")))
    return _first_of(hashed, -F.col("confidence"), *[F.col(c) for c in pairs.columns])


def split_spill(pool: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """pool with rank and emitted: the first `most` in the given order are emitted, the rest is deferred.

    Only the head of the order is ranked; it has `most` rows.
    """
    head = pool.orderBy(*order).limit(most).select("hash", F.lit(True).alias("emitted"))
    return pool.join(F.broadcast(head), "hash", "left").withColumn("emitted", F.coalesce("emitted", F.lit(False)))


def merge_backlog(backlog: DataFrame, fresh: DataFrame) -> DataFrame:
    """Distinct hashes of both, the backlog's own row first; `source` is 0 for backlog and 1 for fresh rows."""
    both = backlog.withColumn("source", F.lit(0)).unionByName(fresh.withColumn("source", F.lit(1)))
    return _first_of(both, F.col("source"), -F.col("confidence"))


def _first_of(df: DataFrame, *order: Column) -> DataFrame:
    """The first row of each hash; aggregated before the shuffle, so a reply that recurs everywhere costs a row a task."""
    return df.groupBy("hash").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Of each proposal's decisions (hash, decision, at) the latest; equal times by decision."""
    return decisions.groupBy("hash").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"), F.max("at").alias("at"))


def proposal_name(reply: Column) -> Column:
    return F.concat(text.slugify(text.first_sentence(reply, 120), 32), F.lit("_"), F.substring(text.content_hash(reply), 1, 8))


def proposal_body(reply: Column, assistant: Column, project: Column, at: Column) -> Column:
    """Markdown of a proposal: front matter, the correction, the sections to fill in, and the evidence."""
    flat = lambda x: F.replace(x, F.lit("\n"), F.lit(" "))
    blanks = "".join(f"**{s}:** _Fill in._\n\n" for s in SECTIONS)
    return F.concat(
        F.lit("---\nname: "), proposal_name(reply), F.lit("\ndescription: "), flat(text.first_sentence(reply, 150)),
        F.lit("\ntype: feedback\n---\n\n<!-- proposed "), at, F.lit(", project "), project, F.lit(" -->\n\n## Judgment correction\n\n"),
        text.first_sentence(reply, 400), F.lit("\n\n" + blanks + "---\n\n## Evidence\n\n> "),
        flat(text.first_sentence(assistant, 300)), F.lit("\n\n> "), flat(text.first_sentence(reply, 500)), F.lit("\n"),
    )


def unfilled_sections(body: Column) -> Column:
    """Section names that are missing from a body, or still hold their placeholder; empty when it is ready."""
    checks = [
        F.when(F.regexp_extract(body, rf"(?m)^\*\*{s}:\*\*[ \t]*(.+)$", 1).rlike(r"^(?!_Fill in|_$)\s*\S"), F.lit(None)).otherwise(F.lit(s)) for s in SECTIONS
    ]
    return F.array_compact(F.array(*checks))
