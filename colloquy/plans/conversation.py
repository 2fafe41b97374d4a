"""Queries over conversations: pairing, classes, proposals, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.lexicon import BENCH
from ..operators import corpus, evaluation, findings, pairs, proposals, quantitative
from ..session import table
from .catalogue import query
from .shared_sql import CLASSIFIED, PAIRS, WAKE, first_word, marker, pct, quantile, tokens, words


def _pairs(spark, d):
    return pairs.turn_pairs(table(spark, d, "conversations"), ["conv_id"], "turn", BENCH.wake_prefixes)


def _classified(spark, d):
    return pairs.classified(_pairs(spark, d), BENCH)


@query("turn_pairs", f"WITH {PAIRS} SELECT conv_id, turn, assistant, reply FROM pairs")
def turn_pairs(spark, d):
    return _pairs(spark, d)


@query(
    "convergence_summary",
    f"WITH {CLASSIFIED} SELECT class, count(*) AS n, {quantile('chars', 0.5)} AS median_chars, {quantile('chars', 0.9)} AS p90_chars FROM classified GROUP BY class",
)
def convergence_summary(spark, d):
    return pairs.class_summary(_classified(spark, d))


@query(
    "length_ratio",
    f"""WITH {CLASSIFIED} SELECT *, round(pushback_median / nullif(approval_median, 0), 6) AS ratio FROM (
        SELECT {quantile("CASE WHEN class = 'approval' THEN chars END", 0.5)} AS approval_median,
               {quantile("CASE WHEN class LIKE '%pushback' THEN chars END", 0.5)} AS pushback_median FROM classified)""",
)
def length_ratio(spark, d):
    return pairs.length_ratio(_classified(spark, d))


@query(
    "first_word_by_class",
    f"""WITH {CLASSIFIED}, counted AS (SELECT class, word, count(*) AS n FROM classified WHERE word IS NOT NULL GROUP BY ALL)
        SELECT class, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, word) AS rank FROM counted) WHERE rank <= 10""",
)
def first_word_by_class(spark, d):
    return pairs.top_words(_classified(spark, d))


@query(
    "longest_pushback_quotes",
    f"WITH {CLASSIFIED} SELECT class, chars, substring(reply, 1, 500) AS preview FROM classified WHERE class LIKE '%pushback' ORDER BY chars DESC, reply DESC LIMIT 10",
)
def longest_pushback_quotes(spark, d):
    return pairs.longest_quotes(_classified(spark, d))


@query(
    "steering_words",
    f"""SELECT kind, word, count(*) AS n FROM (SELECT word, CASE WHEN word IN ({words(BENCH.approval)}) THEN 'approval' WHEN word IN ({words(BENCH.pushback)}) THEN 'pushback' END AS kind
        FROM (SELECT {first_word('text')} AS word FROM conversations)) WHERE kind IS NOT NULL GROUP BY ALL""",
)
def steering_words(spark, d):
    return quantitative.steering_words(table(spark, d, "conversations"), BENCH)


_FIRST = f"first AS (SELECT conv_id, turn, text, NOT {WAKE} AS is_human_typed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1)"


def _first(spark, d):
    rows = corpus.annotate(table(spark, d, "conversations").filter("role = 'user'"), BENCH.wake_prefixes)
    return corpus.first_prompts(rows, ["conv_id"], "turn")


@query("first_prompts", f"WITH {_FIRST} SELECT * FROM first")
def first_prompts(spark, d):
    return _first(spark, d).select("conv_id", "turn", "text", "is_human_typed")


@query("human_first", f"WITH {_FIRST} SELECT conv_id, turn, text FROM first WHERE is_human_typed AND length(text) >= 80")
def human_first(spark, d):
    return corpus.human_first(_first(spark, d)).select("conv_id", "turn", "text")


@query(
    "corpus_summary",
    f"""SELECT count(*) AS n_prompts, count(*) FILTER (WHERE NOT wake) AS n_human, count(*) FILTER (WHERE wake) AS n_auto, count(DISTINCT role) AS n_projects, count(DISTINCT (role, conv_id)) AS n_sessions
        FROM (SELECT *, {WAKE} AS wake FROM conversations)""",
)
def corpus_summary(spark, d):
    rows = table(spark, d, "conversations").select("text", F.col("role").alias("project"), F.col("conv_id").alias("session"))
    return corpus.summary(corpus.annotate(rows, BENCH.wake_prefixes))


_KEYS = lambda c: f"list_filter(list_distinct({tokens(c)}), lambda x: length(x) > 4)"


@query(
    "rule_coverage",
    f"""WITH {PAIRS}, l AS (SELECT conv_id * 1000 + turn AS reply_id, {_KEYS('reply')} AS t FROM pairs), r AS (SELECT item_id, {_KEYS('text')} AS t FROM benchmark),
        le AS (SELECT reply_id, len(t) AS tokens, unnest(t) AS token FROM l), re AS (SELECT item_id, unnest(t) AS token FROM r)
        SELECT reply_id, item_id, count(*) AS overlap, any_value(tokens) AS tokens FROM le JOIN re USING (token) GROUP BY reply_id, item_id
        HAVING count(*) >= 2 AND count(*) / any_value(tokens) > 0.05""",
)
def rule_coverage(spark, d):
    replies = _pairs(spark, d).withColumn("reply_id", F.col("conv_id") * 1000 + F.col("turn"))
    return proposals.covered(replies, table(spark, d, "benchmark").withColumnRenamed("text", "rule"), "reply_id", "item_id", shared=2, part=0.05)


_CANDIDATES = f"""{PAIRS},
worded AS (SELECT *, {first_word('reply')} AS word, length(reply) AS n FROM pairs),
anchor AS (SELECT coalesce(own, every * 0.5, 50.0)::double AS anchor FROM (
  SELECT -quantile_disc(CASE WHEN word IN ({words(BENCH.approval)}) THEN -n END, 0.5) AS own, -quantile_disc(-n, 0.5) AS every FROM worded)),
detected AS (SELECT conv_id, turn, assistant, reply, CASE WHEN word IN ({words(BENCH.pushback)}) THEN 'explicit_pushback' WHEN word IN ({words(BENCH.approval)}) THEN 'approval'
    WHEN anchor > 0 AND n >= 2 * anchor AND {marker('reply', BENCH.markers)} THEN 'implicit_pushback' ELSE 'neutral' END AS class,
  n, anchor FROM worded, anchor),
levels AS (SELECT conv_id, turn, assistant, reply, class, CASE class WHEN 'explicit_pushback' THEN 0.9::double WHEN 'implicit_pushback' THEN 0.4::double + 0.5::double * least(n / (anchor * 4), 1.0::double) END AS confidence,
  substring(sha256(reply), 1, 16) AS hash FROM detected WHERE class LIKE '%pushback'),
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY confidence DESC, conv_id, turn) AS r FROM levels WHERE confidence >= 0.4) WHERE r = 1)"""


def _candidates(spark, d):
    return proposals.candidates(_pairs(spark, d), BENCH)


@query(
    "proposal_rank_spill",
    f"""WITH {_CANDIDATES} SELECT hash, class, round(confidence, 6) AS confidence, row_number() OVER (ORDER BY confidence DESC, hash) <= 20 AS emitted FROM candidates""",
)
def proposal_rank_spill(spark, d):
    pool = proposals.split_spill(_candidates(spark, d), 20, F.desc("confidence"), "hash")
    return pool.select("hash", "class", F.round("confidence", 6).alias("confidence"), "emitted")


@query(
    "backlog_merge",
    f"""WITH {_CANDIDATES}, backlog AS (SELECT hash, confidence FROM candidates WHERE conv_id % 2 = 0), fresh AS (SELECT hash, 0.5::double AS confidence FROM candidates WHERE conv_id % 2 = 1 OR conv_id % 4 = 0)
        SELECT hash, round(confidence, 6) AS confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source, confidence DESC) AS r
        FROM (SELECT *, 0 AS source FROM backlog UNION ALL SELECT *, 1 AS source FROM fresh)) WHERE r = 1""",
)
def backlog_merge(spark, d):
    pool = _candidates(spark, d)
    backlog = pool.filter("conv_id % 2 = 0").select("hash", "confidence")
    fresh = pool.filter("conv_id % 2 = 1 or conv_id % 4 = 0").select("hash", F.lit(0.5).alias("confidence"))
    return proposals.merge_backlog(backlog, fresh).select("hash", F.round("confidence", 6).alias("confidence"), "source")


@query(
    "proposal_bodies",
    f"""WITH {_CANDIDATES}, s AS (SELECT hash, reply, split_part(regexp_replace(regexp_replace(reply, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[.!?][\\s\\p{{Z}}]+', chr(1)), chr(1), 1) AS one FROM candidates)
        SELECT hash, CASE WHEN length(one) > 120 THEN regexp_replace(substring(one, 1, 120), '[\\s\\p{{Z}}]+$', '') || '...' ELSE one END AS summary FROM s""",
)
def proposal_bodies(spark, d):
    return _candidates(spark, d).select("hash", text.first_sentence(F.col("reply"), 120).alias("summary"))


@query("slugs", """SELECT item_id, coalesce(nullif(substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 1, 50), ''), 'rule') AS slug FROM benchmark""")
def slugs(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.slugify(F.col("text")).alias("slug"))


def _cases(spark, d):
    """Expectations made from the turns: the reply's words against the answer."""
    word = F.coalesce(text.first_word(F.col("reply")), F.lit("the"))
    expected = F.struct(
        F.array(word).alias("decision_keywords"), (F.col("turn") % 2 == 0).alias("avoid_unnecessary_questions"), F.lit(False).alias("verification_required"),
        F.lit(False).alias("recovery_required"), (F.col("turn") % 3 == 0).alias("pushback_trigger"), F.array(F.lit("zz"), F.lit("qu")).alias("avoid_phrases"),
        F.when(F.col("turn") % 2 == 1, F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("in")))).alias("concept_groups"),
        F.when(F.col("turn") % 4 == 0, F.array(F.lit("xx"))).alias("forbidden_phrases"), F.lit(400).alias("max_chars"),
    )
    return _pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 5).cast("string").alias("category"), expected.alias("expected"),
                                   F.col("assistant").alias("twin_response"), F.col("reply").alias("generic_response"))


_SCORE = lambda r: f"""(contains(lower({r}), kw))::int + (turn % 2 <> 0 OR NOT contains({r}, '?'))::int + 2 + (length({r}) <= 400 AND NOT {marker(r, 'i understand|certainly|absolutely|happy to help|great question')})::int
   + (NOT (contains(lower({r}), 'zz') OR contains(lower({r}), 'qu')))::int + CASE WHEN turn % 2 = 1 THEN ((contains(lower({r}), 'the') OR contains(lower({r}), 'der')) AND contains(lower({r}), 'in'))::int ELSE 0 END
   + CASE WHEN turn % 4 = 0 THEN (NOT contains(lower({r}), 'xx'))::int ELSE 0 END"""  # noqa: E731

_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SCORED = f"""{PAIRS}, cases AS (SELECT conv_id * 1000 + turn AS id, turn, (turn % 5)::varchar AS category, coalesce({first_word('reply')}, 'the') AS kw, {_STRIP.format('assistant')} AS tw, {_STRIP.format('reply')} AS ge FROM pairs),
scores AS (SELECT id, turn, category, kw, tw, ({_SCORE('tw')})::int AS twin_total, ({_SCORE('ge')})::int AS generic_total, (6 + CASE WHEN turn % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END)::int AS max FROM cases)"""


@query("response_scores", f"WITH {_SCORED} SELECT id, category, twin_total, generic_total, max FROM scores")
def response_scores(spark, d):
    scored = evaluation.scored(_cases(spark, d))
    return scored.select("id", "category", F.col("twin.total").alias("twin_total"), F.col("generic.total").alias("generic_total"), F.col("twin.max").alias("max"))


@query(
    "category_scores",
    f"""WITH {_SCORED} SELECT category, count(*) AS n, round(avg(twin_total::double / max), 6) AS twin_mean, round(avg(generic_total::double / max), 6) AS generic_mean,
        round(count(*) FILTER (WHERE twin_total > generic_total)::double / count(*), 6) AS win_rate,
        round(count(*) FILTER (WHERE turn % 3 = 0 AND contains(lower(tw), kw))::double / nullif(count(*) FILTER (WHERE turn % 3 = 0), 0), 6) AS trigger_hit_rate,
        round(count(*) FILTER (WHERE turn % 3 = 0 AND NOT (contains(lower(tw), 'zz') OR contains(lower(tw), 'qu')))::double / nullif(count(*) FILTER (WHERE turn % 3 = 0), 0), 6) AS trigger_avoidance_rate
        FROM scores GROUP BY category""",
)
def category_scores(spark, d):
    return evaluation.roll_up(evaluation.scored(_cases(spark, d)), "category")


@query(
    "ordered_concat",
    f"""SELECT conv_id, string_agg(w, ' ' ORDER BY turn) AS words FROM (SELECT conv_id, turn, {first_word('text')} AS w FROM conversations) WHERE w IS NOT NULL GROUP BY conv_id""",
)
def ordered_concat(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.first_word(F.col("text")).alias("w")).filter("w is not null")
    return rows.groupBy("conv_id").agg(F.expr("listagg(w, ' ') WITHIN GROUP (ORDER BY turn)").alias("words"))


@query(
    "stat_packet",
    f"""SELECT (SELECT count(*) FROM conversations) AS n_turns, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_conversations,
        (SELECT count(*) FROM documents) AS n_documents, (SELECT {quantile('length(text)', 0.5)} FROM documents) AS median_chars, (SELECT {pct("count(*) FILTER (WHERE toxic = 1)", 'count(*)')} FROM labels) AS toxic_pct""",
)
def stat_packet(spark, d):
    parts = [
        table(spark, d, "conversations").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations")),
        table(spark, d, "documents").agg(F.count("*").alias("n_documents"), stats.percentile(F.length("text"), 0.5).alias("median_chars")),
        table(spark, d, "labels").agg(stats.share(F.count_if(F.col("toxic") == 1), F.count("*")).alias("toxic_pct")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


_PACKET = f"""WITH {CLASSIFIED}, k AS (SELECT count(*) AS n_pairs, count(*) FILTER (WHERE class = 'approval') AS n_approval, count(*) FILTER (WHERE class = 'explicit_pushback') AS n_explicit,
        count(*) FILTER (WHERE class = 'implicit_pushback') AS n_implicit FROM classified),
    d AS (SELECT count(*) AS n_plans, count(*) FILTER (WHERE length(text) > 6000) AS n_multi_phase, {pct("count(*) FILTER (WHERE length(text) > 6000)", "count(*)")} AS has_oos_pct FROM documents),
    h AS (SELECT {pct("count(*) FILTER (WHERE length(text) > 6000 AND doc_id % 2 = 0)", "count(*) FILTER (WHERE doc_id % 2 = 0)")} AS early_oos_pct, {pct("count(*) FILTER (WHERE length(text) > 600 AND doc_id % 2 = 1)", "count(*) FILTER (WHERE doc_id % 2 = 1)")} AS late_oos_pct FROM documents),
    s AS (SELECT {pct("count(*) FILTER (WHERE contains(text, '/'))", "count(*)")} AS slash_share_pct FROM conversations),
    p AS (SELECT *, (SELECT count(*) FROM benchmark) AS n_notes FROM k, d, h, s)"""


@query(
    "threshold_findings",
    f"""{_PACKET} SELECT * FROM (
        SELECT 'approval_share' AS name, round_even(100 * coalesce(n_approval::double / nullif(n_pairs, 0), 0.0), 1) AS value FROM p WHERE n_pairs > 0
        UNION ALL SELECT 'scope_sections', has_oos_pct FROM p WHERE n_plans > 0
        UNION ALL SELECT 'rising_rigor', late_oos_pct FROM p WHERE late_oos_pct > early_oos_pct + 5
        UNION ALL SELECT 'saved_commands', slash_share_pct FROM p WHERE slash_share_pct < 40
        UNION ALL SELECT 'confirm_scope', round_even(100 * coalesce(n_implicit::double / nullif(n_pairs, 0), 0.0), 1) FROM p WHERE coalesce(n_implicit::double / nullif(n_pairs, 0), 0.0) > 0.1
        UNION ALL SELECT 'name_limits', has_oos_pct FROM p WHERE n_plans > 0 AND has_oos_pct < 60
        UNION ALL SELECT 'review_proposals', n_notes::double FROM p WHERE n_notes > 0
        UNION ALL SELECT 'approvals', n_approval::double FROM p WHERE n_approval > 200
        UNION ALL SELECT 'phases', n_multi_phase::double FROM p WHERE n_multi_phase > 0
        UNION ALL SELECT 'plan_library', n_multi_phase::double FROM p WHERE n_multi_phase >= 5)""",
)
def threshold_findings(spark, d):
    is_class = lambda c: F.count_if(F.col("class") == c)
    replies = _classified(spark, d).agg(
        F.count("*").alias("n_pairs"), is_class("approval").alias("n_approval"), is_class("explicit_pushback").alias("n_explicit"), is_class("implicit_pushback").alias("n_implicit")
    )
    long = F.count_if(F.length("text") > 6000)
    plans = table(spark, d, "documents").agg(F.count("*").alias("n_plans"), long.alias("n_multi_phase"), stats.share(long, F.count("*")).alias("has_oos_pct"))
    notes = table(spark, d, "benchmark").agg(F.count("*").alias("n_notes"))
    half = lambda least, odd: stats.share(F.count_if((F.length("text") > least) & (F.col("doc_id") % 2 == odd)), F.count_if(F.col("doc_id") % 2 == odd))
    halves = table(spark, d, "documents").agg(half(6000, 0).alias("early_oos_pct"), half(600, 1).alias("late_oos_pct"))
    slash = table(spark, d, "conversations").agg(stats.share(F.count_if(F.contains("text", F.lit("/"))), F.count("*")).alias("slash_share_pct"))
    packet = replies
    for part in (plans, notes, halves, slash):
        packet = packet.crossJoin(F.broadcast(part))  # one row each
    for field in findings.PACKET.split(", "):
        name, kind = field.split()
        if name not in packet.columns:
            packet = packet.withColumn(name, F.lit(None).cast(kind))
    return findings.fired(packet).select("name", "value")
