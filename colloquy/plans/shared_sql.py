"""SQL fragments that several queries' oracles share."""

from __future__ import annotations

from ..functions.lexicon import BENCH, TOKEN

TOK = TOKEN.replace("'", "''")


def words(items) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in items)


def first_word(column: str) -> str:
    bare = rf"regexp_replace({column}, '^[\s\p{{Z}}]*[/#*>-]*[\s\p{{Z}}]*', '')"
    return f"nullif(lower(regexp_extract({bare}, '^{TOK}', 0)), '')"


def tokens(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{TOK}'), lambda x: lower(x))"


def marker(column: str, alternatives: str) -> str:
    return rf"regexp_matches({column}, '(?i)(^|[^\p{{L}}\p{{N}}_])({alternatives.replace(chr(39), chr(39) * 2)})([^\p{{L}}\p{{N}}_]|$)')"


def pct(part: str, whole: str) -> str:
    return f"coalesce(round_even(100.0::double * ({part}) / nullif({whole}, 0), 1), 0.0::double)"


def quantile(x: str, q: float) -> str:
    return f"coalesce(round(quantile_cont(({x})::double, {q}), 6), 0.0::double)"


WAKE = "(coalesce(text, '') = '' OR " + " OR ".join(f"starts_with(text, '{p}')" for p in BENCH.wake_prefixes) + ")"

PAIRS = f"""
grouped AS (
  SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM conversations),
said AS (
  SELECT *, last_value(CASE WHEN role = 'assistant' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, grp ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS assistant FROM grouped),
pairs AS (SELECT conv_id, turn, assistant, text AS reply FROM said WHERE role = 'user' AND assistant IS NOT NULL AND NOT {WAKE})"""

CLASSIFIED = f"""{PAIRS},
worded AS (SELECT *, {first_word('reply')} AS word, length(reply) AS chars FROM pairs),
anchor AS (SELECT CASE WHEN own > 0 THEN own ELSE every / 2 END AS anchor FROM (SELECT {quantile(f"CASE WHEN word IN ({words(BENCH.approval)}) THEN chars END", 0.5)} AS own, {quantile('chars', 0.5)} AS every FROM worded)),
classified AS (
  SELECT conv_id, turn, reply, word, chars,
         CASE WHEN word IN ({words(BENCH.approval)}) THEN 'approval' WHEN word IN ({words(BENCH.pushback)}) THEN 'explicit_pushback'
              WHEN anchor > 0 AND chars >= 2 * anchor AND {marker('reply', BENCH.markers)} THEN 'implicit_pushback' ELSE 'neutral' END AS class
  FROM worded, anchor)"""
