"""Structure probes over Markdown; lines end with \\n only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------

FRONT_MATTER = r"(?ds)^---\s*\n.*?\n---\s*\n"
PHASE = r"(?dmi)^##+\s+(?:Phase|Step|Stage)\b"
OUT_OF_SCOPE = r"(?dmi)^##+\s+(?:out[\s-]?of[\s-]?scope|non[\s-]?goals?|will not)\b"
VERIFICATION = r"(?dmi)^##+\s+(?:verification|verification evidence|acceptance|how we know)\b"
ACCEPTANCE_LINE = r"(?dm)^[^\S\n]*+(?:[-*]\s*\[\s?\]|\d++\.)\s++"
LONG_PLAN, MULTI_PHASES = 6000, 2

HEADING_2 = r"(?dm)^##\s+\S"
PRIORITY_TABLE = r"(?i)\|\s*P[123]\s*\|"
HTML_MARKER = r"<!--\s*\w+"
CHECKLIST = r"(?dm)^[^\S\n]*+-\s*\[\s?[xX]?\s?\]"

# ---------------------------------------------------------------------------------------------


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def archetype(text: Column) -> Column:
    many = (count(text, PHASE) >= MULTI_PHASES) | (F.length(text) > LONG_PLAN)
    return F.when(many, "multi-phase").otherwise("surgical")


def front_matter(text: Column) -> Column:
    """Map of a leading --- block: lower-case keys, quotes stripped, the last of equal keys; null without a block."""
    block = F.regexp_extract(text, r"(?ds)^---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    keys = F.transform(F.regexp_extract_all(block, F.lit(r"(?dm)^([A-Za-z_][\w-]*)\s*:[ \t]*(.*)$"), F.lit(1)), F.lower)
    values = F.transform(
        F.regexp_extract_all(block, F.lit(r"(?dm)^([A-Za-z_][\w-]*)\s*:[ \t]*(.*)$"), F.lit(2)),
        lambda v: F.regexp_replace(F.trim(v), "^[\"']|[\"']$", ""),
    )
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["k"]))
    found = F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))
    return F.when(text.rlike(r"(?ds)^---\s*\n.*?\n---\s*(?:\n|\z)"), found)


def body(text: Column) -> Column:
    """What follows the front matter."""
    return F.regexp_replace(F.regexp_replace(text, r"(?ds)\A---\s*\n.*?\n---\s*(?:\n|\z)", ""), r"^\s++|(?<!\s)\s++$", "")
