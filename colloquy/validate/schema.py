"""Nested documents against a subset of JSON Schema: one row for each error.

Keywords: type, pattern (whole string), const, required, properties, additionalProperties,
minItems, maxItems, items, minimum. A value of the wrong type is reported once and not
looked into.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Python types of each JSON type; truth values are no integers.
TYPES: dict[str, tuple[type, ...]] = {
    "object": (dict,), "array": (list,), "string": (str,), "boolean": (bool,), "integer": (int,), "number": (int, float), "null": (type(None),),
}

Error = tuple[str, str]


def type_name(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return next((name for name, kinds in TYPES.items() if isinstance(value, kinds)), type(value).__name__)


def has_type(value: Any, wanted: str) -> bool:
    if isinstance(value, bool):
        return wanted == "boolean"
    return isinstance(value, TYPES.get(wanted, (object,)))


def _own_errors(value: Any, schema: dict) -> Iterator[str]:
    """What is wrong with the value itself."""
    if isinstance(value, str) and isinstance(p := schema.get("pattern"), str) and not re.fullmatch(p, value):
        yield f"expected to match {p!r}, got {value!r}"
    if "const" in schema and value != schema["const"]:
        yield f"expected {schema['const']!r}, got {value!r}"
    if isinstance(value, list):
        low, high = schema.get("minItems"), schema.get("maxItems")
        if isinstance(low, int) and len(value) < low:
            yield f"expected at least {low} items, got {len(value)}"
        if isinstance(high, int) and len(value) > high:
            yield f"expected at most {high} items, got {len(value)}"
    if schema.get("type") == "integer" and isinstance(least := schema.get("minimum"), int | float) and value < least:
        yield f"expected >= {least}, got {value}"


def _parts(value: Any, schema: dict, path: str) -> Iterator[tuple[str, Any, dict]]:
    """(path, value, schema) of what the value holds and the schema speaks of."""
    if isinstance(value, dict):
        named, rest = schema.get("properties") or {}, schema.get("additionalProperties")
        ordered = [k for k in named if k in value] + [k for k in value if k not in named and isinstance(rest, dict)]
        yield from ((f"{path}.{k}", value[k], named.get(k, rest)) for k in ordered)
    elif isinstance(value, list) and isinstance(item := schema.get("items"), dict):
        yield from ((f"{path}[{i}]", v, item) for i, v in enumerate(value))


def errors(value: Any, schema: dict, path: str = "$") -> Iterator[Error]:
    """(path, message) pairs, outer ones first."""
    wanted = schema.get("type")
    if wanted and not has_type(value, wanted):
        yield path, f"expected {wanted}, got {type_name(value)}"
        return
    yield from ((path, message) for message in _own_errors(value, schema))
    if isinstance(value, dict):
        yield from ((f"{path}.{k}", "missing required field") for k in schema.get("required") or () if k not in value)
    for part in _parts(value, schema, path):
        yield from errors(part[1], part[2], part[0])


def schema_errors(docs: DataFrame, key: str, document: str, schema: dict) -> DataFrame:
    """(key, path, message): a row for each error in a column of JSON text; text that does not parse is one error at $."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for k, raw in zip(frame[key], frame[document], strict=True):
                try:
                    found = list(errors(json.loads(raw if isinstance(raw, str) else ""), schema))
                except ValueError as e:
                    found = [("$", f"not JSON: {e}")]
                rows += [(k, *f) for f in found]
            yield pd.DataFrame(rows, columns=[key, "path", "message"])

    return docs.select(key, F.col(document).cast("string").alias(document)).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, path string, message string")


def missing_keys(present: Column, required: Sequence[str]) -> Column:
    """Required names that an array of names lacks, in their order; all of them for null."""
    wanted = F.array(*[F.lit(k) for k in required])
    return F.array_except(wanted, F.coalesce(present, F.array().cast("array<string>")))


# ---- sections of the insights document: fixed values -----------------------------------------

CARDS = {
    "big_wins": ("title", "description"),
    "friction": ("title", "description"),
    "horizon": ("title", "whats_possible", "how_to_try"),
}
LISTS = {"suggestions": ("claude_md_additions", "features_to_try", "patterns_to_keep")}
OBJECTS = {"interaction_style": ("narrative_html", "key_pattern"), "fun_ending": ("headline", "detail")}
ROWS = {"project_areas": ("slug", "count", "share", "description")}

# ----------------------------------------------------------------------------------------------


def _fields(*names: str, **kinds: dict) -> dict:
    return {"type": "object", "required": list(names), "properties": kinds}


def insights_schema() -> dict:
    """The lighter check of insights as a schema of the same subset."""
    rows = {k: {"type": "array", "items": _fields(*f)} for k, f in ROWS.items()}
    objects = {k: _fields(*f) for k, f in OBJECTS.items()}
    cards = {k: _fields("intro", "cards", cards={"type": "array", "items": _fields(*f)}) for k, f in CARDS.items()}
    lists = {k: _fields(*f, **{x: {"type": "array"} for x in f}) for k, f in LISTS.items()}
    every = {**rows, **objects, **cards, **lists}
    return {"type": "object", "required": sorted(every), "properties": every}
