"""The seam to an external extractor, and repair of the JSON that it returns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: prompt -> raw answer. Only stand-ins ship with this library; nothing here calls out.
Extractor = Callable[[str], str]


def canned(answers: dict[str, str], default: str = "{}") -> Extractor:
    """A stand-in that answers by the first key found in the prompt."""
    return lambda prompt: next((a for k, a in answers.items() if k in prompt), default)


def bare_json(raw: str) -> str:
    """Without a code fence, and from the first to the last brace."""
    fenced = re.fullmatch(r"\s*```(?:json)?[ \t]*\n(.*?)\n?```\s*", raw, re.DOTALL)
    inner = fenced[1] if fenced else raw.strip()
    first, last = inner.find("{"), inner.rfind("}")
    return inner if inner.startswith("{") or first < 0 or last < first else inner[first : last + 1]


def parse(raw: str) -> tuple[dict | None, str]:
    """(object, note): strict parsing; then without one brace that closes the object too early; then the first object alone."""
    text = bare_json(raw)
    try:
        return json.loads(text), ""
    except ValueError as e:
        problem = str(e)
    early = re.compile(r"\}(?=\}\s*,\s*\"[a-z_]+\"\s*:)|\}(?=,\s*\"[a-z_]+\"\s*:)")
    for m in early.finditer(text):
        try:
            return json.loads(text[: m.start()] + text[m.end() :]), "removed a brace that closed the object early"
        except ValueError:
            continue
    try:
        found, end = json.JSONDecoder().raw_decode(text)
    except ValueError:
        return None, problem
    return found, f"kept the first object, dropped {len(text[end:].strip())} characters"


def extract(packets: DataFrame, key: str, prompt: str, extractor: Extractor) -> DataFrame:
    """(key, document, note): each prompt's answer as repaired JSON text, null where nothing parses."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for k, p in zip(frame[key], frame[prompt], strict=True):
                found, note = parse(extractor(p))
                rows.append((k, None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True), note))
            yield pd.DataFrame(rows, columns=[key, "document", "note"])

    return packets.select(key, F.col(prompt)).mapInPandas(run, f"{key} {packets.schema[key].dataType.simpleString()}, document string, note string")
