"""Sections of a spec as Markdown, rule files, cards, and the writing of a whole set of outputs."""

from __future__ import annotations

import html
import json
import os
import re
import tempfile
from collections.abc import Iterable, Mapping, Sequence

from .markup import bullets, escaped, fill, numbered, table

#: Which sections of a spec each rule file holds.
RULE_FILES = {
    "substitution": ("substitution_contract", "constitution", "trust_policy", "agent_supervision_policy"),
    "preferences": ("identity", "voice_policy", "always_rules", "never_rules"),
    "workflows": ("operating_model", "workflow_policy", "delegation_policy", "decision_policy", "project_routing"),
    "verification": ("verification_policy",),
    "recovery": ("recovery_policy",),
}


def title(name: str) -> str:
    return name.replace("_", " ").capitalize()


def section(value: object, evidence: Mapping[str, str] | None = None, limit: int | None = None) -> str:
    """Text as it is, lists as bullets, objects as labelled parts; with the evidence of a rule behind it where there is some."""
    if isinstance(value, Mapping):
        return "\n\n".join(f"**{title(k)}:** " + (v if isinstance(v, str) else "\n" + section(v, evidence, limit)) for k, v in value.items() if v not in (None, "", [], {}))
    if isinstance(value, list):
        items = (_item(x) for x in (value if limit is None else value[:limit]))
        return bullets(f"{x} ({evidence[x]})" if evidence and x in evidence else x for x in items)
    return "" if value is None else str(value)


def _item(x: object) -> str:
    return "; ".join(f"{title(k)}: {v}" for k, v in x.items()) if isinstance(x, Mapping) else str(x)


def sections(spec: Mapping[str, object], names: Iterable[str]) -> str:
    evidence = spec.get("evidence") if isinstance(spec.get("evidence"), Mapping) else None
    return "\n\n".join(f"## {title(n)}\n\n{section(spec[n], evidence)}" for n in names if spec.get(n))


def rule_files(spec: Mapping[str, object], date: str) -> dict[str, str]:
    """Text of each rule file by its name."""
    return {f"rules/{k}.md": f"# {title(k)}\n\n_{date}_\n\n{sections(spec, names)}\n" for k, names in RULE_FILES.items()}


def context(spec: Mapping[str, object]) -> dict[str, str]:
    """Template values: each section under its upper-case name."""
    return {k.upper().lstrip("$"): section(v) for k, v in spec.items()}


def cards_markdown(cards: Iterable[Mapping[str, object]]) -> str:
    """Cards with name and text, grouped in the order given."""
    return "\n\n".join(f"**{title(str(c['name']))}**\n\n{c['text']}" for c in cards)


def cards_html(cards: Iterable[Mapping[str, object]]) -> str:
    one = lambda c: f"<section><h4>{html.escape(title(str(c['name'])))}</h4><p>{html.escape(str(c['text']))}</p></section>"
    return "\n".join(one(c) for c in cards)


def gotchas(first_words: Mapping[str, Sequence[tuple[str, int]]], date: str, most: int = 10) -> str:
    """What people object with: for each kind of pushback the words that most often begin it."""
    kinds = [(k, words[:most]) for k, words in first_words.items() if "pushback" in k]
    parts = [f"## {title(k)}\n\n" + (numbered(f"`{w}` ({n})" for w, n in words) or "None.") for k, words in kinds]
    return "\n\n".join([f"# Gotchas\n\n_{date}_", *parts]) + "\n"


def figures(values: Mapping[str, object], date: str) -> str:
    """The figures that all other documents of a run quote."""
    return f"# Figures\n\n_{date}_\n\n{table(('figure', 'value'), values.items())}\n"


def output_set(
    templates: Mapping[str, str], values: Mapping[str, object], first_words: Mapping[str, Sequence[tuple[str, int]]], numbers: Mapping[str, object], date: str,
    spec: Mapping[str, object] | None = None, record: Mapping[str, object] | None = None,
) -> tuple[dict[str, str], list[str]]:
    """(text of every document of a run by its name, keys that no value fills).

    Templates are filled, those named *.html with escaped values. Beside them stand the rule
    files of a spec, gotchas.md, numbers.md, and run.json, which names all documents.
    """
    out = {name: fill(t, escaped(values) if name.endswith(".html") else values) for name, t in templates.items()}
    open_keys = sorted({k for t in out.values() for k in re.findall(r"_TBD_([A-Z0-9_]+)_", t)})
    out |= rule_files(spec, date) if spec else {}
    out |= {"gotchas.md": gotchas(first_words, date), "numbers.md": figures(numbers, date)}
    run = {"generated": date, **numbers, **(record or {}), "had_spec": bool(spec), "open_keys": open_keys, "outputs": sorted([*out, "run.json"])}
    return out | {"run.json": json.dumps(run, ensure_ascii=False, indent=2, default=str)}, open_keys


def write_all(folder: str, documents: Mapping[str, str]) -> list[str]:
    """Write each document under its relative path, whole or not at all; unchanged files are left alone. Returns what was written."""
    written = []
    for name, text in sorted(documents.items()):
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                if f.read() == text:
                    continue
        handle, part = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
        written.append(name)
    return written
