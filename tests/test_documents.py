import json

import pytest

from colloquy.render import charts, markup, reports
from colloquy.validate import extraction, migration, schema

SCHEMA = {
    "type": "object", "required": ["v", "items"],
    "properties": {"v": {"type": "string", "pattern": r"v\d+", "const": "v4"}, "items": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "integer", "minimum": 3}}},
    "additionalProperties": {"type": "string"},
}


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        ({"v": "v4", "items": [3], "x": "y"}, []),
        ([], [("$", "expected object, got array")]),
        ({"v": "w", "items": []}, [("$.v", "expected to match 'v\\\\d+', got 'w'"), ("$.v", "expected 'v4', got 'w'"), ("$.items", "expected at least 1 items, got 0")]),
        ({"items": [True, 2, 4], "x": 1}, [("$.v", "missing required field"), ("$.items", "expected at most 2 items, got 3"), ("$.items[0]", "expected integer, got boolean"), ("$.items[1]", "expected >= 3, got 2"), ("$.x", "expected string, got integer")]),
    ],
)
def test_schema(value, wanted):
    assert sorted(schema.errors(value, SCHEMA)) == sorted(wanted)


def test_schema_rows(spark):
    df = spark.createDataFrame([(1, json.dumps({"v": "v4", "items": [3]})), (2, "{"), (3, None), (4, "{}")], "id int, doc string")
    found = [(r.id, r.path) for r in schema.schema_errors(df, "id", "doc", SCHEMA).collect()]
    assert sorted(found) == [(2, "$"), (3, "$"), (4, "$.items"), (4, "$.v")]
    assert len(list(schema.errors({}, schema.insights_schema()))) == 7


def test_migration():
    legacy = {k: {} for k in migration.LEGACY_FIELDS} | {"never_rules": ["Never push", {"rule": " never  delete "}, 3]}
    done = migration.migrate(legacy)
    assert done.defaulted and done.spec["$schema_version"] == "v0.4" and done.spec["constitution"]["limits"] == ["Never push", "never  delete", "3"]
    assert legacy.get("$schema_version") is None and migration.migrate(done.spec) == migration.Migrated(done.spec)
    assert "strict" not in (migration.migrate(legacy, strict=True).problem or "") and migration.migrate(legacy, strict=True).spec is None
    assert "unsupported version <unversioned>" in migration.migrate({}).problem
    assert "unsupported version [1]" in migration.migrate({"$schema_version": [1]}).problem


def test_sources_and_degraded_documents():
    legacy = {k: {} for k in migration.LEGACY_FIELDS} | {"never_rules": ["- a"], "decision_policy": {"decide_alone": ["read", "force-push it", "rm -rf x"], "evidence": "seen"}}
    done = migration.migrate(legacy)
    assert done.sources["constitution.limits"] == "never_rules" and done.sources["constitution.values"] == migration.CAUTION
    assert done.sources["substitution_contract.evidence"] == "decision_policy.evidence" and done.spec["substitution_contract"]["evidence"] == "seen"
    assert migration.migrate(done.spec).sources is None
    empty = migration.degraded("Kim", "no document")
    assert not migration.missing_sections(empty.spec) and set(migration.LEGACY_FIELDS) <= set(empty.spec) and migration.migrate(empty.spec).spec == empty.spec
    assert set(empty.sources.values()) == {migration.CAUTION} and "Kim" in empty.spec["identity"][0]["fact"] and empty.problem == "no document"


@pytest.mark.parametrize(
    ("raw", "found"),
    [('```json\n{"a": 1}\n```', {"a": 1}), ('Sure: {"a": 1} done', {"a": 1}), ('{"a": {"b": [{"c": 1}]}},"horizon": 2}', {"a": {"b": [{"c": 1}]}, "horizon": 2}), ('{"a": 1} {"b"', {"a": 1}), ("none", None)],
)
def test_json_repair(raw, found):
    assert extraction.parse(raw)[0] == found


def test_extractor(spark):
    df = spark.createDataFrame([(1, "about x"), (2, "about y")], "id int, prompt string")
    out = extraction.extract(df, "id", "prompt", extraction.canned({"x": '```json\n{"k": 1}\n```'}, "no json"))
    assert sorted((r.id, r.document) for r in out.collect()) == [(1, '{"k": 1}'), (2, None)]


def test_markup():
    assert markup.fill("{{A}} {{B}}", {"A": 1}) == "1 _TBD_B_"
    assert markup.to_html("# T\n\n- a **b**\n- c\n\n1. x\n\n> q\n\n| h |\n|---|\n| v |\n\n---\ntext `c`") == (
        "<h3>T</h3>\n<ul><li>a <strong>b</strong></li><li>c</li></ul>\n<ol><li>x</li></ol>\n<blockquote>q</blockquote>\n"
        "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table>\n<hr>\n<p>text <code>c</code></p>"
    )
    assert markup.clean_html('<p onclick="x">a<script>b</script> &lt; <i>c</i><br></p>') == "<p>a &lt; c<br></p>"
    assert markup.escaped({"A": "<", "B": "<b>"}, raw=["B"]) == {"A": "&lt;", "B": "<b>"}


def test_charts():
    assert charts.text_bars([("a", 2), ("bb", 1)], width=4) == " a ████ 2\nbb ██ 1"
    for svg in (charts.columns([("1", 2)], "q<", "1"), charts.rows([("a", 1)], "t"), charts.donut([("a", 0)], "t"), charts.drift(["x"], []), charts.percentile_bar(3, 9)):
        assert svg.startswith("<svg") and svg.endswith("</svg>") and "q<" not in svg
    assert charts.hour_text({}).count("\n") == 23


def test_reports(spark, tmp_path):
    from datetime import datetime

    rows = [(i, f"hello world number {i} /ship", "p", datetime(2026, 1, 1, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id int, text string, project string, ts timestamp")
    n = reports.numbers(df)
    assert n["n"] == 6 and n["top_slash_commands"] == [("/ship", 6)] and "hello" in reports.numbers_markdown(n)
    a = reports.activity(df, "ts", "event_id")
    assert a["hour_histogram"][3] == 1 and a["work_bursts"]["n"] == 1 and reports.activity_markdown(a)
    reports.write_json(a, str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text())["n"] == 6


def test_reply_plan_and_comment_reports(spark):
    from colloquy.operators import inventory, pairs

    replies = spark.createDataFrame([("x", "yes"), ("x", "ok go"), ("x", "no, use tabs"), ("x", "hm")], "assistant string, reply string")
    c = reports.convergence(pairs.classified(replies))
    assert c["n_pairs"] == 4 and c["classes"]["explicit_pushback"]["n"] == 1 and c["first_words"]["explicit_pushback"] == [("no", 1)]
    assert c["quotes"] == {"explicit_pushback": [(12, "no, use tabs")], "implicit_pushback": []}
    text = reports.convergence_markdown(c)
    assert "| no | 1 |" in text and "12 chars: no, use tabs" in text and "times as long" in text

    files = spark.createDataFrame([(f"p{i}", "# T", 9, f"2026-01-0{i}") for i in range(1, 5)], "path string, value string, size_bytes int, mtime string")
    lines = list(reports.plans_markdown(inventory.plans(files)))
    assert [x.split("| ")[-1] for x in lines[-4:]] == ["p4 |", "p3 |", "p2 |", "p1 |"] and any("over time" in x for x in lines)

    comments = spark.createDataFrame([("o/r", 1, "u1", "## H and more"), ("o/r", 2, "u2", "x")], "repo string, pr bigint, url string, body string")
    report = reports.comments_markdown(comments, k=1)
    assert "| n_comments | 2 |" in report and "### o/r#1\n\n<u1>" in report and "#2" not in report
