from colloquy.operators import findings
from colloquy.render import documents


def packet(spark, **values):
    names = [c.split()[0] for c in findings.PACKET.split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], findings.PACKET)


def test_thresholds(spark):
    names = lambda **v: {r["name"] for r in findings.fired(packet(spark, **v)).collect()}
    assert names() == set()
    assert names(slash_share_pct=40.0, n_pairs=10, n_approval=200, n_implicit=1, n_plans=0, has_oos_pct=0.0, n_multi_phase=0) == {"approval_share"}
    assert names(slash_share_pct=39.9, n_pairs=10, n_approval=201, n_implicit=2, n_plans=4, has_oos_pct=59.9, n_multi_phase=5, n_notes=1, early_oos_pct=10.0, late_oos_pct=15.1) == {
        r.name for r in findings.rules()
    }
    assert "rising_rigor" not in names(early_oos_pct=10.0, late_oos_pct=15.0)


def test_most_striking(spark):
    one = packet(spark, peak_hour=9, peak_hour_n=200, n_explicit=100)
    assert findings.most_striking(one).first().text == "Most happens at 9:00."
    drift = spark.createDataFrame([("rising", "a"), ("falling", "b")], "direction string, word string")
    assert findings.most_striking(one, drift).first().score == 300
    assert findings.most_striking(packet(spark)).count() == 0


def test_suggestions_and_quotes(spark):
    ideas = spark.createDataFrame([("A", "a", ["token", "long"]), ("B", "b", ["backfill"])], "title string, body string, hints array<string>")
    notes = spark.createDataFrame([("n", "Keep Tokens short")], "name string, description string")
    assert [r.title for r in findings.uncovered(ideas, notes).collect()] == ["B"]
    report = spark.createDataFrame([("r.md", "- ship it\nverify\n* Merge early\n- other")], "path string, value string")
    assert [r.line for r in findings.quoted_lines(report, ["ship", "merge", "verify"]).collect()] == ["ship it", "Merge early"]


def test_documents(tmp_path):
    spec = {"identity": {"name": "x"}, "never_rules": ["a", "b"], "verification_policy": {"steps": ["run"]}, "evidence": {"a": "seen"}}
    files = documents.rule_files(spec, "today")
    assert len(files) == 5 and "- a (seen)\n- b" in files["rules/preferences.md"] and "- run" in files["rules/verification.md"]
    assert documents.write_all(str(tmp_path), files) == sorted(files) and documents.write_all(str(tmp_path), files) == []
    assert documents.cards_html([{"name": "a_b", "text": "<x>"}]) == "<section><h4>A b</h4><p>&lt;x&gt;</p></section>"
    assert documents.context({"$schema_version": "v0.4"}) == {"SCHEMA_VERSION": "v0.4"}


def test_uncovered_by_many_hints(spark):
    """The way for long lists gives what the one for short lists gives."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB ") for _ in range(rng.randint(1, 5)))
    suggestions = spark.createDataFrame([(f"t{i}", "b", [word() for _ in range(rng.randint(0, 2))]) for i in range(120)], "title string, body string, hints array<string>")
    notes = spark.createDataFrame([(word() + word(), word()) for _ in range(12)] + [(None, None)], "name string, description string")
    few = sorted(r.title for r in findings.uncovered(suggestions, notes).collect())
    assert sorted(r.title for r in findings.uncovered(suggestions, notes, most=3).collect()) == few and 0 < len(few) < 120
