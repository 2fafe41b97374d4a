import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from colloquy.functions.lexicon import DETECTOR, MINING, Lexicon
from colloquy.operators import corpus, evaluation, inventory, ordering, pairs, proposals, quantitative, temporal


def test_ranks_and_runs_across_slabs(spark):
    import random

    rng = random.Random(4)
    keys = [rng.choice([rng.randint(0, 400), 77, 1000 + rng.randint(0, 5)]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(4)
    ranked = sorted(keys)
    for slabs in (1, 3, 9):
        for rank in (1, 2, 100, 250, 499, 500):
            key, before, same = ordering.key_at(df, "k", rank, slabs)
            assert (key, before, same) == (ranked[rank - 1], sum(x < key for x in keys), keys.count(key))
        wanted, last = [], None
        for x in ranked:
            if last is None or x - last > 3:
                wanted.append(0)
            wanted[-1] += 1
            last = x
        assert sorted(r["size"] for r in ordering.run_sizes(df, "k", 3, slabs).collect()) == sorted(wanted)


def test_pairing_micro_fixture(spark):
    rows = [("user", "no, wait"), ("assistant", "plan one"), ("assistant", "plan two"), ("assistant", None), ("user", "go"), ("assistant", "plan three"),
            ("user", None), ("user", "stop that"), ("assistant", "plan four"), ("user", "## Paperclip wake")]
    df = spark.createDataFrame([("s", i, r, t) for i, (r, t) in enumerate(rows)], "session string, line int, role string, text string")
    found = pairs.turn_pairs(df, ["session"], "line", MINING.wake_prefixes).collect()
    assert [(r.line, r.assistant, r.reply) for r in found] == [(4, "plan two", "go")]


def test_pairing_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice(["user", "assistant", "system"]), rng.choice([None, "", f"t{i}"])) for s in range(20) for i in range(30)]
    wanted, said = [], {}
    for s, i, role, t in rows:
        if role == "assistant" and t:
            said[s] = t
        elif role == "user":
            if t and s in said:
                wanted.append((s, i, said[s], t))
            said.pop(s, None)
    df = spark.createDataFrame(rows, "session int, line int, role string, text string")
    assert sorted(map(tuple, pairs.turn_pairs(df, ["session"], "line").collect())) == wanted


def test_recovery_cycles(spark):
    words = "stop what wait ok no go".split()
    df = spark.createDataFrame([("s", i, w) for i, w in enumerate(words)], "session string, i int, w string")
    found = temporal.recovery_cycles(df, ["session"], ["i"], F.col("w").isin("stop", "wait", "no"), F.col("w").isin("ok", "go"))
    assert [r.turns for r in found.collect()] == [3, 1]


def test_bursts(spark):
    start = datetime(2026, 1, 1)
    at = lambda *minutes: spark.createDataFrame([(i, start + timedelta(minutes=m)) for i, m in enumerate(minutes)], "event_id int, ts timestamp")
    assert sorted(r["size"] for r in temporal.bursts(at(0, 120, 241)).collect()) == [1, 2]
    rng = random.Random(2)
    minutes = sorted(rng.randint(0, 60_000) for _ in range(500))
    sizes, last = [], None
    for m in minutes:
        if last is None or m - last > 120:
            sizes.append(0)
        sizes[-1] += 1
        last = m
    assert sorted(r["size"] for r in temporal.bursts(at(*minutes)).collect()) == sorted(sizes)
    assert temporal.bursts(at()).count() == 0


def test_positions_over_slabs(spark):
    rng = random.Random(1)
    keys = [rng.randint(0, 50) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    found = {r.id: r.position for r in ordering.with_position(df, "k", "id", slabs=8).collect()}
    assert found == {i: p for p, (k, i) in enumerate(sorted((k, i) for i, k in enumerate(keys)), 1)}


def test_cached_rows(spark):
    long = "please refactor the parser so that it handles nested blocks well"
    rows = [("a", long, False), ("a", long[:50] + "…", True), ("a", "other text entirely", True), ("b", long, True), ("a", "  " + long.replace(" ", "  "), True), ("a", "please", True)]
    df = spark.createDataFrame(rows, "session string, text string, cached boolean")
    left = corpus.drop_cached(df, ["session"], F.col("cached"))
    assert sorted(map(tuple, left.select("session", "text", "cached").collect())) == sorted([rows[0], rows[2], rows[3], rows[5]])


def test_detector_classes(spark):
    replies = ["stop it", "lgtm", "sounds good to me", "sounds wrong", "however " + "x" * 300, "y instead of " + "x" * 300, "fine"]
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    found = [tuple(r.d) for r in df.select(pairs.detect(F.col("reply"), F.lit(20.0), DETECTOR).alias("d")).collect()]
    assert [f[0] for f in found] == ["explicit_pushback", "approval", "approval", "neutral", "explicit_pushback", "implicit_pushback", "neutral"]
    assert [f[1] for f in found] == [0.9, 0.95, 0.9, 0.0, 0.9, 0.9, 0.0]


def test_candidates_and_spill(spark):
    df = spark.createDataFrame([("a", "no use tabs"), ("a", "no use tabs"), ("a", "stop now"), ("a", "ok"), ("a", "   ")], "assistant string, reply string")
    pool = proposals.candidates(df)
    assert sorted(r.reply for r in pool.collect()) == ["no use tabs", "stop now"]
    split = proposals.split_spill(pool, 1, F.desc("confidence"), "hash").collect()
    assert sum(r.emitted for r in split) == 1 and len(split) == 2


def test_anchor_is_the_upper_median(spark):
    df = spark.createDataFrame([("ok " + "y" * n,) for n in (1, 3, 5, 7)], "reply string")
    assert proposals.anchor(df).first()[0] == 8.0
    assert proposals.anchor(df.filter("reply = ''")).first()[0] == 50.0


def test_coverage(spark):
    replies = spark.createDataFrame([(1, "please always prefer small focused commits"), (2, "unrelated words entirely different")], "id int, reply string")
    rules = spark.createDataFrame([(9, "Always prefer small, focused commits")], "rid int, rule string")
    assert [r.id for r in proposals.covered(replies, rules, "id", "rid").collect()] == [1]


def test_language_dominance(spark):
    df = spark.createDataFrame([("ich mag das nicht",), ("auch gut",), ("hello",)], "text string")
    assert tuple(quantitative.dominant_language(quantitative.language_counts(df)).first()) == ("german", 2, 66.7)


def test_scores(spark):
    case = [("1", "c", (["ship"], True, True, False, True, ["sorry"], [["a"], ["tests"]], ["never"], 900), "Ship it: a fresh run of the tests passed.", "I understand. Shall I wait?")]
    schema = f"id string, category string, expected struct<{evaluation.EXPECTED.replace(' array', ':array').replace(' boolean', ':boolean').replace(' int', ':int')}>, twin_response string, generic_response string"
    row = evaluation.scored(spark.createDataFrame(case, schema)).first()
    assert (row.twin.total, row.twin.max, row.generic.total) == (8, 8, 3)
    up = evaluation.roll_up(evaluation.scored(spark.createDataFrame(case, schema)), "category").first()
    assert (up.n, up.twin_mean, up.win_rate, up.trigger_hit_rate, up.trigger_avoidance_rate) == (1, 1.0, 1.0, 1.0, 1.0)


def test_plan_halves_and_decisions(spark):
    df = spark.createDataFrame([(i, i >= 6, i) for i in range(10)], "at int, flag boolean, n int")
    row = inventory.halves(df, "at", "n", F.col("flag"), F.col("n")).first()
    assert (row.late_n, row.early_n, row.late_pct, row.early_pct, row.late_sum, row.early_sum) == (5, 5, 80.0, 0.0, 35, 10)
    assert inventory.halves(df.limit(3), "at", "n", F.col("flag"), F.col("n")).count() == 0
    told = spark.createDataFrame([("h", "approve", 1), ("h", "reject", 3), ("h", "defer", 2)], "hash string, decision string, at int")
    assert tuple(proposals.latest_decisions(told).first()) == ("h", "reject", 3)


def test_empty_lexicon_words_do_not_break(spark):
    df = spark.createDataFrame([("x", "the answer")], "assistant string, reply string")
    own = Lexicon(approval=("zz",), pushback=("yy",), markers="qq")
    assert pairs.classified(df, own).first()["class"] == "neutral"
