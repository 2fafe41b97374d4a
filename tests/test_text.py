import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import lexicon, markdown, stats, text
from colloquy.operators import proposals


def values(spark, rows, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("given", "word"),
    [("**Don't** do", "don't"), ("- **Don't** do", None), ("don’t", "don"), ("I think", None), ("ok,", "ok"), ("/ship now", "ship"), ("no-op", "no-op"), ("", None), (None, None)],
)
def test_first_word(spark, given, word):
    assert values(spark, [given], text.first_word) == [word]


def test_tokens_equal_a_plain_regex(spark):
    rng = random.Random(7)
    rows = ["".join(rng.choice("ab'-_é 1.\n😀") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    wanted = [[t.lower() for t in re.findall(r"\b[\w'-]{2,}\b", r)] for r in rows]
    assert values(spark, rows, text.tokens) == wanted


def test_small_functions(spark):
    assert values(spark, ["A b! C d", "x" * 300], lambda x: text.first_sentence(x, 20)) == ["A b", "x" * 20 + "..."]
    assert values(spark, ["Héllo, World!", "!!!"], text.slugify) == ["h_llo_world", "rule"]
    assert values(spark, ["abc"], text.content_hash) == ["ba7816bf8f01cfea"]
    assert values(spark, ["run /ship and `/a:b x/y"], text.slash_commands) == [["/ship", "/a:b"]]
    assert values(spark, ["<p>a &amp; b</p>"], text.html_to_text) == ["a & b"]
    assert values(spark, ["<a>&'"], text.escape_html) == ["&lt;a&gt;&amp;&#x27;"]
    assert values(spark, ["  Jo<script>e  ", "<<>>"], text.safe_name) == ["Joscripte", "user"]
    assert values(spark, ["-home-me-work-site"], text.short_project) == ["work-site"]
    assert values(spark, ["**Why:** one\n**How:** two\nmore"], text.labelled_sections) == [{"why": "one", "how": "two more"}]
    assert values(spark, [["run rm x", "edit", "Deploy to prod"]], lambda x: text.allowed(x, lexicon.DESTRUCTIVE), "array<string>") == [["edit"]]
    assert values(spark, ['he said "this is a long enough quotation, yes"'], text.quoted_part) == ["this is a long enough quotation, yes"]


def test_automated_text(spark):
    wake = lambda x: text.is_auto_wake(x, lexicon.CORPUS_WAKE_PREFIXES)
    assert values(spark, ["", None, "You are agent 5", "hello"], wake) == [True, True, True, False]
    strict = lambda x: text.is_auto_wake_strict(x, lexicon.DETECTOR_WAKE_PREFIXES)
    assert values(spark, ["<task-id> x", "## Paperclip x", "fix the bug", "see Task Notification here"], strict) == [True, False, False, True]


def test_markdown_probes(spark):
    plan = "---\nName: \"x\"\nname: y\n---\n## Phase 1\n- [ ] a\n1. b\n## Step 2\n## Out of scope\n## Verification\n"
    row = spark.createDataFrame([(plan,)], "x string").select(
        markdown.archetype(F.col("x")), markdown.count(F.col("x"), markdown.ACCEPTANCE_LINE), F.col("x").rlike(markdown.OUT_OF_SCOPE), markdown.front_matter(F.col("x"))
    ).first()
    assert tuple(row) == ("multi-phase", 2, True, {"name": "y"})


def test_statistics(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    row = df.agg(stats.percentile(F.col("x"), 0.5), stats.percentile(F.col("x"), 0.9), stats.upper_median(F.collect_list("x"))).first()
    assert tuple(row) == (2.5, 3.7, 3)
    import statistics

    rng = random.Random(3)
    for n in (1, 9, 10, 11, 37):
        xs = [rng.randint(1, 500) for _ in range(n)]
        wanted = int(statistics.quantiles(xs, n=10)[-1]) if n >= 10 else max(xs)
        assert values(spark, [xs], stats.exclusive_decile_90, "array<int>") == [wanted]
        assert spark.createDataFrame([(x,) for x in xs], "x int").agg(stats.decile_90_of(F.col("x"), n)).first()[0] == wanted


def test_proposal_sections(spark):
    df = spark.createDataFrame([("No. Use tabs.", "I used spaces.", "p", "t")], "r string, a string, p string, t string")
    body = df.select(proposals.proposal_body(*map(F.col, "rapt")).alias("b"))
    assert body.select(proposals.unfilled_sections(F.col("b"))).first()[0] == list(proposals.SECTIONS)
    done = body.select(F.replace("b", F.lit("_Fill in._"), F.lit("because")).alias("b"))
    assert done.select(proposals.unfilled_sections(F.col("b"))).first()[0] == []
