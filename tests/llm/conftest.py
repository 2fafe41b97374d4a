import pytest

#: Names that the operators use for columns of their own.
CLASHING = ("fp", "hash", "idx", "kind", "start", "end", "length", "score", "spans", "key", "n", "_marks", "_lines", "component_id", "a.b", "part", "_n")

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))

TEXTS = [
    (1, "one two three four five six\nseven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \n\t "), (5, "x"),
    (6, LONG), (7, "one two three four five six\nseven eight nine ten eleven twelve"), (7, "one two three four five six\nseven eight nine ten eleven twelve"),
    (None, "one two three four five six\nseven eight nine ten eleven twelve"), (None, None), (8, "a" * 200_000), (9, "é😀 ünï\r\n" * 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, None, "s", None if t is None else len(t), *["c"] * len(CLASHING)) for i, t in TEXTS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1 if i % 2 else 0, 1 if i % 3 == 0 else 0) for i in range(1, 10)] + [(None, 1, 1), (5, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
