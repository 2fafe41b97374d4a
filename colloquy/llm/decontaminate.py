"""Benchmark decontamination by pigeonhole edit matching.

A test item may be reproduced with up to rate * length edits. Split into one piece more than
that, at least one piece survives intact, so exact piece hits from one pass of an automaton
name all places worth a look; Myers' bit-parallel distance settles each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import edit_kernel as kernel
from .common import map_rows, ship

ship(kernel)

#: Edits allowed for each character of a normalised item.
ERROR_RATE = 0.08

#: Characters of test items that one automaton holds; a larger benchmark is taken in blocks.
BLOCK_CHARS = 1_000_000


def _blocks(benchmark: DataFrame, block_chars: int):
    """The test items in lists of about block_chars characters; each is collected by itself."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // block_chars
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best occurrence of each test item in each document.

    Texts and items are compared as lower-case runs of letters and digits with single spaces;
    start and end are code points of the original text. distance <= int(rate * item length);
    items too short for an edit must stand as whole words. Of equal distances the least start,
    and for it the least end, counts. Null, empty and wordless texts or items match nothing. Repeated rows repeat their
    matches; items with the same text each match. An empty table gives an empty table.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, start int, `end` int"
    rows = docs.select("doc_id", "text")
    found = [map_rows(rows, lambda it, items=items: kernel.scan(it, items, rate), schema) for items in _blocks(benchmark, block_chars)]
    return reduce(DataFrame.unionByName, found)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that reproduce a test item, each judged by its own text; nothing is shuffled."""
    at, names = docs.columns.index("text"), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may hold dots
    for items in _blocks(benchmark, block_chars):
        plain = plain.mapInArrow(lambda batches, items=items: _clean(batches, at, items, rate), plain.schema)
    return plain.toDF(*names)


def _clean(batches, at: int, items: list[tuple], rate: float):
    import pyarrow as pa

    matcher = kernel.Matcher(items, rate)
    for batch in batches:
        text = batch.column(at)
        mask = [next(matcher.matches(text[i].as_py()), None) is None for i in range(batch.num_rows)]
        yield batch.filter(pa.array(mask, pa.bool_()))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
