"""Best-fit-decreasing packing into bins of several permitted sizes.

Sizes are whole numbers up to the largest capacity, so the histogram of piece lengths, at most
that many rows however large the corpus, fixes the whole plan. The driver packs the histogram:
equal pieces are placed together, bins with equal contents are one group. The plan is a list of
rank intervals per length, which every piece looks up by its length and rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, map_rows, settle

#: Permitted sequence lengths, and what one sequence costs beyond its tokens.
CAPACITIES, OVERHEAD = (256, 512, 1024, 2048, 4096), 32

#: Pieces of one length and rank part that a single task numbers, about.
PART_ROWS = 200_000


def linear_cost(capacity: int) -> float:
    return capacity + OVERHEAD


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = linear_cost):
    """Rows (length, lo, hi, bin, per, offset, size): ranks lo to hi of that length go to bins from `bin` on, `per` to each, from `offset` on; the bins end up with that size.

    Lengths are taken in descending order. A piece goes to the open bin that it leaves least
    room in. Where none fits, the size opened is the one of least cost for each token that it
    can be expected to hold: what equal pieces fill of it, and of the rest as much as smaller
    pieces can still supply. In the end each bin shrinks to the least size that holds it.
    """
    sizes = sorted(set(capacities))
    rooms: list[int] = []  # sorted distinct free room of open bins
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, end bin, used)
    placed: list[tuple[int, int, int, int, int, int]] = []
    supply, bins = sum(n * k for n, k in counts.items()), 0

    def put(room: int, first: int, end: int, used: int) -> None:
        if first < end:
            if room not in open_bins:
                bisect.insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((first, end, used))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        supply -= length * left
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                def price(c: int) -> float:
                    fit = min(c // length, left)
                    rest = min(c - fit * length, supply * fit / left)
                    return cost(c) / (fit * length + rest)

                size = min((c for c in sizes if c >= length), key=lambda c: (price(c), c))
                n = -(-left // (size // length))
                put(size, bins, bins + n, 0)
                bins += n
                continue
            room = rooms[at]
            first, end, used = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            per = room // length
            full = min(end - first, left // per)
            if full:
                placed.append((length, rank, rank + full * per, first, per, used))
                put(room - per * length, first, first + full, used + per * length)
                rank, left, first = rank + full * per, left - full * per, first + full
            if left and first < end and left < per:
                placed.append((length, rank, rank + left, first, left, used))
                put(room - left * length, first, first + 1, used + left * length)
                left, first = 0, first + 1
            put(room, first, end, used)
    return _sized(placed, sorted(b for group in open_bins.values() for b in group), sizes)


def _sized(placed, groups, sizes):
    """Split intervals where the final contents of their bins differ, and add the size that holds these."""
    starts, out = [g[0] for g in groups], []
    for length, lo, hi, first, per, offset in placed:
        end = first + (hi - lo) // per
        at = bisect.bisect_right(starts, first) - 1
        while first < end:
            _, stop, used = groups[at]
            stop = min(stop, end)
            size = sizes[bisect.bisect_left(sizes, used)] if used else sizes[0]
            out.append((length, lo, lo + (stop - first) * per, first, per, offset, size))
            lo, first, at = lo + (stop - first) * per, stop, at + 1
    return out


def word_length(text: str | Column = "text") -> Column:
    """Words of a text and one end mark: its length where no tokenizer is given."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1


def token_lengths(docs: DataFrame, tokenizer_file: str, name: str = "n_tokens") -> DataFrame:
    """doc_id and the number of tokens, with one end mark, under a public tokenizer's JSON file.

    The file is read once, on the driver, and travels with the tasks.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        vocabulary = f.read()

    def count(rows):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary)
        t.encode_special_tokens = True
        for doc_id, text in rows:
            yield doc_id, len(t.encode(text or "", add_special_tokens=False).ids) + 1

    return map_rows(docs.select("doc_id", "text"), count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {name} int")


def pack(
    docs: DataFrame,
    length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = linear_cost,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, bin_size) for every piece of every document.

    length is the documents' length in tokens, by default words and an end mark, so null and
    empty texts are pieces of length 1. A document longer than the largest capacity is cut
    into pieces of that capacity and a rest. Lengths below 1 or null count as 1. Pieces of
    equal length are taken in the order of their hash part, doc_id and piece; rows that repeat
    a doc_id are packed one by one. An empty table gives an empty table.
    """
    spark, most = docs.sparkSession, max(capacities)
    size = F.greatest(F.coalesce((word_length() if length is None else length).cast("int"), F.lit(1)), F.lit(1))
    sized, _ = settle(docs.select("doc_id", size.alias("total")), "packing")  # a text is read once
    cut = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / most).cast("int"))).alias("piece"))
    pieces = cut.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("total") - F.col("piece") * most).alias("length"))
    parts = _parts(pieces, part_rows)
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counted = keyed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = counted.select("length", "part", before.alias("base"))
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}
    rows = plan(histogram, capacities, cost)
    schema = "length int, lo bigint, hi bigint, first bigint, per bigint, offset int, bin_size int"
    intervals = spark.createDataFrame(rows, schema)
    in_part = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = keyed.withColumn("rn", in_part).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rn") - 1)
    # at most a few intervals for each of `most` lengths, whatever the corpus
    found = ranked.join(F.broadcast(intervals), "length").filter("rank >= lo and rank < hi")
    step = F.col("rank") - F.col("lo")
    return found.select(
        "doc_id", "piece", "start", "length",
        (F.col("first") + F.floor(step / F.col("per"))).alias("bin_id"),
        (F.col("offset") + step % F.col("per") * F.col("length")).cast("int").alias("bin_offset"),
        "bin_size",
    )


def _parts(pieces: DataFrame, part_rows: int) -> int:
    return max(32, pieces.count() // part_rows)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
