"""Activity histograms, bursts, recovery cycles and vocabulary drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text, time
from .ordering import key_at, run_sizes


def hour_histogram(df: DataFrame, ts: str = "ts", offset_hours: int = 0) -> DataFrame:
    """(hour, n) with all 24 hours."""
    counted = df.groupBy(time.hour(time.local(F.col(ts), offset_hours)).alias("hour")).agg(F.count("*").alias("n"))
    slots = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return slots.join(F.broadcast(counted), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def day_histogram(df: DataFrame, ts: str = "ts", offset_hours: int = 0) -> DataFrame:
    """(day, n); Monday is 0."""
    counted = df.groupBy(time.day(time.local(F.col(ts), offset_hours)).alias("day")).agg(F.count("*").alias("n"))
    slots = df.sparkSession.range(7).select(F.col("id").cast("int").alias("day"))
    return slots.join(F.broadcast(counted), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def peaks(df: DataFrame, ts: str = "ts", offset_hours: int = 0) -> DataFrame:
    """One row: the busiest hour and weekday with their counts; equal counts go to the one whose first event is earliest."""
    at = time.local(F.col(ts), offset_hours)

    def busiest(slot: Column, name: str) -> DataFrame:
        counted = df.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(ts).alias("first"))
        top = F.max_by(F.struct("slot", "n"), F.struct("n", -time.micros(F.col("first"))))
        return counted.agg(top.alias("t")).select(F.col("t.slot").alias(f"peak_{name}"), F.col("t.n").alias(f"peak_{name}_n"))

    return busiest(time.hour(at), "hour").crossJoin(F.broadcast(busiest(time.day(at), "day")))


def activity_range(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.count(ts).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def bursts(df: DataFrame, ts: str = "ts", gap_minutes: int = 120) -> DataFrame:
    """(burst, size) over the global order of ts; a gap longer than gap_minutes begins a new one."""
    keyed = df.filter(F.col(ts).isNotNull()).select(time.micros(F.col(ts)).alias("_us"))
    return run_sizes(keyed, "_us", gap_minutes * 60_000_000).withColumnRenamed("run", "burst")


def bursts_by(df: DataFrame, key: str, ts: str = "ts", gap_minutes: int = 120) -> DataFrame:
    """(key, size) of each burst of each key."""
    window = F.session_window(ts, f"{gap_minutes} minutes")
    return df.filter(F.col(ts).isNotNull()).groupBy(key, window).agg(F.count("*").alias("size")).select(key, "size")


def size_stats(df: DataFrame, column: str, *quantiles: float) -> DataFrame:
    cuts = [stats.percentile(F.col(column), q).alias(f"p{round(100 * q)}_{column}") for q in quantiles]
    return df.agg(F.count("*").alias("n"), *cuts, F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias(f"max_{column}"))


def recovery_cycles(df: DataFrame, session: list[str], order: list[str], begins: Column, ends: Column) -> DataFrame:
    """(session..., turns): rows from the first beginning, outside a cycle, to the next end.

    Other rows count toward the distance, and a beginning inside a cycle does not restart it.
    """
    walk = Window.partitionBy(*session).orderBy(*order)
    marked = df.withColumn("_i", F.row_number().over(walk)).withColumn("_c", F.when(begins, "b").when(ends, "e")).filter("_c is not null")
    marked = marked.withColumn("_p", F.lag("_c").over(walk))
    start = F.when((F.col("_c") == "b") & (F.col("_p").isNull() | (F.col("_p") == "e")), F.col("_i"))
    begun = marked.withColumn("_s", F.last(start, ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    return begun.filter("_c = 'e' and _p = 'b'").select(*session, (F.col("_i") - F.col("_s")).cast("bigint").alias("turns"))


def vocabulary_drift(df: DataFrame, order: str, k: int = 25, least: int = 4, column: str = "text") -> DataFrame:
    """(direction, word): words among the k most frequent of the last quarter and not of the first ('rising'), and the reverse ('falling').

    Quarters hold max(1, n // 4) rows each and overlap in tiny tables; ties go by word.
    """
    n = df.count()
    size = max(1, n // 4)
    if not n:
        return df.sparkSession.createDataFrame([], "direction string, word string")
    at, mark = F.col(order), F.xxhash64(column)

    def border(rank: int, first: bool) -> Column:
        """Rows up to this rank, or from it on; rows that share the border's key are told apart by the hash of their text."""
        key, before, same = key_at(df.select(order), order, rank, rows=n)
        inside = at < F.lit(key) if first else at > F.lit(key)
        if before + (same if first else 1) == rank:
            return inside | (at == F.lit(key))
        split = key_at(df.filter(at == F.lit(key)).select(mark.alias("_h")), "_h", rank - before, rows=same)[0]
        return inside | ((at == F.lit(key)) & (mark <= F.lit(split) if first else mark >= F.lit(split)))

    early, late = border(size, True), border(n - size + 1, False)
    words = F.filter(text.tokens(F.col(column)), lambda w: F.length(w) >= least)
    each = df.filter(early | late).select(early.cast("int").alias("e"), late.cast("int").alias("l"), F.explode(words).alias("word"))
    counted = each.groupBy("word").agg(F.sum("e").alias("early"), F.sum("l").alias("late")).persist()
    try:
        top = {s: [r.word for r in counted.filter(F.col(s) > 0).orderBy(F.desc(s), "word").limit(k).collect()] for s in ("early", "late")}
    finally:
        counted.unpersist()
    rows = [("rising", w) for w in top["late"] if w not in top["early"]] + [("falling", w) for w in top["early"] if w not in top["late"]]
    return df.sparkSession.createDataFrame(rows, "direction string, word string")
