"""Candidates of a set-similarity join by prefix filter.

All tokens have one global order, rare ones first. Two sets of n and m tokens that share o or
more also share one among the first n - o + 1 of the one and the first m - o + 1 of the other,
so only those are joined. Any order that both sides use is right; this one follows counts of
hash classes, whose number is fixed, so the table that is broadcast has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that tokens are counted in.
CLASSES = 1 << 16


def _class_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(CLASSES)).cast("int")


def _ordered(sets: DataFrame, key: str, tokens: str, counts: DataFrame) -> DataFrame:
    """(key, tokens): the tokens of each set, those of rare classes first."""
    each = sets.select(key, F.explode(tokens).alias("_token")).withColumn("_class", _class_of(F.col("_token")))
    ranked = each.join(F.broadcast(counts), "_class", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_token"))).alias("_o"))
    return ranked.select(key, F.transform("_o", lambda x: x["_token"]).alias(tokens))


def candidates(left: DataFrame, right: DataFrame, need: Column, least: int) -> DataFrame:
    """Distinct (_a, _b) of sets in left (_a, _ta) and right (_b, _tb) that may share `need` tokens, an expression over left's, `least` or more.

    Beside the first tokens, sizes count, and positions: what both sets hold from a shared
    token on must still reach the need.
    """
    both = left.select(F.explode("_ta").alias("_token")).unionAll(right.select(F.explode("_tb").alias("_token")))
    counts = both.groupBy(_class_of(F.col("_token")).alias("_class")).agg(F.count("*").alias("_n"))
    one = _ordered(left, "_a", "_ta", counts).withColumn("_need", need.cast("int")).withColumn("_na", F.size("_ta"))
    one = one.filter(F.col("_need") <= F.col("_na")).select("_a", "_na", "_need", F.posexplode(F.slice("_ta", F.lit(1), F.col("_na") - F.col("_need") + 1)).alias("_i", "_token"))
    other = _ordered(right, "_b", "_tb", counts).withColumn("_nb", F.size("_tb"))
    other = other.select("_b", "_nb", F.posexplode(F.slice("_tb", F.lit(1), F.col("_nb") - F.lit(least) + 1)).alias("_j", "_token"))
    rest = F.least(F.col("_na") - F.col("_i"), F.col("_nb") - F.col("_j"))
    return one.join(other, "_token").filter((F.col("_j") <= F.col("_nb") - F.col("_need")) & (rest >= F.col("_need"))).select("_a", "_b").distinct()
