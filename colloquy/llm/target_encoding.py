"""Target encoding in order of time: how often earlier lines of the same item, vendor and client came back.

Lines become events of several levels: all history, kind, nation, segment, item, vendor and
client. The events of all levels are range-partitioned and sorted together by level, key,
time and id, so a key that a third of all rows have, and the one key of the level `all`, are
cut into as many partitions as any other rows. Each partition takes segmented running sums
by fold (numpy) and leaves one row about its edges; the driver turns these rows, one for each
partition, into what each partition's first key carries over from those before it, and a
second pass adds that. Equal times may lie on both sides of an edge: what a row counts ends
where its time begins, so the edges hold the sums up to their last time as well.

Defined cases: null item_id and client_id are the id -1; a null vendor_id, and a null or
unknown kind, nation or segment, are one value each. Lines without a sale, or with one that
has no sold_at, are dropped. Of rows of a dimension that share an id the one with the least
value counts, and of sales with one sale_id that with the least sold_at and client_id. A null
flag is not `returned`. Columns beside those that are named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoding_kernel
from .common import settle, ship
from .encoding_kernel import FOLDS, SCANNED, carried, scan

ship(encoding_kernel)

#: Weight of the prior in a rate, and the prior of all history, in millionths.
WEIGHT, PRIOR = 50, 500_000

LEVELS = ("all", "segment", "client", "kind", "nation", "item", "vendor")

def history(events: DataFrame, parts: int | None = None) -> DataFrame:
    """(level, id, n, s): for each event the counts n and s of events of its level, key and name, of other folds, at lesser times.

    events: (level int, key bigint, name string, at bigint, fold int, id bigint, n bigint, s
    bigint), none null, ids distinct within level, key and name. What reaches the driver and is broadcast is
    a row or ten for each of `parts` partitions (spark.sql.shuffle.partitions unless given).
    """
    spark = events.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("level", "key", "name", "at", "id")
    dealt = events.select(*order, "fold", "n", "s").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept, _ = settle(dealt.mapInPandas(scan, SCANNED), "encoded")
    edges = kept.filter("edge is not null").select("edge.*").collect()
    carries = F.broadcast(spark.createDataFrame(carried(edges), "part int, zone int, fold int, more_n bigint, more_s bigint"))
    rows = kept.filter("edge is null").drop("edge").join(carries, ["part", "zone", "fold"], "left")
    add = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    return rows.select("level", "id", add("n"), add("s"))


def _value(level: str, key: Column | None = None, name: Column | None = None) -> list[Column]:
    """(level, key, name) of an event; a null value is one of its own."""
    null = (key if key is not None else name).isNull() if level != "all" else F.lit(False)
    own_name = name if name is not None else F.lit("")
    return [
        F.lit(LEVELS.index(level)).alias("level"),
        (F.when(null, 1).otherwise(0) if key is None else F.coalesce(key, F.lit(0))).cast("bigint").alias("key"),
        F.when(null, "?" if key is not None else "").otherwise(own_name).alias("name"),
    ]


def _micros(stamp: str) -> Column:
    """Microseconds of a time without a zone, from its own fields: hours that a zone's clock skips or repeats stay as they are."""
    at = F.col(stamp)
    day = F.date_diff(F.to_date(at), F.lit("1970-01-01")).cast("bigint")
    return ((day * 24 + F.hour(at)) * 60 + F.minute(at)) * 60_000_000 + (F.expr(f"extract(SECOND FROM {stamp})") * 1_000_000).cast("bigint")


def _events(df: DataFrame, ident: str, *values: list[Column]) -> DataFrame:
    one = F.explode(F.array(*[F.struct(*v) for v in values])).alias("_v")
    return df.select(one, F.col(ident).alias("id"), "at", "fold", "n", "s").select("_v.*", "id", "at", "fold", "n", "s")


def _dimension(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key; written out, as Spark splits a skewed join only where both sides are dealt out for it."""
    return settle(table.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias(key)).agg(F.min(value).alias(value)), key)[0]


def rate(n: Column, s: Column, prior: Column) -> Column:
    """Share of s in n in millionths, drawn towards the prior; the prior itself where nothing is known."""
    drawn = F.call_function("div", F.lit(1_000_000) * s + F.lit(WEIGHT) * prior, n + F.lit(WEIGHT))
    return F.when(n < 1, prior).otherwise(drawn)


def groups(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """(sale_id, item_id, vendor_id, client_id, segment, kind, nation, at, fold, n, s): equal lines of a sale together.

    Lines are aggregated before anything is joined to them; what is left of a hot sale, item
    or vendor is split by Spark's own handling of skewed joins.
    """
    count, back = F.count("*").alias("n"), F.count_if(F.col("flag") == "returned").alias("s")
    own = lines.filter("sale_id is not null").groupBy("sale_id", F.coalesce("item_id", F.lit(-1)).cast("bigint").alias("item_id"), F.col("vendor_id").cast("bigint").alias("vendor_id")).agg(count, back)
    fold = (F.crc32(F.col("sale_id").cast("string")) % FOLDS).cast("int").alias("fold")
    sold = sales.filter("sold_at is not null and sale_id is not null").groupBy("sale_id").agg(F.min(F.struct("sold_at", F.coalesce("client_id", F.lit(-1)).cast("bigint").alias("client_id"))).alias("_s"))
    micros = _micros("_s.sold_at").alias("at")
    sold, _ = settle(sold.select("sale_id", F.col("_s.client_id").alias("client_id"), micros, fold).join(_dimension(clients, "client_id", "segment"), "client_id", "left"), "sold")
    named = own.join(sold, "sale_id").join(_dimension(items, "item_id", "kind"), "item_id", "left").join(_dimension(vendors, "vendor_id", "nation_id"), "vendor_id", "left")
    return named.withColumnRenamed("nation_id", "nation")


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, parts: int | None = None) -> DataFrame:
    """(sale_id, item_id, vendor_id, n_lines, n_returned, item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate)."""
    kept, _ = settle(groups(lines, sales, items, vendors, clients).withColumn("id", F.monotonically_increasing_id()), "sale-groups")
    whole = kept.groupBy("sale_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *[F.any_value(c).alias(c) for c in ("client_id", "segment", "at", "fold")])
    events = _events(
        kept, "id",
        _value("kind", name=F.col("kind")), _value("nation", key=F.col("nation")), _value("item", key=F.col("item_id")), _value("vendor", key=F.col("vendor_id")),
    ).unionByName(_events(whole, "sale_id", _value("all"), _value("segment", name=F.col("segment")), _value("client", key=F.col("client_id"))))
    known = history(events, parts)
    at = {name: i for i, name in enumerate(LEVELS)}

    def spread(rows: DataFrame, names: tuple[str, ...], *more: Column) -> DataFrame:
        """One row an id; dealt out first, so that only the short rows of `rows` are shuffled."""
        pick = [F.max(F.when(F.col("level") == at[x], F.col(c))).alias(f"{x}_{c}") for x in names for c in ("n", "s")]
        return rows.repartition("id").groupBy("id").agg(*pick, *more)

    by_sale = spread(known.filter(F.col("level") < at["kind"]), ("all", "segment", "client")).withColumnRenamed("id", "sale_id")
    by_sale, _ = settle(by_sale, "by-sale")
    own = kept.select(F.lit(-1).alias("level"), "id", "n", "s", "sale_id", "item_id", "vendor_id")
    rows = known.filter(F.col("level") >= at["kind"]).select("level", "id", "n", "s", *[F.lit(None).cast("bigint").alias(c) for c in ("sale_id", "item_id", "vendor_id")])
    mine = F.col("level") == -1
    more = [F.max(c).alias(c) for c in ("sale_id", "item_id", "vendor_id")] + [F.max(F.when(mine, F.col(c))).alias(o) for c, o in (("n", "n_lines"), ("s", "n_returned"))]
    joined = spread(own.unionByName(rows), ("kind", "nation", "item", "vendor"), *more).join(by_sale, "sale_id")
    shared = rate(F.col("all_n"), F.col("all_s"), F.lit(PRIOR).cast("bigint"))
    joined = joined.withColumn("_p", shared)
    between = lambda x: rate(F.col(f"{x}_n"), F.col(f"{x}_s"), F.col("_p"))
    final = lambda x, above: rate(F.col(f"{x}_n"), F.col(f"{x}_s"), between(above)).alias(f"{x}_rate")
    return joined.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", final("item", "kind"), "vendor_n", final("vendor", "nation"), "client_n", final("client", "segment"))


def query(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    return encode(lines, sales, items, vendors, clients)


#: The checksum's table of 256 values follows from its polynomial; windows end one microsecond before a line's own time.
SQL = f"""
WITH poly AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT sale_id, sold_at, coalesce(client_id, -1) AS client_id,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(sale_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 AS fold
        FROM sales, poly WHERE sold_at IS NOT NULL),
g AS (SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, any_value(c.client_id) AS client_id, any_value(c.sold_at) AS sold_at, any_value(c.fold) AS fold, count(*) AS n, count(*) FILTER (WHERE l.flag = 'returned') AS s
      FROM sale_lines l JOIN crc c ON l.sale_id = c.sale_id GROUP BY ALL),
d AS (SELECT g.*, i.kind, v.nation_id, k.segment FROM g LEFT JOIN items i ON g.item_id = i.item_id LEFT JOIN vendors v ON g.vendor_id = v.vendor_id LEFT JOIN clients k ON g.client_id = k.client_id),
e AS (SELECT sale_id, item_id, vendor_id, sold_at, fold, n, s, unnest([{{'level': 'all', 'key': ''}}, {{'level': 'kind', 'key': kind}}, {{'level': 'nation', 'key': nation_id::varchar}}, {{'level': 'segment', 'key': segment}},
             {{'level': 'item', 'key': item_id::varchar}}, {{'level': 'vendor', 'key': vendor_id::varchar}}, {{'level': 'client', 'key': client_id::varchar}}]) AS v FROM d),
h AS (SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned, v.level AS level,
      coalesce(sum(n) OVER w, 0) - coalesce(sum(n) OVER f, 0) AS n, coalesce(sum(s) OVER w, 0) - coalesce(sum(s) OVER f, 0) AS s FROM e
      WINDOW w AS (PARTITION BY v.level, v.key ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
             f AS (PARTITION BY v.level, v.key, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
p AS (SELECT sale_id, item_id, vendor_id, n_lines, n_returned,
      {", ".join(f"max({c}) FILTER (WHERE level = '{x}') AS {x}_{c}" for x in LEVELS for c in ("n", "s"))} FROM h GROUP BY ALL),
a AS (SELECT *, CASE WHEN all_n < 1 THEN {PRIOR} ELSE (1000000 * all_s + {WEIGHT * PRIOR}) // (all_n + {WEIGHT}) END AS p FROM p),
b AS (SELECT *, {", ".join(f"CASE WHEN {x}_n < 1 THEN p ELSE (1000000 * {x}_s + {WEIGHT} * p) // ({x}_n + {WEIGHT}) END AS {x}_p" for x in ("kind", "nation", "segment"))} FROM a)
SELECT sale_id, item_id, vendor_id, n_lines::bigint AS n_lines, n_returned::bigint AS n_returned,
       {", ".join(f"{x}_n::bigint AS {x}_n, (CASE WHEN {x}_n < 1 THEN {up}_p ELSE (1000000 * {x}_s + {WEIGHT} * {up}_p) // ({x}_n + {WEIGHT}) END)::bigint AS {x}_rate" for x, up in (("item", "kind"), ("vendor", "nation"), ("client", "segment")))}
FROM b"""
