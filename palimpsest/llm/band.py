"""Numeric band join: pairs of rows whose integers are near, by an absolute or a relative measure.

Two values are near when they differ by at most ``absolute``, or by at most
``parts`` of ``out_of`` of the greater one. Two equi-joins find the pairs:

1. Absolute: values fall into buckets as wide as the band. A left row asks for the buckets that its band touches, three at most.
2. Relative: values fall into buckets of equal width in the logarithm. Only
   values large enough for a pair outside the absolute band take part, and only such pairs are kept, so no pair comes twice.

Each pair passes the exact check in integers. The right side has one bucket for
each row, so a pair is met once. ``on`` names further columns that must agree.

``match_prices`` asks, for each item, for its nearest lines and for sums over
all of its near lines. Lines of one unit price are one class, items of one
price another; only classes are joined, so the pairs made are those of different
values, however many rows have them. A line of the item itself never counts:
its share is summed up by a second band join on item and bucket, and taken off.
An item's first k pairs come from the nearest classes. A class is full when k
lines are left whatever item is left out; of a class, 2k lines with at most k
of any one item are enough. What lies beyond the nearest full class is never
needed, so only that class and the classes before it that are not full are
opened. All groups are pre-aggregated where the rows are; nothing is broadcast
or collected. The jobs that write the classes run while the result is built.

Cases: lines with a null in sale_id, item_id, quantity or amount, with a
quantity below 1 or an amount that is not finite never pair; nor do items with a
null item_id or a null or not finite price, which get a row of rank 0, as do all
items without pairs. A null line_no comes first and is empty in the checksum's
text. Repeated lines count and take ranks one by one; repeated items each get
their rows. Values are cents of less than 9e15. Other columns are ignored. Empty
tables: no items, no rows; no lines, rank 0 for all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import shared

#: Buckets of the logarithm for each width of the relative band.
FINE = 4
#: Added to each end of a band in the logarithm; far above the rounding of doubles, and decided by the exact check.
SLACK = 1e-9
LARGEST = 9e15


def near_pairs(left: DataFrame, right: DataFrame, x: str, y: str, absolute: int, parts: int, out_of: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of left and right with near integers x and y: all columns of both (``on`` once) and ``gap``, the difference.

    Column names of the two sides must differ but for ``on``. Nulls are near nothing.
    """
    bucket = shared.unused("_bucket", left.select("*", *[F.lit(0).alias(c) for c in right.columns if c not in on]))
    a, b = F.col(x).cast("long"), F.col(y).cast("long")
    width = max(1, absolute)
    gap = F.abs(a - b)
    by_line = left.withColumn(bucket, F.explode(F.sequence(bucket_of(a - absolute, width), bucket_of(a + absolute, width))))
    near = by_line.join(right.withColumn(bucket, bucket_of(b, width)), [*on, bucket]).where(gap <= absolute)
    # Only above this can a pair be within the relative band and outside the absolute one.
    large = lambda v: v * parts > F.lit(absolute) * (out_of - parts)
    reach = -math.log1p(-parts / out_of)
    step = reach / FINE
    at = lambda v, d: F.floor((F.log(v.cast("double")) + d) / step)
    by_size = left.where(large(a)).withColumn(bucket, F.explode(F.sequence(at(a, -reach - SLACK), at(a, reach + SLACK))))
    far = by_size.join(right.where(large(b)).withColumn(bucket, at(b, 0.0)), [*on, bucket]).where((gap > absolute) & (gap * out_of <= F.greatest(a, b) * parts))
    return near.unionByName(far).drop(bucket).withColumn("gap", gap)


def bucket_of(v: Column, width: int) -> Column:
    """The integer v over width, rounded down."""
    return F.floor((v - F.pmod(v, F.lit(width))) / width)


def cents(value: Column) -> Column:
    """Null where the value is null or not finite."""
    scaled = F.floor(F.lit(100.0) * value + 0.5)
    return F.when((F.abs(value) * 100 < LARGEST), scaled)


def units(lines: DataFrame) -> DataFrame:
    """The lines that can pair: line_item_id, sale_id, line_no, u, crc."""
    a, q = cents(F.col("amount")), F.col("quantity").cast("long")
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    rows = lines.where("sale_id is not null and item_id is not null and quantity >= 1").select(F.col("item_id").cast("long").alias("line_item_id"), F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), a.alias("a"), q.alias("q"), F.crc32(text.cast("binary")).alias("crc"))
    u = F.expr("(2 * a + q - pmod(2 * a + q, 2 * q)) div (2 * q)")
    return rows.where("a is not null").select("line_item_id", "sale_id", "line_no", u.alias("u"), "crc")


def match_prices(items: DataFrame, lines: DataFrame, k: int = 2, absolute: int = 100, parts: int = 1, out_of: int = 1000) -> DataFrame:
    """items(item_id, price), lines(sale_id, line_no, item_id, quantity, amount): for each item its first k pairs, ranked
    from 1 by gap, u, sale_id, line_no, line_item_id, and n_pairs, gap_sum and lines_crc over all of its pairs."""
    rows = units(lines)
    of_item = shared.keep(rows.groupBy("u", "line_item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc")), "band-items")
    order = ["sale_id", "line_no", "line_item_id"]
    top = lambda df, keys, by, n: df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("_r") <= n).drop("_r")
    first = top(top(rows.drop("crc"), ["u", "line_item_id"], order, k), ["u"], order, 2 * k)
    first = first.groupBy("u").agg(F.collect_list(F.struct(*order)).alias("lines"))
    full = (F.size("lines") >= k) & F.forall("lines", lambda e: F.size(F.filter("lines", lambda f: f["line_item_id"] != e["line_item_id"])) >= k)
    classes = of_item.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).join(first, "u").withColumn("full", full)
    classes = shared.keep(classes, "band-classes")

    priced = items.select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p")).groupBy("item_id", "p").agg(F.count(F.lit(1)).alias("copies"))
    priced = shared.keep(priced, "band-prices")
    able = priced.where("item_id is not null and p is not null")
    near = lambda a, b, **on: near_pairs(a, b, "p", "u", absolute, parts, out_of, **on)
    # Orders the classes of a price by gap, then u: the lower of two of one gap is even, the higher one odd.
    place = F.col("gap") * 2 + (F.col("u") > F.col("p")).cast("int")
    sums = near(able.select("p").distinct(), classes.drop("lines")).groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gap")).alias("gap_sum"), F.sum("crc").alias("crc"), F.min(F.when(F.col("full"), place)).alias("stop"))
    sums = shared.keep(sums, "band-sums")
    at_stop = sums.where("stop is not null").selectExpr("p", "stop div 2 as gap", "if(stop % 2 = 1, p + stop div 2, p - stop div 2) as u").join(classes.select("u", "lines"), "u")
    before = near(sums.select("p", "stop"), classes.where("not full").select("u", "lines")).where(F.col("stop").isNull() | (place < F.col("stop")))
    opened = at_stop.select("p", "gap", "u", "lines").unionByName(before.select("p", "gap", "u", "lines")).select("p", "gap", "u", F.inline("lines"))
    by = ["gap", "u", *order]
    firsts = top(top(opened, ["p", "line_item_id"], by, k), ["p"], by, 2 * k).groupBy("p").agg(F.array_sort(F.collect_list(F.struct(*by))).alias("pairs"))
    prices = shared.keep(sums.drop("stop").join(firsts, "p"), "band-pairs")

    own = near(able.withColumnRenamed("item_id", "line_item_id"), of_item, on=("line_item_id",)).groupBy("line_item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * F.col("gap")).alias("own_gap"), F.sum("crc").alias("own_crc")).withColumnRenamed("line_item_id", "item_id")
    less = lambda c, o: F.when(F.col("item_id").isNull(), 0).otherwise(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(o), F.lit(0))).cast("long")
    pairs = F.slice(F.filter("pairs", lambda e: e["line_item_id"] != F.col("item_id")), 1, k)
    out = priced.join(prices, "p", "left").join(own, ["item_id", "p"], "left").select("item_id", "copies", less("n", "own_n").alias("n_pairs"), less("gap_sum", "own_gap").alias("gap_sum"), less("crc", "own_crc").alias("lines_crc"), pairs.alias("pairs"))
    out = out.where("copies = 1").drop("copies").unionByName(out.where("copies > 1").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies"))
    each = out.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("pairs").alias("_at", "_pair"))
    return each.select("item_id", F.coalesce(F.col("_at") + 1, F.lit(0)).cast("int").alias("rank"), *[F.col(f"_pair.{c}").alias(c) for c in by], "n_pairs", "gap_sum", "lines_crc")


def op13_band(spark, sf_dir: str) -> DataFrame:
    return match_prices(shared.table(spark, sf_dir, "items"), shared.table(spark, sf_dir, "sale_lines"))


ORACLE = """
WITH l AS (
  SELECT sale_id, line_no::BIGINT AS line_no, item_id AS line_item_id, (2 * floor(100 * amount + 0.5)::BIGINT + quantity) // (2 * quantity) AS u, concat(sale_id, ',', line_no, ',', item_id) AS t
  FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity >= 1 AND amount IS NOT NULL
), c AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(t, ''), lambda x: ascii(x)::BIGINT)), lambda h, b:
    list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc FROM l
), i AS (SELECT item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items), j AS (
  SELECT i.item_id, c.*, abs(u - p) AS gap FROM i JOIN c ON c.line_item_id <> i.item_id AND (abs(u - p) <= 100 OR 1000 * abs(u - p) <= greatest(u, p))
), s AS (SELECT item_id, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM j GROUP BY item_id), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY gap, u, sale_id, line_no, line_item_id) AS rank, gap, u, sale_id, line_no, line_item_id FROM j QUALIFY rank <= 2
)
SELECT i.item_id, coalesce(r.rank, 0)::INT AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN s USING (item_id) LEFT JOIN r USING (item_id)
"""
