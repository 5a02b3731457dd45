"""Numeric band join: pairs of numbers that lie near each other, by absolute or by relative distance.

Values of the absolute band share a linear bucket, those of the relative band a
logarithmic one; a bucket is twice as wide as its band, so the left value is sent to the
one or two buckets that its band touches and the right value to its own. Both are
equi-joins. Exact integer checks follow, and the relative branch keeps only pairs outside
the absolute band, so no pair comes twice.

Nearest lines for items are found on distinct prices: lines are counted by unit price
before they meet an item, so rows of one price, item or sale meet once.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.llm import shared

#: A gap of at most ABSOLUTE, or DENOMINATOR * gap <= NUMERATOR * the smaller value.
ABSOLUTE, NUMERATOR, DENOMINATOR = 50, 5, 1000
K = 10
#: Largest value in cents: doubles and products with DENOMINATOR stay exact below it.
LARGEST = 1 << 52
#: Logarithms are wrong by less than this.
SLACK = 1e-9
#: Most unit prices with one item ahead that are broadcast, 3 MB; of more, all lines are ranked by item first.
DOMINATED = 100_000


def in_band(x: Column, y: Column, absolute: int = ABSOLUTE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> Column:
    gap = F.abs(x - y)
    return (gap <= absolute) | (denominator * gap <= numerator * F.least(x, y))


def band_join(left: DataFrame, right: DataFrame, x: str, y: str, absolute: int = ABSOLUTE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(left, right, gap): structs of the two rows of every pair whose integers x and y lie in the band.

    Nulls pair with nothing; repeated rows pair each time. Values beyond LARGEST raise.
    """

    def numbers(df: DataFrame, column: str, name: str) -> DataFrame:
        v = F.col(f"`{column}`").cast("long")
        v = F.when(F.abs(v) <= LARGEST, v).when(v.isNotNull(), F.raise_error(F.lit(f"{column} holds a value beyond {LARGEST}")).cast("long"))
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), v.alias(f"v_{name}")).where(F.col(f"v_{name}").isNotNull())

    a, b = numbers(left, x, "left"), numbers(right, y, "right")
    u, v = F.col("v_left"), F.col("v_right")
    gap = F.abs(u - v)
    width = 2 * absolute + 1
    linear = lambda c: F.floor(c / F.lit(float(width)))
    near = a.withColumn("bucket", F.explode(F.sequence(linear(u - absolute), linear(u + absolute))))
    near = near.join(b.withColumn("bucket", linear(v)).hint("merge"), "bucket").where(gap <= absolute)

    reach = log((denominator + numerator) / denominator) + SLACK
    step = lambda c: F.floor(c / F.lit(2 * reach))
    # the relative band is the wider one only from here on
    least = absolute * denominator // numerator
    far = a.where(u > least).withColumn("bucket", F.explode(F.sequence(step(F.ln(u) - reach), step(F.ln(u) + reach))))
    far = far.join(b.where(v > least).withColumn("bucket", step(F.ln(v))).hint("merge"), "bucket")
    far = far.where((denominator * gap <= numerator * F.least(u, v)) & (gap > absolute))
    return near.unionByName(far).select("left", "right", gap.alias("gap"))


def cents(amount: Column) -> Column:
    """floor(100 x + 0.5) in doubles; null where that isn't finite or beyond LARGEST."""
    x = 100 * amount.cast("double") + 0.5
    return F.when(F.abs(x) <= LARGEST, F.floor(x))


def unit_price(amount: Column, quantity: Column) -> Column:
    """Cents of one piece, rounded half up in integers; null for a quantity of 0."""
    q = quantity.cast("long")
    top, size = F.when(q < 0, -(2 * amount + q)).otherwise(2 * amount + q), F.when(q != 0, F.abs(2 * q))
    return F.call_function("div", top - F.pmod(top, size), size)


def _most(lines: Column) -> Column:
    """(n, item): the item with the most of an array of lines, and their number."""
    return F.array_max(F.transform(F.array_distinct(F.transform(lines, lambda x: x["item"])), lambda i: F.struct(F.size(F.filter(lines, lambda x: x["item"] == i)).alias("n"), i.alias("item"))))


def first_lines(lines: DataFrame, k: int = K, dominated: int = DOMINATED) -> DataFrame:
    """(u, lines, most): for each unit price lines that hold the first k of it without any one item's, whichever that is.

    The first 2 k lines do, unless more than k of them are of one item. For these prices the
    first k lines of other items are added. Spark limits the lines of each price in every task before
    they meet, so a price with very many lines costs no more than others.
    """
    key = [F.col("sale"), F.col("line_no").asc_nulls_last(), F.col("item")]

    def first(df: DataFrame, n: int, *by: str) -> DataFrame:
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*key))).where(F.col("nth") <= n).drop("nth")

    def grouped(df: DataFrame) -> DataFrame:
        line = F.struct("sale", F.col("line_no").isNull().alias("unnumbered"), "line_no", "item")
        return df.groupBy("u").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # 2 k at most

    rows = lines.select("u", "sale", "line_no", "item")
    found = shared.written(grouped(first(rows, 2 * k, "u")).withColumn("most", _most(F.col("lines"))), "first_lines", few=True)
    ahead = found.where(F.col("most.n") > k).select("u", F.col("most.item").alias("ahead"))
    n = ahead.count()
    if not n:
        return found
    if n > dominated:
        return grouped(first(first(rows, k, "u", "item"), 2 * k, "u")).withColumn("most", _most(F.col("lines")))
    more = grouped(first(rows.join(F.broadcast(ahead), "u").where("item <> ahead").drop("ahead"), k, "u")).withColumnRenamed("lines", "others")
    # the lines of other items that are among the first 2 k are the first of the others
    new = F.when(F.col("others").isNotNull(), F.slice("others", F.size("lines") - F.col("most.n") + 1, F.lit(k)))
    both = F.concat("lines", F.coalesce(new, F.slice("lines", 1, 0)))
    return found.join(more, "u", "left").select("u", both.alias("lines")).withColumn("most", _most(F.col("lines")))


def near_lines(items: DataFrame, lines: DataFrame, k: int = K, absolute: int = ABSOLUTE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """For every item its k nearest lines of other items by unit price, and sums over all of its pairs.

    items: item_id, price; lines: sale_id, line_no, item_id, quantity, amount; other columns
    are ignored. Returns item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs,
    gap_sum, lines_crc. Lines null in sale_id, item_id, quantity or amount, with a quantity
    of 0 or an amount that is not finite never pair, nor do items without id or price. An
    item without pairs has one row of rank 0. Repeated lines count each, and so do repeated
    items. A null line_no comes last and is empty in the checksum.
    """
    a = cents(F.col("amount"))
    sold = lines.select(F.col("item_id").cast("long").alias("item"), F.col("sale_id").cast("long").alias("sale"), F.col("line_no").cast("long").alias("line_no"), unit_price(a, F.col("quantity")).alias("u"))
    sold = sold.where("item is not null and sale is not null and u is not null")
    text = F.concat(F.col("sale").cast("string"), F.lit(","), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.lit(","), F.col("item").cast("string"))
    sold = shared.written(sold.withColumn("crc", F.crc32(text.cast("binary"))), "sold")  # read three times
    counted = sold.select("u", "item", "crc")
    units = counted.groupBy("u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))

    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p"))
    prices = wanted.where("item_id is not null and p is not null").select("p").distinct()
    tops = shared.written(first_lines(sold, k), "tops", few=True)
    # of each unit price: lines that are there whichever item's are left out
    right = shared.written(units.join(tops.select("u", (F.size("lines") - F.col("most.n")).alias("safe")), "u"), "units", few=True)
    pairs = band_join(prices, right, "p", "u", absolute, numerator, denominator)
    pairs = pairs.select("left.p", "right.*", "gap")
    whole = Window.partitionBy("p")
    before = whole.orderBy("gap", "u").rowsBetween(Window.unboundedPreceding, -1)
    totals = {"n_pairs": F.sum("n"), "gap_sum": F.sum(F.col("n") * F.col("gap")), "lines_crc": F.sum("crc")}
    near = pairs.select("p", "u", "gap", *[v.over(whole).alias(c) for c, v in totals.items()], F.coalesce(F.sum("safe").over(before), F.lit(0)).alias("before")).where(F.col("before") < k)
    listed = F.transform("lines", lambda x: F.struct(F.col("gap").alias("gap"), F.col("u").alias("u"), x["sale"].alias("sale_id"), x["unnumbered"].alias("unnumbered"), x["line_no"].alias("line_no"), x["item"].alias("line_item_id")))
    near = near.join(tops.select("u", "lines"), "u").select("p", *totals, listed.alias("lines"))
    near = near.groupBy("p").agg(*[F.first(c).alias(c) for c in totals], F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
    near = shared.written(near, "near", few=True)  # so that Spark can split a price that very many items have

    # an item's own lines are no pairs of it
    own = counted.withColumnRenamed("item", "item_id").join(wanted.where("p is not null").distinct().hint("shuffle_hash"), "item_id").where(in_band(F.col("p"), F.col("u"), absolute, numerator, denominator))
    item = F.struct("item_id", "p").alias("item")
    own = own.groupBy(item).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("p") - F.col("u"))).alias("gap"), F.sum("crc").alias("crc"))
    rows = wanted.withColumn("item", F.struct("item_id", "p")).join(own, "item", "left").join(near, "p", "left")
    less = lambda c, o: F.when(F.col("item_id").isNotNull(), F.coalesce(c, F.lit(0)) - F.coalesce(o, F.lit(0))).otherwise(F.lit(0)).cast("long")
    others = F.slice(F.filter("lines", lambda x: x["line_item_id"] != F.col("item_id")), 1, k)
    rows = rows.select("item_id", others.alias("found"), less("n_pairs", F.col("n")).alias("n_pairs"), less("gap_sum", F.col("gap")).alias("gap_sum"), less("lines_crc", F.col("crc")).alias("lines_crc"))
    rows = rows.select("*", F.posexplode_outer("found").alias("at", "x"))
    return rows.select(
        "item_id", F.coalesce(F.col("at") + 1, F.lit(0)).alias("rank"), *[F.col(f"x.{c}").cast("long").alias(c) for c in ("gap", "u", "sale_id", "line_no", "line_item_id")], *totals,
    )
