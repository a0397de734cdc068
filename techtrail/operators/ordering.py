"""Numbering rows in order, carrying values along an order, and exact quantiles, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from techtrail.sources.shared import new_path

PART, PLACE, GROUP = "part of order", "place in order", "group of order"


def _placed(df: DataFrame, order: list) -> DataFrame:
    """The table, sorted by range, with PART, the number of a row's range, and PLACE, which grows along the order: written, so that the places are read, not made again. It is written when this is called."""
    path = new_path(df.sparkSession, "ordered")
    df.orderBy(*order).withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path).withColumn(PART, F.shiftright(PLACE, 33))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds name: 0, 1, ... in an order without ties. No task sees more than its share of the rows.

    The sizes of the sorted table's ranges, a row for each, give the numbers at which they begin. The table is sorted and written when this is called.
    """
    placed = _placed(df, order)
    sizes = placed.groupBy(PART).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.broadcast(sizes.select(PART, before.alias("begin")))  # a row for each range of the sort
    number = F.col("begin") + F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(begins, PART).withColumn(name, number).drop("begin", PART, PLACE)


def _by_range(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with GROUP, its keys as one value, in which nulls are equal, sorted by range of keys and order."""
    return _placed(df.withColumn(GROUP, F.struct(*keys)), [*keys, *order])


def number_within(df: DataFrame, keys: list[str], order: list, place: str = "place", total: str = "total") -> DataFrame:
    """Adds place, 1, 2, ... in an order without ties within the keys, and total, the number of the keys' rows.

    The table is sorted by range, so a key with very many rows has several ranges. Each range counts its rows of each key; the counts of a key's ranges, one row each, say at which number it begins in a range. The table is
    sorted and written when this is called.
    """
    placed = _by_range(df, keys, order)
    cells = placed.groupBy(GROUP, PART).agg(F.count("*").alias("size"), F.min(PLACE).alias("first"))
    own = Window.partitionBy(GROUP)
    before = F.coalesce(F.sum("size").over(own.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(GROUP, PART, (before - F.col("first") + 1).alias("shift of order"), F.sum("size").over(own).alias(total))
    return placed.join(cells, [GROUP, PART]).withColumn(place, F.col(PLACE) + F.col("shift of order")).drop(GROUP, PART, PLACE, "shift of order")


def carry_last(df: DataFrame, keys: list[str], order: list, value: Column, name: str, itself: bool = True) -> DataFrame:
    """Adds name: the last value that is not null among the keys' rows up to each row (itself: this row's own too) in an order without ties.

    As in number_within a key may have several ranges: each range gives its last value, the last one of a key's earlier ranges is carried into the next, and a row looks back within its range alone. The table is
    sorted and written when this is called.
    """
    placed = _by_range(df.withColumn("value of order", value), keys, order)
    held = F.col("value of order")
    cells = placed.groupBy(GROUP, PART).agg(F.max(F.when(held.isNotNull(), F.struct(F.col(PLACE).alias("at"), held.alias("value")))).alias("last"))
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(GROUP, PART, F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy(GROUP, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    seen = placed.withColumn("seen in range", F.last(held, ignorenulls=True).over(inside)).join(cells, [GROUP, PART])
    return seen.withColumn(name, F.coalesce("seen in range", "carried.value")).drop(GROUP, PART, PLACE, "value of order", "seen in range", "carried")


#: Bins of a quantile's first count to each factor of e; what is in one bin is within 1/4096 of each other.
BINS = 4096

#: Numbers of the bins of infinity and of what is not a number, beyond those of all other values.
INFINITE, NOT_A_NUMBER = 1 << 40, 1 << 41


def _bin(value: Column) -> Column:
    """A whole number that never falls where the value grows: the logarithm in steps, with the sign."""
    size = F.abs(value)
    step = F.floor(F.log(size) * BINS) + 1000 * BINS  # the least value's logarithm is above -1000
    known = F.when(value == 0, 0).when(size == float("inf"), F.signum(value).cast("long") * INFINITE).otherwise(F.signum(value).cast("long") * step)
    return F.when(F.isnan(value), NOT_A_NUMBER).otherwise(known).cast("long")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name in shares, the exact quantile of value at that share (linear interpolation); nulls are left out, what is not a number is greatest.

    Two counts, of whatever size the table is: values by bins that keep their order say which bins hold the ranks that are asked for, and of these bins the values
    themselves are counted. Both add up within tasks before they move anything, so neither a large group nor a value that a third of all rows have is one task's work; a task sees the different
    values of one bin of a group at most.
    """
    group = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    known = df.where(F.col(value).isNotNull()).select(group.alias("group"), F.col(value).cast("double").alias("value")).withColumn("bin", _bin(F.col("value")))
    within = lambda *by: Window.partitionBy(*by)
    running = lambda by, order: F.sum("n").over(within(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    here = lambda: F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    bins = known.groupBy("group", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("total", F.sum("n").over(within("group"))).withColumn("upto", running(["group"], "bin"))
    at = {name: (F.col("total") - 1) * share for name, share in shares.items()}
    bins = bins.withColumn("ranks", F.array_distinct(F.array(*(end(x).cast("long") for x in at.values() for end in (F.floor, F.ceil)))))
    asked = bins.withColumn("ranks", here()).where(F.size("ranks") > 0).select("group", "bin", "total", "ranks", (F.col("upto") - F.col("n")).alias("before"))
    counted = known.join(asked, ["group", "bin"]).groupBy("group", "bin", "value").agg(F.count("*").alias("n"), F.any_value("total").alias("total"), F.any_value("ranks").alias("ranks"), F.any_value("before").alias("before"))
    ranked = counted.withColumn("upto", F.col("before") + running(["group", "bin"], "value"))
    held = ranked.select("group", "total", F.explode(here()).alias("rank"), "value")
    found = held.groupBy("group").agg(F.any_value("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))  # two ranks for each share
    made = []
    for name, x in at.items():
        low, high = F.col("of")[F.floor(x).cast("long")], F.col("of")[F.ceil(x).cast("long")]
        made.append(F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name))
    return found.select(*(F.col(f"group.{k}").alias(k) for k in keys), *made)
