"""Cutting ordered histories into slices, and choosing among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from techtrail.operators.ordering import number_within


def numbered(df: DataFrame, key: str, order: list) -> DataFrame:
    """Adds place (1, 2, ... in order within the key) and total. A key with very many rows is several tasks' work."""
    return number_within(df, [key], order)


def slice_every(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Every n-th row of each key's history, with part 1, 2, ...; a tail of fewer than n rows has no slice."""
    return numbered(df, key, order).where(F.col("place") % n == 0).withColumn("part", F.expr(f"place div {int(n)}")).drop("place", "total")


def slice_proportional(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """Every size-th row, where size is the history's length div k (at least 1; k = 0: every row). There may be more than k slices."""
    size = F.greatest(F.expr(f"total div {int(k)}"), F.lit(1)) if k else F.lit(1)
    rows = numbered(df, key, order).withColumn("size", size)
    return rows.where("place % size = 0").withColumn("part", F.expr("place div size")).drop("place", "total", "size")


def slice_interval(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.where(F.col("part").between(low, high))


def mark_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds is_last: the last row of the whole history, sliced or not."""
    return numbered(df, key, order).withColumn("is_last", F.col("place") == F.col("total")).drop("place", "total")


def presence(df: DataFrame, key: str, order: list, label: str, n: int) -> DataFrame:
    """key, part, label: labels that occur in each full slice of n rows."""
    rows = numbered(df, key, order).withColumn("part", F.expr(f"(place - 1) div {int(n)} + 1"))
    return rows.where(f"part <= total div {int(n)}").select(key, "part", label).distinct()


def upsert_versions(old: DataFrame, new: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """key, part, action: parts of old within low..high are reset, new parts win, versions known already are reused."""
    before = old.select(*key, F.when(~F.col("part").between(low, high), F.col("part")).alias("old_part"), F.lit(1).alias("in_old"))
    after = new.select(*key, F.col("part").alias("new_part"), F.lit(1).alias("in_new"))
    action = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "keep").otherwise("reuse")
    return before.join(after, key, "full_outer").select(*key, F.coalesce("new_part", "old_part").alias("part"), action.alias("action"))


def select_versions(df: DataFrame, mode: str) -> DataFrame:
    """all, last (is_last) or historical (a part is given)."""
    chosen: dict[str, Column] = {"all": F.lit(True), "last": F.col("is_last"), "historical": F.col("part").isNotNull()}
    return df.where(chosen[mode])


def too_few_slices(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with fewer than n slices, with their number and the list of parts as text."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_set("part")), lambda x: x.cast("string")), ",")
    return df.groupBy(key).agg(F.countDistinct("part").alias("n_slices"), parts.alias("parts")).where(F.col("n_slices") < n)


def pick_slice(df: DataFrame, key: str, which: str) -> DataFrame:
    """Rows of the first, middle or last slice of each key.

    The middle one of m slices in order is number max(m div 2, 1). First and last are a minimum and a maximum; only for the middle one are a key's different slices numbered.
    """
    if which == "middle":
        placed = number_within(df.select(key, "part").distinct(), [key], ["part"], "nth", "slices")
        chosen = placed.where(F.col("nth") == F.greatest(F.expr("slices div 2"), F.lit(1))).select(key, "part")
    else:
        chosen = df.groupBy(key).agg({"first": F.min, "last": F.max}[which]("part").alias("part"))
    return df.join(chosen, [key, "part"], "left_semi")


def parse_commit_ts(text: Column) -> Column:
    """Time in UTC of "Tue, 3 May 2022 10:00:00 +0200" or "Tue May 3 10:00:00 2022 +0200"."""
    mail = F.try_to_timestamp(F.regexp_replace(text, r"^\w+,\s+", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    log = F.try_to_timestamp(F.regexp_replace(text, r"^\w+\s+", ""), F.lit("MMM d HH:mm:ss yyyy Z"))
    return F.coalesce(F.when(text.contains(","), mail), log)
