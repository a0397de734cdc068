"""Joins, set operations and merges of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from techtrail.operators.ordering import carry_last, number_rows


def outer_indicator(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join with side: left_only, right_only or both."""
    joined = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full_outer")
    side = F.when(F.col("in_b").isNull(), "left_only").when(F.col("in_a").isNull(), "right_only").otherwise("both")
    return joined.withColumn("side", side).drop("in_a", "in_b")


def asof_grid(versions: DataFrame, project: str, ts: str, value: str, month: int, day: int, end_year: int) -> DataFrame:
    """project, due, value: for each year's date, from the project's first year to the end, the latest version not after it.

    Dates are rows of the same history, so one sort by range carries the last version forward; no range join is made, and a long history is several tasks' work.
    """
    first = versions.groupBy(project).agg(F.year(F.min(ts)).alias("first"))
    years = first.where(F.col("first") <= end_year).select(project, F.explode(F.sequence(F.col("first"), F.lit(end_year))).alias("year"))
    dates = years.select(project, F.make_date("year", F.lit(month), F.lit(day)).alias("due"), F.lit(None).cast(versions.schema[value].dataType).alias(value))
    rows = versions.select(project, F.col(ts).cast("timestamp").alias("ts"), F.lit(None).cast("date").alias("due"), value)
    both = rows.unionByName(dates.withColumn("ts", F.col("due").cast("timestamp")))
    carried = carry_last(both, [project], ["ts", F.col("due").isNotNull(), value], F.col(value), "last")
    return carried.where("due is not null and last is not null").select(project, "due", F.col("last").alias(value))


def match_names(texts: DataFrame, names: list[tuple[str, str]], column: str = "text") -> DataFrame:
    """texts with name, one row for each name any of whose aliases (name, alias) is in the text, case ignored. Names are a short list of the program."""
    low = F.lower(column)
    by_name: dict[str, list[str]] = {}
    for name, alias in names:
        by_name.setdefault(name, []).append(alias.lower())
    found = []
    for name, aliases in by_name.items():
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | F.contains(low, F.lit(alias))
        found.append(F.when(hit, F.lit(name)))
    return texts.withColumn("name", F.explode(F.array_compact(F.array(*found))))


def present(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b, key, "left_semi")


def missing(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a, repeats included, whose key b hasn't."""
    return a.join(b, key, "left_anti")


def compare_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: sizes of both, distinct keys of both, in both, in one only, and whether they are equal."""
    count = lambda df: df.groupBy(*key).agg(F.count("*").alias("n"))
    joined = count(a).withColumnRenamed("n", "na").join(count(b).withColumnRenamed("n", "nb"), key, "full_outer")
    counted = joined.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"),
        F.count("na").alias("keys_a"),
        F.count("nb").alias("keys_b"),
        F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("in_both"),
        F.count_if(F.col("nb").isNull()).alias("only_a"),
        F.count_if(F.col("na").isNull()).alias("only_b"),
    )
    return counted.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out.distinct()


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, with the columns that both have."""
    columns = [c for c in a.columns if c in b.columns]
    return a.select(*columns).unionByName(b.select(*columns))


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows, and new ones of other keys."""
    return stored.unionByName(missing(new, stored, key))


def merge_stores(a: DataFrame, b: DataFrame, natural: list[str], ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """(merged rows, map of b's ids): rows with the same natural key are one and keep a's id; new ones get ids after a's largest, in order of b's."""
    matched = b.select(F.col(ident).alias("old_id"), *natural).join(a.select(F.col(ident).alias("a_id"), *natural), natural, "left")
    most = a.agg(F.coalesce(F.max(ident), F.lit(0)).alias("most"))
    new = number_rows(matched.where("a_id is null").select("old_id", *natural), ["old_id"], "place")
    fresh = new.crossJoin(F.broadcast(most)).select(*natural, "old_id", (F.col("most") + F.col("place") + 1).alias("new_id"))  # most is one row
    ids = matched.where("a_id is not null").select("old_id", F.col("a_id").alias("new_id")).unionByName(fresh.select("old_id", "new_id"))
    return a.select(F.col(ident), *natural).unionByName(fresh.select(F.col("new_id").alias(ident), *natural)), ids


def rewrite_key(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A foreign key through the map of ids."""
    return df.join(ids, df[key] == ids["old_id"]).withColumn(key, F.col("new_id")).drop("old_id", "new_id")


def combine_first(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """a's values, and b's where a has none."""
    joined = a.withColumnRenamed(value, "va").join(b.withColumnRenamed(value, "vb"), key, "full_outer")
    return joined.select(*key, F.coalesce("va", "vb").alias(value))


def sync_plan(corpus: DataFrame, store: DataFrame, key: list[str], additive: bool = False, ignored: Column | None = None) -> DataFrame:
    """key, action: keep, add, delete (additive: keep), or ignore for keys that a filter leaves out."""
    side = outer_indicator(corpus.select(*key).distinct(), store.select(*key).distinct(), key)
    action = F.when(F.col("side") == "both", "keep").when(F.col("side") == "left_only", "add").otherwise("keep" if additive else "delete")
    return side.select(*key, (F.when(ignored, "ignore").otherwise(action) if ignored is not None else action).alias("action"))


def label_categories(labels: DataFrame, bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """label, category, is_main: many to many."""
    return labels.join(bridge, "label_id").join(categories, "category_id").select("label", "category", "is_main")
