"""Vulnerabilities matched by name, and the review of executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from techtrail.functions.scalars import first_number, id_year
from techtrail.operators.joins import match_names


def build_vulnerabilities(descriptions: DataFrame, names: list[tuple[str, str]], order: dict[str, int]) -> DataFrame:
    """name, label, year, version: one row for each vulnerability, that of the label which comes first in order."""
    found = match_names(descriptions, names, "description").withColumnRenamed("name", "label") if "name" not in descriptions.columns else match_names(descriptions.withColumnRenamed("name", "ident"), names, "description").withColumnRenamed("name", "label").withColumnRenamed("ident", "name")
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("label")]
    first = found.groupBy("name").agg(F.min(F.struct(rank.alias("rank"), "label", "description")).alias("v"))
    return first.select("name", "v.label", id_year(F.col("name")).alias("year"), first_number(F.col("v.description")).alias("version"))


def agreement(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rated by both, agreed, and the share."""
    both = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("rated"), F.count_if(F.col(a) == F.col(b)).alias("agreed"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("share"))


def agreed(ratings: DataFrame, a: str, b: str) -> DataFrame:
    return ratings.where(F.col(a) == F.col(b))


def review_status(executions: DataFrame, project: str = "project") -> DataFrame:
    """project, status: a map from label to (is_validated, is_accepted, user) of executions with output."""
    row = F.struct("is_validated", "is_accepted", "user")
    per = executions.where("output <> ''").groupBy(project, "label").agg(F.max(row).alias("v"))
    return per.groupBy(project).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "v")))).alias("status"))


def latest_verdicts(verdicts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last verdict of each key: an aggregation, so no key's verdicts are sorted."""
    values = [c for c in verdicts.columns if c not in key]
    last = verdicts.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in values if c not in order])).alias("v"))
    return last.select(*key, *(F.col(f"v.{c}").alias(c) for c in values))


def apply_verdicts(executions: DataFrame, verdicts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """executions with the last verdict of their key, where there is one."""
    last = latest_verdicts(verdicts, key, order).select(*key, F.col("is_validated").alias("v1"), F.col("is_accepted").alias("v2"), F.col("user").alias("v3"))
    joined = executions.join(last, key, "left")
    return joined.withColumn("is_validated", F.coalesce("v1", "is_validated")).withColumn("is_accepted", F.coalesce("v2", "is_accepted")).withColumn("user", F.coalesce("v3", "user")).drop("v1", "v2", "v3")
