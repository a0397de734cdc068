"""Catalogue of labels and their models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_class(relational: Column, non_relational: Column) -> Column:
    """Both, Relational, Non Relational or None, from two flags."""
    return F.when(relational & non_relational, "Both").when(relational, "Relational").when(non_relational, "Non Relational").otherwise("None")


def attach_model(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds model of label; labels that the catalogue hasn't are Multi Model."""
    return df.join(catalogue.select("label", F.col("model").alias("known")), "label", "left").withColumn("model", F.coalesce("known", F.lit("Multi Model"))).drop("known")
