"""Writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Rows below those that are there; the table is made if it is not."""
    write_table(df, path, fmt, "append")


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Lines of sequence text (column text)."""
    sequences.select("text").write.mode("overwrite").text(path)


def metric(df: DataFrame, key: str, value: Column, order: int = 0) -> DataFrame:
    """key, value, text, nth: one metric from an aggregate over df."""
    return df.agg(value.cast("double").alias("value")).select(F.lit(key).alias("key"), "value", F.format_string("%.1f", "value").alias("text"), F.lit(order).alias("nth"))


def relative_metric(df: DataFrame, key: str, part: Column, total: Column, order: int = 0) -> DataFrame:
    """The part in percent of the total, and the total under <key>_total."""
    both = df.agg(part.cast("double").alias("part"), total.cast("double").alias("total"))
    share = F.col("part") * 100 / F.nullif(F.col("total"), F.lit(0.0))
    rows = F.array(F.struct(F.lit(key).alias("key"), share.alias("value"), F.format_string("%.1f%%", share).alias("text")), F.struct(F.lit(f"{key}_total").alias("key"), F.col("total").alias("value"), F.format_string("%.0f", "total").alias("text")))
    return both.select(F.explode(rows).alias("r")).select("r.*", F.lit(order).alias("nth"))


def metrics_store(*metrics: DataFrame) -> DataFrame:
    """key, value, text: of metrics with the same key the one of the greatest order, and of equal orders the last given."""
    rows = reduce(lambda a, b: a.unionByName(b), [x.withColumn("given", F.lit(i)) for i, x in enumerate(metrics)])
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "text"), F.struct("nth", "given")).alias("m")).select("key", "m.value", "m.text")
