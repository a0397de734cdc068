"""A table that grows by batches and is merged as it grows.

Batch k writes run (k, 1). Once FAN runs of one size stand side by side, and a later batch begins, they are merged into one run FAN times as large: so after n batches a reader opens
fewer than FAN runs of each size, of which there are as many as n has digits, and a row is rewritten as many times at most. A run counts once Spark has marked it as whole (_SUCCESS), and is never changed after that. Merging
that is interrupted leaves a run without the mark, which is made again from its parts; these stay until the merged run has become a part of a larger one itself, so a reader that has begun goes on.

A batch that is run again after a failure writes its run again; runs it is merged into are made only when the batch after it begins, so what a batch reads is what earlier batches have added, however often it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from techtrail.sources.shared import path_exists, remove_path

#: Runs of one size that become one.
FAN = 8


def run_path(path: str, first: int, size: int) -> str:
    return f"{path}/run-{first:010d}-{size}"


def spans(count: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(first, size) of the runs that batches 0 to count - 1 are in when all merges are done."""
    made, at, size = [], 0, 1
    while size * fan <= count:
        size *= fan
    while at < count:
        while at + size > count:
            size //= fan
        made.append((at, size))
        at += size
    return made


def _is_whole(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def run_paths(spark: SparkSession, path: str, count: int, fan: int = FAN) -> list[str]:
    """Paths of the runs to read: a run that is not whole is read as its parts. Raises ValueError if batches have been merged with later ones since, and are no longer there by themselves."""

    def of(first: int, size: int) -> list[str]:
        one = run_path(path, first, size)
        if _is_whole(spark, one):
            return [one]
        if size == 1:
            raise ValueError(f"{path} has no run of batch {first} by itself")
        return [x for k in range(fan) for x in of(first + k * size // fan, size // fan)]

    return [x for first, size in spans(count, fan) for x in of(first, size)]


def read_runs(spark: SparkSession, path: str, count: int, schema, fan: int = FAN) -> DataFrame:
    """What batches 0 to count - 1 have added, as far as merging has kept it."""
    paths = run_paths(spark, path, count, fan)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_run(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(run_path(path, number, 1))


def merge_runs(spark: SparkSession, path: str, count: int, schema, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
    """Makes the runs that end with batch count - 1, smallest first, and deletes the parts of their parts."""
    size = fan
    while count and count % size == 0:
        first, part = count - size, size // fan
        target = run_path(path, first, size)
        if not _is_whole(spark, target):
            parts = [run_path(path, first + k * part, part) for k in range(fan)]
            merge(spark.read.schema(schema).parquet(*parts)).write.mode("overwrite").parquet(target)
        if part > 1:
            for k in range(size // (part // fan)):
                remove_path(spark, run_path(path, first + k * (part // fan), part // fan))
        size *= fan


def keep_all(rows: DataFrame) -> DataFrame:
    return rows


def sink(path: str, schema, step: Callable[[DataFrame, DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame] = keep_all, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: step(what batches before have added, batch) is what the batch adds."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merge_runs(spark, path, number, schema, merge, fan)
        write_run(step(read_runs(spark, path, number, schema, fan), batch), path, number)

    return write


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is greatest by order: what merging keeps of a table of latest states. A hot key is added up within tasks first."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *(f"best.{c}" for c in [*order, *rest])).select(*rows.columns)
