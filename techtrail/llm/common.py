"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from techtrail.sources.shared import new_path


_listening: list[list[str]] = []


@contextlib.contextmanager
def stashed() -> Iterator[list[str]]:
    """A list of the paths that are stashed inside, in their order, for those who know when they are no longer read."""
    _listening.append(made := [])
    try:
        yield made
    finally:
        _listening.pop()


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage, and keeps results that are read twice; a lost executor
    costs nothing, since the files are not its own. Results are read from the files when
    they are asked for, so whoever uses a result up may delete them (``stashed`` names them); otherwise they stay.
    """
    path = new_path(df.sparkSession, "stash")
    df.write.parquet(path)
    for made in _listening:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the bytes of one column stay near limit (a single row may be longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        yield batch.slice(begin)
