"""Continuous forms of the review feed, the scan and the transitions.

The scan keeps what it has seen in Spark's state store, and the transitions keep open slices there; both take a batch's work from the batch alone. Verdicts and the last slices of projects are tables that grow by batches and are merged as
they grow (``runs``): what is read of them grows with their keys, never with the number of batches.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from techtrail.operators import reviews, scan, sequences
from techtrail.streaming import runs

#: A state store on the executors' disks, of which a batch saves what it has changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in STATE_STORE."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes in all that there is now, in as many batches as the source makes, and ends. sink is a function for foreachBatch, or a folder that rows are appended to, each once."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with state_on_disk(stream.sparkSession):
        query = writer.format("parquet").start(sink) if isinstance(sink, str) else writer.foreachBatch(sink).start()
    query.awaitTermination()
    return query


def last_number(query: StreamingQuery) -> int:
    """Number of the last batch, -1 if there was none."""
    progress = query.lastProgress
    return progress["batchId"] if progress else -1


def stream_verdicts(schema, path: str, keys: list[str], order: list[str], fan: int = runs.FAN) -> Callable[[DataFrame, int], None]:
    """A sink for verdicts: a batch adds the latest of each key in it, and merging keeps the latest; latest_of makes the table of them, feed_of what a batch has changed."""

    def best(rows: DataFrame) -> DataFrame:
        return reviews.latest_verdicts(rows, keys, order).select(*rows.columns)

    return runs.sink(path, schema, lambda _, batch: best(batch), best, fan)


def latest_of(spark: SparkSession, path: str, last: int, schema, keys: list[str], order: list[str], fan: int = runs.FAN) -> DataFrame:
    """The latest verdict of each key after a batch."""
    added = runs.read_runs(spark, path, last + 1, schema, fan)
    return reviews.latest_verdicts(added, keys, order).select(*added.columns)


def feed_of(spark: SparkSession, path: str, number: int, schema, keys: list[str], order: list[str], fan: int = runs.FAN) -> DataFrame:
    """What a batch has published: its verdicts that are later than the latest one before it. For consumers that follow the batches."""
    before = latest_of(spark, path, number - 1, schema, keys, order, fan).select(*keys, F.struct(*order).alias("known order"))
    added = spark.read.schema(schema).parquet(runs.run_path(path, number, 1))
    news = added.join(before, keys, "left").where(F.col("known order").isNull() | (F.struct(*order) > F.col("known order")))
    return news.select(*added.columns)


HITS = "project string, path string, version string, line_no int, label string"


def scan_stream(lines: DataFrame, heuristics: list, late: str | None = None) -> DataFrame:
    """HITS of lines (project, path, version, line_no, line) as they arrive: each line of a version once, in whatever batches a file's lines come and come again.

    The state store knows which lines have been seen, so a batch looks at its own lines alone. With late, lines have a time, ts, and those seen are forgotten when the watermark has passed them
    by so much; otherwise all are kept.
    """
    key = ["project", "path", "version", "line_no"]
    fresh = lines.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if late else lines.dropDuplicates(key)
    return scan.scan(fresh.select(*key, "line"), heuristics).select(*key, "label")


def hits_of(spark: SparkSession, path: str) -> DataFrame:
    """HITS that have been appended to a folder."""
    return spark.read.schema(HITS).parquet(path)


LAST_SLICES = "project long, part long, labels array<string>"


def closed_slices(rows: DataFrame, late: str) -> DataFrame:
    """project, part, labels of slices (project, part, label, ts) that are complete: those whose time, ts, the watermark has passed. Later rows of a slice are dropped.

    All rows of a slice have its time, and a project's later slices have later ones. Rows without a project only tell the time; they are left to whoever takes the slices, since a filter here would come before the watermark.
    """
    known = rows.withWatermark("ts", late).groupBy("project", "part", "ts").agg(F.collect_set("label").alias("labels"))  # labels are few
    return known.select("project", "part", "labels")


def stream_transitions(path: str, changes: str, fan: int = runs.FAN) -> Callable[[DataFrame, int], None]:
    """A sink for closed slices: transitions of each batch are written to a table of their own, under its number, and the last slice of each project is kept at path.

    A project's slices close in their order; one that is not later than the last known one is dropped.
    """

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("project").agg(F.max(F.struct("part", "labels")).alias("last")).select("project", "last.part", "last.labels")

    def write(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.where("project is not null").persist()  # read several times, and made by the state store's operator
        runs.merge_runs(spark, path, number, LAST_SLICES, newest, fan)
        last = newest(runs.read_runs(spark, path, number, LAST_SLICES, fan).join(batch.select("project"), "project", "left_semi"))
        known = last.select("project", F.col("part").alias("known"))
        fresh = batch.join(known, "project", "left").where("known is null or part > known").select("project", "part", "labels")
        rows = last.unionByName(fresh).select("project", "part", F.explode("labels").alias("label"))
        trans = sequences.transitions(rows, "project").join(known, "project", "left").where("known is null or part > known")
        trans.select("project", "part", "label", "op").write.mode("overwrite").parquet(runs.run_path(changes, number, 1))
        runs.write_run(newest(fresh), path, number)
        batch.unpersist()

    return write


def transitions_of(spark: SparkSession, changes: str, last: int) -> DataFrame:
    """project, part, label, op after a batch."""
    schema = "project long, part long, label string, op string"
    paths = [runs.run_path(changes, k, 1) for k in range(last + 1)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_usage(stream: DataFrame, ts: str, label: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, label, n in tumbling windows; rows later than the watermark are dropped."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "label", "n")
