"""What projects, slices, labels and files are in the test tables.

The operators take column names and know nothing of this; only queries do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from techtrail.operators import slices

#: Events in one slice of a user's history.
SLICE = 5

#: Whole numbers in one block of a list that would have no bound otherwise.
BLOCK = 1000

#: Label patterns for text lines, in a dialect that Java and RE2 share.
PATTERNS = [
    ("the", "database", ["\\bthe\\b", "\\bthat\\b"]),
    ("licence", "implementation", ["Licensed under", "All rights reserved"]),
    ("token", "query", ["token *=", "[0-9a-f]{24,}"]),
    ("number", "query", ["[0-9]{3,}"]),
    ("(IgnoreCase) with", "database", ["^with\\b"]),
    ("never", "database", ["qqqqzzzz"]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block(column: str) -> Column:
    """The block of a list that a whole number belongs to."""
    return F.floor(F.col(column) / BLOCK).alias("block")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, part, label: event types present in each full slice of a user's events, of which those without a time come last."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("label"))
    return slices.presence(events, "user_id", [F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")], "label", SLICE)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, domain."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("domain"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path, text: documents as files of sources."""
    path = F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang")))
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("project"), path.alias("path"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path, line_no, line of all files."""
    rows = texts(spark, sf_dir).select("project", "path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("project", "path", (F.col("at") + 1).alias("line_no"), "line")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path."""
    return texts(spark, sf_dir).select("project", "path")


HISTORY_SQL = f"""
ev AS (SELECT user_id, event_type AS label, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {SLICE} + 1 AS part,
       count(*) OVER (PARTITION BY user_id) AS n FROM events),
hist AS (SELECT DISTINCT user_id, part, label FROM ev WHERE part <= n // {SLICE}),
sizes AS (SELECT user_id, max(part) AS n_parts FROM hist GROUP BY user_id)"""

#: Transitions on the full grid of slices and labels: another way than the operator's.
TRANSITIONS_SQL = f"""{HISTORY_SQL},
grid AS (SELECT s.user_id, p.part, l.label, s.n_parts FROM sizes s, LATERAL (SELECT unnest(range(1, s.n_parts + 1)) AS part) p, (SELECT DISTINCT label FROM hist) l),
x AS (SELECT g.*, CASE WHEN h.label IS NULL THEN 0 ELSE 1 END AS cur FROM grid g LEFT JOIN hist h USING (user_id, part, label)),
t AS (SELECT *, lag(cur) OVER (PARTITION BY user_id, label ORDER BY part) AS prev FROM x),
tr AS (SELECT user_id, part, label, n_parts, cur, CASE WHEN prev IS NULL AND cur = 1 THEN 'INIT' WHEN cur = 1 AND prev = 0 THEN 'IN'
       WHEN cur = 0 AND prev = 1 THEN 'OUT' WHEN cur = 1 THEN 'KEEP' END AS op FROM t WHERE cur = 1 OR prev = 1)"""

LINES_SQL = """
files AS (SELECT source AS project, lang || '/' || doc_id || '.' || lang AS path, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT project, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM files)"""
