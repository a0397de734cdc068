"""Queries that go through files and streams. What they read, Spark has written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from techtrail.operators import sequences
from techtrail.plans import bindings as b
from techtrail.plans.book import Book
from techtrail.plans.histories import trans
from techtrail.plans.scans import HITS_SQL
from techtrail.sources import readers as r
from techtrail.sources import writers as w
from techtrail.sources.shared import new_path, written
from techtrail.streaming import jobs, runs

book = Book()


@book.query("src_delimited", "SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def src_delimited(spark, sf_dir):
    path = new_path(spark, "delimited")
    b.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("sep", "#").option("header", True).csv(path)
    return r.read_delimited(spark, path, "#", True, ["key", "name", "segment"])


def _rename(spark, path, name):
    """Gives the files under a path, one for each pattern file of a scan, names made of their partitions' values."""
    jvm, folder = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listFiles(folder, True)
    files = []
    while found.hasNext():
        files.append(found.next().getPath())
    for file in files:
        values = dict(x.split("=", 1) for x in file.toString().split("/") if "=" in x)
        if file.getName().startswith("part-"):
            target = jvm.org.apache.hadoop.fs.Path(f"{path}-named/{name(values)}")
            system.mkdirs(target.getParent())
            system.rename(file, target)
    return f"{path}-named"


@book.query("src_heuristics", "SELECT DISTINCT replace(p_type, ' ', '') AS type, replace(p_brand, '#', '') AS label, 'import ' || p_size AS pattern FROM part")
def src_heuristics(spark, sf_dir):
    """Folders are types, files labels, lines patterns."""
    path = new_path(spark, "heuristics")
    plain = lambda c, sign: F.replace(c, F.lit(sign), F.lit(""))
    rows = b.table(spark, sf_dir, "part").select(plain("p_type", " ").alias("type"), plain("p_brand", "#").alias("label"), F.concat(F.lit("import "), F.col("p_size").cast("string")).alias("value")).distinct()
    rows.repartition("type", "label").write.partitionBy("type", "label").text(path)
    return r.read_heuristics(spark, _rename(spark, path, lambda x: f"{x['type']}/{x['label']}.txt"))


@book.query(
    "src_xml",
    """WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'article' ELSE 'inproceedings' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'sub/' ELSE '' END AS folder FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')),
    q AS (SELECT 'conf/' || p_brand || '/' || folder || p_partkey AS key, kind, 'conf/' || p_brand AS venue_key, upper(p_brand) AS venue, p_brand || ' ' || p_type || ' and A B C' AS authors, p_name || 'def & ghd' AS title,
        (1990 + p_size)::INTEGER AS year, 'db/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 1 THEN 'conf/' || p_brand END AS crossref, lower(p_type) AS name FROM p)
    SELECT key, kind, venue_key, venue, authors, title, year, url, crossref, '@' || kind || '{' || split_part(name, ' ', 1) || ':' || year || ',' || chr(10) || CASE kind WHEN 'article' THEN 'journal' ELSE 'booktitle' END
        || ' = {' || venue || '}, ' || chr(10) || 'author = {' || authors || '}, ' || chr(10) || 'title = {{' || title || '}}, ' || chr(10) || 'year = {' || year || '} ' || chr(10) || '}' AS record FROM q""",
)
def src_xml(spark, sf_dir):
    """Articles and papers with markup in titles and authors, and keys in which a venue's stands at different places."""
    path = new_path(spark, "bib")
    part = b.table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 2 == 1
    tag = F.when(odd, "inproceedings").otherwise("article")
    key = F.concat(F.lit("conf/"), "p_brand", F.lit("/"), F.when(F.col("p_partkey") % 3 == 0, "sub/").otherwise(""), F.col("p_partkey").cast("string"))
    link = F.when(odd, F.concat(F.lit("<crossref>conf/"), "p_brand", F.lit("</crossref>"))).otherwise("")
    text = "<%s key='%s'><author>%s <b>%s</b></author><author>A <i>B</i> C</author><title>%s<i>def &amp; </i>ghd.</title><year>%d</year><ee>http://%d</ee><url>old</url><url>db/%d</url>%s</%s>"
    rows = part.select(b.block("p_partkey"), F.format_string(text, tag, key, "p_brand", "p_type", "p_name", F.col("p_size") + 1990, "p_partkey", "p_partkey", link, tag).alias("paper"))
    whole = F.concat(F.lit("<dblp>\n"), F.array_join(F.collect_list("paper"), "\n"), F.lit("\n</dblp>"))
    rows.groupBy("block").agg(whole.alias("value")).repartition("block").write.partitionBy("block").option("maxRecordsPerFile", 1).text(path)
    venues = part.select(F.concat(F.lit("conf/"), "p_brand").alias("venue_key"), F.upper("p_brand").alias("venue")).distinct()
    return r.read_bib(spark, path, venues.where("venue_key in ('conf/Brand#11', 'conf/Brand#12')"))


@book.query("src_json_advisories", "SELECT 'GHSA-' || o_orderkey AS id, o_orderdate AS published, 'CVE-' || o_custkey AS alias, o_orderpriority AS severity FROM orders")
def src_json_advisories(spark, sf_dir):
    """Files in folders, each with a list of advisories over several lines."""
    path = new_path(spark, "advisories")
    rows = b.table(spark, sf_dir, "orders").select(
        b.block("o_orderkey"),
        F.concat(F.lit("GHSA-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.array(F.concat(F.lit("CVE-"), F.col("o_custkey").cast("string"))).alias("aliases"),
        F.struct(F.col("o_orderpriority").alias("severity")).alias("database_specific"),
    )
    lists = rows.groupBy("block").agg(F.to_json(F.collect_list(F.struct("id", "published", "aliases", "database_specific"))).alias("value"))
    lists.withColumn("value", F.replace("value", F.lit("},{"), F.lit("},\n{"))).repartition("block").write.partitionBy("block").option("maxRecordsPerFile", 1).text(path)
    found = r.read_advisories(spark, path, "part-*")
    return found.select("id", F.col("published").cast("timestamp_ntz").alias("published"), F.col("aliases")[0].alias("alias"), "severity")


@book.query(
    "src_files",
    """WITH f AS (SELECT source, lang, doc_id // 1000 AS block, regexp_split_to_array(string_agg(text, chr(10) ORDER BY doc_id) || chr(10), '\r?\n') AS lines FROM documents WHERE text IS NOT NULL GROUP BY ALL)
    SELECT 'source=' || source AS project, 'source=' || source || '/lang=' || lang || '/block=' || block AS folder, generate_subscripts(lines, 1)::INTEGER AS line_no, md5(unnest(lines)) AS line FROM f""",
)
def src_files(spark, sf_dir):
    """Documents as text files in folders by source, language and block."""
    path = new_path(spark, "corpus")
    rows = b.table(spark, sf_dir, "documents").where("text is not null").select("source", "lang", b.block("doc_id"), "doc_id", F.col("text").alias("value"))
    keys = ["source", "lang", "block"]
    rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id").select(*keys, "value").write.partitionBy(*keys).text(path)
    found = r.read_corpus(spark, path).where(~F.col("path").contains("_SUCCESS"))
    return found.select("project", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "line_no", F.md5("line").alias("line"))


@book.query("src_table", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def src_table(spark, sf_dir):
    """A table as a spreadsheet's export, with blanks."""
    path = new_path(spark, "sheet")
    segment = F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    w.write_table(b.table(spark, sf_dir, "customer").select("c_custkey", "c_name", segment), path, "csv")
    return r.read_table(spark, path, schema="c_custkey long, c_name string, c_mktsegment string")


@book.query("src_jdbc", "SELECT event_id, event_type, c_name FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey IN (1, 3, 5)")
def src_jdbc(spark, sf_dir):
    """Customers from a relational store in memory, which Spark's own embedded database keeps, so this query is for local sessions; the filter is done there."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    customers = b.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    customers.write.format("jdbc").option("url", url).option("dbtable", "customer").option("createTableColumnTypes", "c_name VARCHAR(100)").save()
    stored = r.read_store(spark, url, "customer").where("c_nationkey in (1, 3, 5)")
    return b.table(spark, sf_dir, "events").join(stored, F.col("user_id") == F.col("c_custkey")).select("event_id", "event_type", "c_name")


@book.query("parse_grep_output", "SELECT user_id AS project, 'src/' || event_type || '/' || event_id || '.java' AS path, (event_id % 90 + 1)::INTEGER AS line_no, 'value: ' || event_id AS line FROM events")
def parse_grep_output(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    number, esc = F.col("event_id") % 90 + 1, "\x1b"
    block = F.concat(F.lit(f"{esc}[35mabc123:src/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(f".java{esc}[m\n"), (number - 1).cast("string"), F.lit("-context\n"), number.cast("string"), F.lit(":value: "), F.col("event_id").cast("string"), F.lit("\n--\n"), (number + 9).cast("string"), F.lit("-more"))
    outputs = ev.groupBy(F.col("user_id").alias("project"), b.block("event_id")).agg(F.array_join(F.collect_list(block), "\n\n").alias("output"))
    return r.parse_hits(outputs, "output").drop("block")


@book.query("src_venues", "SELECT 'conf/' || lower(n_name) AS venue_key, n_name AS venue FROM nation")
def src_venues(spark, sf_dir):
    path = new_path(spark, "venues")
    b.table(spark, sf_dir, "nation").select(F.concat(F.lit("conf/"), F.lower("n_name"), F.lit("  "), "n_name").alias("value")).write.text(path)
    return r.read_lookup(spark, path, ("venue_key", "venue"))


@book.query("sink_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def sink_table(spark, sf_dir):
    path = new_path(spark, "table")
    w.write_table(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.parquet(path)


@book.query("sink_append", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def sink_append(spark, sf_dir):
    path, orders = new_path(spark, "table"), b.table(spark, sf_dir, "orders").select("o_orderkey")
    for part in (2, 3):
        w.append_table(orders.where(F.col("o_orderkey") % part == 0), path)
    return spark.read.parquet(path)


@book.query("src_patterns", f"WITH {b.HISTORY_SQL} SELECT label AS pattern, count(DISTINCT user_id) AS support, min(user_id) AS first_line FROM hist GROUP BY label, user_id // {b.BLOCK}")
def src_patterns(spark, sf_dir):
    """Patterns with the ids of their sequences, in blocks of bounded size."""
    path = new_path(spark, "patterns")
    rows = b.history(spark, sf_dir).groupBy("label", b.block("user_id")).agg(F.sort_array(F.collect_set("user_id")).alias("ids"))
    rows.select(F.concat("label", F.lit(" | #SUP: "), F.size("ids").cast("string"), F.lit(" #SID: "), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    return r.parse_patterns(spark.read.text(path)).select(F.col("itemsets")[0][0].alias("pattern"), "support", F.array_min("lines").alias("first_line"))


@book.query(
    "metrics_store",
    "SELECT 'orders' AS key, count(*)::DOUBLE AS value, printf('%.1f', count(*)::DOUBLE) AS text FROM orders UNION ALL SELECT 'filled', count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), printf('%.1f%%', count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*)) FROM orders UNION ALL SELECT 'filled_total', count(*)::DOUBLE, printf('%.0f', count(*)::DOUBLE) FROM orders",
)
def metrics_store(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    stale = w.metric(orders, "orders", F.lit(0), 0)
    filled = w.relative_metric(orders, "filled", F.count_if(F.col("o_orderstatus") == "F"), F.count("*"))
    return w.metrics_store(stale, w.metric(orders, "orders", F.count("*"), 1), filled)


def _waves(spark, rows, wave, path, schema):
    """A stream of rows that come in waves, numbered from 0: each is a folder of as many files as its rows fill, and is taken in by batches of its own."""
    rows.withColumn("wave", wave).write.partitionBy("wave").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


@book.query("stream_verdicts", "SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY conv_id, role")
def stream_verdicts(spark, sf_dir):
    source, table, schema, keys = new_path(spark, "verdicts"), new_path(spark, "latest"), "conv_id long, role string, turn long", ["conv_id", "role"]
    stream = _waves(spark, b.table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), F.col("turn") % 3, source, schema)
    query = jobs.run_available(stream, jobs.stream_verdicts(schema, table, keys, ["turn"], fan=2), new_path(spark, "progress"))
    return jobs.latest_of(spark, table, jobs.last_number(query), schema, keys, ["turn"], fan=2)


LINES = "project string, path string, version string, line_no int, line string"


@book.query("stream_scan", f"WITH {HITS_SQL} SELECT project, path, v AS version, line_no, label FROM hits, (VALUES ('1'), ('2')) t(v) WHERE v = '1' OR line_no <= 3")
def stream_scan(spark, sf_dir):
    """Lines of one file come in several batches, those of some files again, and the first ones in another version too."""
    source, found = new_path(spark, "lines"), new_path(spark, "found")
    come = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(later).alias("later")) for v, later in (("1", 0), ("1", 3), ("2", 2))))
    lines = b.lines(spark, sf_dir).withColumn("come", F.explode(F.filter(come, lambda x: (x["later"] == 0) | (F.col("line_no") <= 3))))
    stream = _waves(spark, lines.select("project", "path", "come.version", "line_no", "line", "come.later"), F.col("later") + F.col("line_no") % 3, source, LINES)
    jobs.run_available(jobs.scan_stream(stream, b.PATTERNS), found, new_path(spark, "progress"))
    return jobs.hits_of(spark, found)


@book.query("stream_transitions", f"WITH {b.TRANSITIONS_SQL} SELECT user_id AS project, part, label, op FROM tr")
def stream_transitions(spark, sf_dir):
    """Slices come in four waves: a third of the longest history, but five slices at least, and with it those labels of the third before that come one wave after the others, for which slices stay open.
    A row without a project, of a later time, closes the last ones."""
    state, changes, progress, source = (new_path(spark, x) for x in ("last", "changes", "progress", "slices"))
    schema = "project long, part long, label string, ts timestamp"
    hist = written(b.history(spark, sf_dir).select(F.col("user_id").alias("project"), F.col("part").cast("long").alias("part"), "label"), "history")
    third = max(5, -(-(hist.agg(F.max("part")).first()[0] or 0) // 3))
    rows = hist.withColumn("ts", F.timestamp_seconds(F.col("part") * 86400)).withColumn("wave", F.expr(f"(part - 1) div {third} + pmod(xxhash64(label), 2)"))
    sink = jobs.stream_transitions(state, changes, fan=4)
    query = None
    for k in range(4):  # the feed's producer: a wave, and the stream takes it in before the next one comes
        wave = rows.where(F.col("wave") == k).select("project", "part", "label", "ts")
        if k == 3:
            wave = wave.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("project"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("string").alias("label"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts")))
        wave.write.mode("append").parquet(source)
        query = jobs.run_available(jobs.closed_slices(spark.readStream.schema(schema).parquet(source), f"{2 * third} days"), sink, progress)
    return jobs.transitions_of(spark, changes, jobs.last_number(query))


@book.query("stream_usage", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def stream_usage(spark, sf_dir):
    """Events come in any order, so the watermark covers the days of the table."""
    source, table = new_path(spark, "events"), new_path(spark, "usage")
    rows = b.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    usage = jobs.stream_usage(_waves(spark, rows, F.col("ts").cast("long") % 3, source, "ts timestamp, event_type string"), "ts", "event_type", late="400 days")
    most = lambda x: x.groupBy("window_start", "label").agg(F.max("n").alias("n"))
    query = jobs.run_available(usage, runs.sink(table, usage.schema, lambda _, batch: batch, most), new_path(spark, "progress"), "update")
    counted = most(runs.read_runs(spark, table, jobs.last_number(query) + 1, usage.schema))
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@book.query("sequence_files", f"WITH {b.TRANSITIONS_SQL} SELECT count(DISTINCT user_id) AS n FROM tr")
def sequence_files(spark, sf_dir):
    path = new_path(spark, "sequences")
    w.write_sequences(sequences.sequence_text(sequences.tagged_sequences(trans(spark, sf_dir))), path)
    return spark.read.text(path).where(F.col("value").endswith("-2")).agg(F.count("*").alias("n"))


QUERIES, ORACLE = book.queries, book.sql
