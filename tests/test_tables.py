import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from techtrail.functions import scalars
from techtrail.operators import aggregates, joins, rules, scan, sequences, slices
from techtrail.operators.ordering import GROUP, PART, _by_range, carry_last, number_within, quantiles
from techtrail.sources import readers, writers


def test_merge_of_stores(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "id long, name string")
    merged, ids = joins.merge_stores(a, b, ["name"])
    assert {tuple(r) for r in merged.collect()} == {(1, "x"), (2, "y"), (3, "z")}
    assert {tuple(r) for r in ids.collect()} == {(1, 2), (2, 3)}
    keys = spark.createDataFrame([(1, 10), (2, 11)], "k long, v int")
    assert {tuple(r) for r in joins.rewrite_key(keys, ids, "k").select("k", "v").collect()} == {(2, 10), (3, 11)}


def test_changes_only(spark):
    outputs = ["", "p", "p", "", "p", "q"]  # newest first
    df = spark.createDataFrame([(1, -i, x) for i, x in enumerate(outputs)], "p int, ts int, output string")
    found = [r["output"] for r in scan.changes_only(df, ["p"], "ts").orderBy(F.desc("ts")).collect()]
    assert found == ["", "p", "", "q"]


def test_first_number_and_years(spark):
    df = spark.createDataFrame([("Oracle MySQL 5.7 and earlier", 5.7), ("before 10.2.1", 0.0), ("", 0.0), ("x 1e3", 1000.0)], "d string, want double")
    assert df.where(scalars.first_number(F.col("d")) != F.col("want")).count() == 0
    assert spark.range(1).select(scalars.id_year(F.lit("CVE-2019-7")), scalars.id_year(F.lit("none"))).first()[:] == (2019, None)


def test_quartiles(spark):
    row = aggregates.describe(spark.createDataFrame([(1,), (2,), (4,), (9,)], "v int"), ["v"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (1.75, 3.0, 5.25)


def test_scan_output(spark):
    text = "\x1b[35mabc1234:src/main/A.java\x1b[m\n12-context\n13:jdbc:h2:mem\n14-context\n\nsrc/test/B.java\n3:import org.h2.Driver\n--\n9-x"
    hits = readers.parse_hits(spark.createDataFrame([(1, text), (2, "")], "project int, output string"), "output").withColumn("label", F.lit("H2"))
    assert {tuple(r) for r in hits.select("path", "line_no", "line").collect()} == {("src/main/A.java", 13, "jdbc:h2:mem"), ("src/test/B.java", 3, "import org.h2.Driver")}
    assert scan.count_files(hits).first()["files"] == 2
    counted = scan.code_test(hits, hits.select("project").distinct(), 3, ".java", "src/test").first()
    assert (counted["code"], counted["test"], counted["other"], counted["none"]) == (1, 1, 0, 2)


def test_fan_in_counts_files_for_each_label(spark):
    hits = [("p", "a", "src/A.java", False), ("p", "b", "src/A.java", False), ("p", "a", "src/A.java", False), ("p", "p.q", "src/test/B.java", True), ("p", "a", "pom.xml", False), ("p", "a", "readme", False)]
    files = [("p", x) for x in ("src/A.java", "src/test/B.java", "pom.xml", "readme", "other")] + [("empty", "x")]
    made = scan.usage_fan_in(spark.createDataFrame(hits, "project string, label string, path string, dependency boolean"), spark.createDataFrame(files, "project string, path string"), ".java", "src/test", ".xml")
    found = {r["project"]: r for r in made.collect()}
    row = found["p"]
    assert (row["db_code"], row["db_xml"], row["db_other"], row["dep_test"], row["total_db"], row["total_project"]) == (2, 1, 1, 1, 5, 5)
    assert (row["pct_db_code"], row["pct_db_xml"], row["pct_dep_test"], row["pct_total_db"]) == (40, 20, 20, 100)
    assert row["db_test"] is row["pct_db_test"] is row["dep_code"] is None and "pct_db_other" not in made.columns
    assert found["empty"]["total_db"] is None and found["empty"]["total_project"] == 1


def test_pattern_dialect():
    assert scan.translate(r"\mark\b\.x\d") == r"mark\b\.x\d"
    assert scan.translate(" x​\t", clean=True) == "x"
    assert scan.label_regex("(IgnoreCase) a", ["x", "y|z"]) == "(?i)(?:x)|(?:y|z)"


def test_context_blocks(spark):
    text = "\n".join("hit" if i in (3, 6, 20) else "x" for i in range(1, 31))
    files = spark.createDataFrame([("f", text), ("g", None), ("h", ""), ("i", "none")], "path string, text string")
    found = scan.scan_context(files, [("h", "database", ["hit"])], 2).orderBy("line_no").collect()
    assert [(r["block"], r["line_no"]) for r in found] == [(1, i) for i in range(1, 9)] + [(2, i) for i in range(18, 23)]
    assert [r["line_no"] for r in found if r["is_hit"]] == [3, 6, 20]


def test_heuristics_and_corpus_files(spark, tmp_path):
    (tmp_path / "h" / "database").mkdir(parents=True)
    (tmp_path / "h" / "database" / "H2 X+1.txt").write_text("a\n\nb\n")
    (tmp_path / "h" / "database" / ".hidden.txt").write_text("c\n")
    found = readers.read_heuristics(spark, f"file://{tmp_path}/h").collect()
    assert sorted(tuple(r) for r in found) == [("database", "H2 X+1", "a"), ("database", "H2 X+1", "b")]
    (tmp_path / "c" / "p1" / "src").mkdir(parents=True)
    (tmp_path / "c" / "p1" / "src" / "A.java").write_bytes("one\nzwei é".encode())
    (tmp_path / "c" / "p1" / "bin").write_bytes(b"\0\1")
    found = readers.read_corpus(spark, f"file://{tmp_path}/c").collect()
    assert sorted(tuple(r) for r in found) == [("p1", "p1/src/A.java", 1, "one"), ("p1", "p1/src/A.java", 2, "zwei é")]


def test_tables_and_blanks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    writers.write_table(spark.createDataFrame([("a", " "), ("b", "x,y")], "k string, v string"), path, "csv")
    assert sorted(tuple(r) for r in readers.read_table(spark, path).collect()) == [("a", None), ("b", "x,y")]


def test_advisories(spark, tmp_path):
    (tmp_path / "2024" / "a").mkdir(parents=True)
    (tmp_path / "2024" / "a" / "x.json").write_text('{"id": "G-1",\n "published": "2024-01-02T03:04:05Z", "aliases": ["CVE-1"], "database_specific": {"severity": "LOW"}}')
    row = readers.read_advisories(spark, f"file://{tmp_path}").first()
    assert (row["id"], row["aliases"], row["severity"], str(row["published"])) == ("G-1", ["CVE-1"], "LOW", "2024-01-02 03:04:05")


def test_bibliography(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<dblp><article key='conf/icse/sub/Bar00'><author>A <i>B</i> C</author><author>D &amp; E</author><title>Abc<i>def</i>ghd.</title><year>2000</year><ee>http://e</ee><url>db/u</url></article>"
        "<inproceedings key='conf/msr/X1'><title>No authors</title><year>2001</year><crossref>conf/msr/2001</crossref></inproceedings><article key='journals/other/Y'><title>Z</title><year>1</year></article></dblp>"
    )
    venues = spark.createDataFrame([("conf/icse", "Software Engineering"), ("conf/msr", "Mining")], "venue_key string, venue string")
    found = {r["key"]: r for r in readers.read_bib(spark, f"file://{tmp_path}", venues).collect()}
    assert set(found) == {"conf/icse/sub/Bar00", "conf/msr/X1"}
    paper = found["conf/icse/sub/Bar00"]
    assert (paper["title"], paper["authors"], paper["url"], paper["venue"]) == ("Abcdefghd", "A B C and D & E", "db/u", "Software Engineering")
    assert paper["record"] == "@article{b:2000,\njournal = {Software Engineering}, \nauthor = {A B C and D & E}, \ntitle = {{Abcdefghd}}, \nyear = {2000} \n}"
    assert (found["conf/msr/X1"]["crossref"], found["conf/msr/X1"]["authors"]) == ("conf/msr/2001", "") and "booktitle = {Mining}" in found["conf/msr/X1"]["record"]
    assert readers.read_bib(spark, f"file://{tmp_path}", venues.where("false")).count() == 0


def test_stores(spark):
    url = "jdbc:derby:memory:stores;create=true"
    spark.createDataFrame([(1, 5), (2, 6)], "k int, v int").write.format("jdbc").option("url", url).option("dbtable", "t").mode("overwrite").save()
    stored = readers.read_store(spark, url, "t").where("v > 5").select("k")
    assert [r["k"] for r in stored.collect()] == [2] and "PushedFilters: [*IsNotNull(v), *GreaterThan(v,5)]" in stored._jdf.queryExecution().toString()


def test_mined_patterns(spark):
    row = readers.parse_patterns(spark.createDataFrame([("A | B C | #SUP: 2 #SID: 0 5",), ("A | #SUP: 7",)], "value string")).collect()
    assert (row[0]["itemsets"], row[0]["support"], row[0]["lines"]) == ([["A"], ["B", "C"]], 2, [0, 5])
    assert (row[1]["itemsets"], row[1]["support"], row[1]["lines"]) == ([["A"]], 7, [])


def test_lift_is_symmetric(spark):
    baskets = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["a"],), ([],), (["c", "b"],)], "items array<string>")
    found = {(r["a"], r["c"]): (r["lift"], r["support"]) for r in rules.pair_rules(rules.rules(baskets, 0.2, "lift", 0.0)).collect()}
    assert all(abs(found[a, c][0] - found[c, a][0]) < 1e-12 for a, c in found)
    assert found["a", "b"][1] == 0.4  # empty baskets count


def test_metrics(spark):
    df = spark.range(4)
    stored = writers.metrics_store(writers.metric(df, "n", F.lit(9), 0), writers.metric(df, "n", F.count("*"), 1), writers.relative_metric(df, "even", F.count_if(F.col("id") % 2 == 0), F.count("*")))
    assert {r["key"]: r["text"] for r in stored.collect()} == {"n": "4.0", "even": "50.0%", "even_total": "4"}


def test_nested_leaves(spark):
    from techtrail.operators.columns import flatten_first_leaf

    df = spark.createDataFrame([(1, ((5, 6), 7))], "id int, a struct<b: struct<c: int, d: int>, e: int>")
    assert flatten_first_leaf(df).first()[:] == (1, 5)


def test_quantiles(spark):
    """Numpy's, with ties, nulls, one value, many values in one bin, signs, zeros and infinity."""
    values = {"a": [float(i * 7919 % 1000) for i in range(3000)], "b": [5.0], "c": [1.0, 1.0, 1.0, 2.0], None: [0.25, 0.5, -3.0], "near": [1 + i * 1e-12 for i in range(500)], "odd": [-0.0, 0.0, -1e-300, 5e-324, -1e300, 1e300, 3.0]}
    rows = [(k, x) for k, xs in values.items() for x in [*xs, None]] + [("nothing", None), ("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf")), ("nan", float("nan")), ("nan", 1.0), ("nan", float("inf"))]
    found = quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"q1": 0.25, "middle": 0.5, "q3": 0.75, "last": 1.0})
    rows = {r["k"]: [r["q1"], r["middle"], r["q3"], r["last"]] for r in found.collect()}
    assert set(rows) == {*values, "inf", "nan"}
    for k, xs in values.items():
        assert rows[k] == pytest.approx(np.quantile(xs, [0.25, 0.5, 0.75, 1.0]), rel=1e-15)
    assert rows["inf"][1] == 1.0 and rows["inf"][3] == float("inf")
    assert rows["nan"][1] == float("inf") and np.isnan(rows["nan"][3])
    assert quantiles(spark.createDataFrame([], "x double"), [], "x", {"q1": 0.25}).collect() == []


@pytest.fixture
def sixteen_ranges(spark):
    """Sorts keep their sixteen ranges, however small they are."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot(n=3000):
    """Two thirds of the rows are of one key; keys and values may be null."""
    return [(None if i % 3 == 1 and i % 2 else 7 if i % 3 else i % 50 + 100, i, None if i % 5 else i) for i in random.Random(2).sample(range(n), n)]


def test_numbers_within_keys_that_span_ranges(spark, sixteen_ranges):
    df = spark.createDataFrame(hot(), "k int, i int, v int")
    found = number_within(df, ["k"], ["i"])
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("i")).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("k")))
    assert {tuple(r) for r in found.select("k", "i", "place", "total").collect()} == {tuple(r) for r in want.select("k", "i", "place", "total").collect()}
    ranges = _by_range(df, ["k"], ["i"]).groupBy("k", PART).count().groupBy("k").count()
    assert max(r["count"] for r in ranges.collect()) >= 5
    largest = _by_range(df, ["k"], ["i"]).groupBy(GROUP, PART).count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 3000 / 16  # no task has the hot key's rows


@pytest.mark.parametrize("itself", [True, False])
def test_values_are_carried_over_ranges(spark, sixteen_ranges, itself):
    rows = [(1, i, 5 if i == 2 else 9 if i == 1800 else None) for i in range(2000)] + [(2, i, None) for i in range(300)] + [(None, i, i if i == 40 else None) for i in range(400)]
    df = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "k int, i int, v int")
    order = Window.partitionBy("k").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    want = df.withColumn("last", F.last("v", ignorenulls=True).over(order))
    found = carry_last(df, ["k"], [F.desc("i")], F.col("v"), "last", itself)
    assert found.columns == [*df.columns, "last"]
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}
    ranges = _by_range(df, ["k"], ["i"]).groupBy("k", PART).count().groupBy("k").count()
    assert max(r["count"] for r in ranges.collect()) >= 8


def test_slices_of_a_user_with_most_events(spark, sixteen_ranges):
    df = spark.createDataFrame([(1 if i % 3 else 2 + i % 7, i, "AB"[i * i % 7 % 2]) for i in range(1500)], "user_id long, i int, label string")
    order = Window.partitionBy("user_id").orderBy("i")
    numbered = df.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    hist = numbered.where("place <= total div 5 * 5").selectExpr("user_id", "(place - 1) div 5 + 1 as part", "label").distinct()
    found = slices.presence(df, "user_id", ["i"], "label", 5)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in hist.collect()}
    grid = hist.groupBy("user_id").agg(F.max("part").alias("n_parts")).select("user_id", "n_parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_parts"))).alias("part")).crossJoin(hist.select("label").distinct())
    seen = grid.join(hist.withColumn("now", F.lit(True)), ["user_id", "part", "label"], "left").withColumn("before", F.lag("now").over(Window.partitionBy("user_id", "label").orderBy("part")))
    op = F.expr("case when now and before then 'KEEP' when now and part = 1 then 'INIT' when now then 'IN' when before then 'OUT' end")
    want = seen.select("user_id", "part", "label", "n_parts", op.alias("op")).where("op is not null")
    assert {tuple(r) for r in sequences.transitions(found).collect()} == {tuple(r) for r in want.collect()}
