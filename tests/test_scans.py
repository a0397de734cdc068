import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from techtrail.operators import bloom, literals, scan


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\bthe\b", ["the"]), ("All rights|Licensed under", ["All rights", "Licensed under"]), ("token *=", ["token"]), ("[0-9a-f]{24,}", None), ("a|bcd", None),
        (r"import (?:javax?)\.sql\.", ["import java"]), (r"(?:abc)+x", ["abc"]), (r"(abcd)?xy", ["xy"]), (r"org\.(foo|barbaz)", ["org."]), (r"x(?=longest)yz", ["xyz"]), ("[[a]bcdef]", None), ("(?i)word", None), ("^$", None), (r"a\p{L}bc", None), ("", None),
    ],
)
def test_required_literals(pattern, want):
    assert literals.required(pattern) == want


def test_required_without_case():
    assert literals.required("(?i)Word", True) == ["word"] and literals.required("WoRd", True) == ["word"] and literals.required("Größe", True) is None


@pytest.mark.parametrize(("pattern", "want"), [(r"\bx$", True), ("^[0-9]+", True), ("(?=x)y", False), (r"a(?!b)", False), (r"\Aab", False), ("(?:a++)b", False), (r"(a|b\Z)", False), ("(", False)])
def test_expressions_that_hold_for_texts(pattern, want):
    assert literals.holds_for_texts(pattern) == want


piece = st.recursive(
    st.sampled_from(["a", "b", "ab", "[ab]", ".", r"\b", "^", "$", "[^a]", r"\w", "c"]),
    lambda inner: st.one_of(st.lists(inner, min_size=1, max_size=4).map("".join), st.lists(inner, min_size=2, max_size=3).map(lambda x: f"(?:{'|'.join(x)})"), inner.map(lambda x: f"(?:{x})?"), inner.map(lambda x: f"(?:{x}){{1,2}}"), inner.map(lambda x: f"({x})")),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(piece, st.text("abc \n", max_size=12))
def test_whatever_matches_has_a_literal(pattern, text):
    found = literals.required(pattern, least=1)
    for line in text.split("\n"):
        if re.search(pattern, line):
            assert found is None or any(x in line for x in found)
            assert not literals.holds_for_texts(pattern) or re.search(f"(?m)(?:{pattern})", text)


HEURISTICS = [("the", "a", [r"\bthe\b"]), ("(IgnoreCase) With", "b", ["^with"]), ("hex", "b", ["[0-9a-f]{6,}$", "token"]), ("around", "c", ["x(?!y)"]), ("java", "c", [r"\p{Lu}{3}"]), ("empty", "d", ["^$"]), ("blank", "d", [r"\s$"]), ("end", "d", ["[c]$"])]
TEXTS = ["the\nWith you\nxx", "none", "abcdef\nabcdefg", "abcdef", "", None, "a token\nwiTH", "\nxy\n\nABC xy", "x", "abc\n", "abc\r\nx", "abc\rx\n", "c\u2028"]


def test_texts_give_the_hits_of_their_lines(spark):
    files = spark.createDataFrame([(f"p{i % 2}", f"f{i}", x) for i, x in enumerate(TEXTS)], "project string, path string, text string")
    lines = files.where("text is not null").select("project", "path", F.posexplode(F.split("text", "\n")).alias("at", "line")).selectExpr("project", "path", "at + 1 as line_no", "line")
    want = scan.scan(lines, HEURISTICS)
    found = scan.scan_texts(files, HEURISTICS)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    chosen = spark.createDataFrame([("p0", "the"), ("p0", "hex"), ("p1", "around")], "project string, label string")
    own = scan.scan_selected(files, HEURISTICS, chosen)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.join(chosen, ["project", "label"]).select(*want.columns).collect()))


def test_pending_executions_are_run_once(spark):
    files = spark.createDataFrame([(i % 3, f"f{i}", x) for i, x in enumerate(TEXTS)], "version int, path string, text string")
    done = spark.createDataFrame([(0, x[0]) for x in HEURISTICS] + [(1, "the"), (9, "the")], "version int, label string")
    run = scan.run_pending(done, HEURISTICS, files, "version")
    hits = {(r["version"], r["label"]): (r["hits"], r["files"]) for r in run.collect()}
    every = scan.scan_texts(files, HEURISTICS).groupBy("version", "label").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
    want = {(r["version"], r["label"]): (r["n"], r["files"]) for r in every.collect()}
    assert hits == {(v, x[0]): want.get((v, x[0]), (0, 0)) for v in (1, 2) for x in HEURISTICS if (v, x[0]) != (1, "the")}
    assert any(x == (0, 0) for x in hits.values())
    status = scan.scan_status(run, done, len(HEURISTICS), files.select("version").distinct())
    assert {tuple(r) for r in status.collect()} == {("Success", 15), ("Skipped", 9), ("Total", 24)}


def test_scoped_words(spark):
    lines = spark.createDataFrame([("p", "f", 1, "new Foo(x, My File, y)"), ("p", "f", 2, "Foo.Bar Foo"), ("q", "g", 1, "Foo My File"), ("p", "g", 3, "FooBar my My  File"), ("p", "g", 4, "a$b,Café"), ("p", "g", 5, " x")], "project string, path string, line_no int, line string")
    stems = spark.createDataFrame([("p", "Foo"), ("p", "Foo"), ("p", "My File"), ("p", "a$b"), ("q", "Bar"), ("p", ""), ("p", None), ("p", " x"), ("p", "Café")], "project string, stem string")
    found = scan.scan_scoped(lines, stems)
    want = lines.join(stems.where("stem <> ''").distinct(), "project").where(F.expr("line rlike ('(\\\\s|[.,(]|^)' || '\\\\Q' || stem || '\\\\E' || '(\\\\s|[.,(]|$)')")).select("project", "path", "line_no", "stem")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {r["stem"] for r in found.collect()} == {"Foo", "My File", "a$b", " x", "Café"}


def test_words_are_filtered_before_they_are_moved(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.createDataFrame([("p", "f", 1, "new Foo")], "project string, path string, line_no int, line string")
        scan.scan_scoped(lines, spark.createDataFrame([("p", "Foo")], "project string, stem string")).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert -1 < plan.index("SortMergeJoin [project") < plan.index("Exchange hashpartitioning(project") < plan.index("BroadcastNestedLoopJoin")  # from the result down to the scan
    assert "line#" not in plan[: plan.index("BroadcastNestedLoopJoin")].split("SortMergeJoin")[1]


def test_bloom_filter_lets_all_keys_pass_and_few_others(spark):
    keys, bits = spark.range(0, 4000).withColumn("k", F.col("id") * 7), 1 << 16
    words = bloom.bloom_filter(keys, F.col("k"), bits)
    passed = spark.range(0, 40000).crossJoin(words).where(bloom.may_contain(F.col("words"), F.col("id"), bits)).select("id")
    ids = {r["id"] for r in passed.collect()}
    assert {7 * i for i in range(4000)} - ids == {x for x in range(28000, 0, 7)}
    assert len(ids) < 4000 + 2000


def test_first_level(spark):
    hits = spark.createDataFrame([("o/n", "b", "src/Foo.java", 1), ("o/n", "a", "src/Foo.java", 2), ("o/n", "a", "x/Foo.java", 1), ("o/n", "a", "pom.xml", 1), ("o/n", "b", "Bar.java", 1), ("z/z", "b", "Baz.java", 1)], "project string, label string, path string, line_no int")
    files = spark.createDataFrame([("o/n", "src/Foo.java", "1\n2\n3"), ("o/n", "Bar.java", "1")], "project string, path string, text string")
    rows = scan.first_level(hits, files, ".java")
    got = {(r["label"], r["path"]): (r["status"], r["lines"]) for r in rows.collect()}
    assert got == {("a", "src/Foo.java"): ("opened", 3), ("b", "src/Foo.java"): ("duplicated", None), ("a", "x/Foo.java"): ("opened", None), ("a", "pom.xml"): ("other extension", None), ("b", "Bar.java"): ("opened", 1), ("b", "Baz.java"): ("opened", None)}
    one = sorted((r["file"], r["line_no"], r["pattern"]) for r in scan.first_level_files(rows).collect())
    pattern = lambda x: rf"(\s|[.,(]|^){x}(\s|[.,(]|$)"
    assert one == [("o.n.txt", 1, pattern("Foo")), ("o.n.txt", 2, pattern("Bar")), ("z.z.txt", 1, pattern("Baz"))]
    assert sorted(r["file"] for r in scan.first_level_files(rows, multiple=True).collect()) == ["o.n.1.txt", "o.n.2.txt", "z.z.1.txt"]
    every = scan.first_level(hits, files, ".java", duplicates=True)
    assert every.where("status = 'opened'").count() == 5 and scan.first_level_files(every, duplicates=True).count() == 5
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    status = scan.first_level_status(rows, hits.select("project"), labels)
    assert {tuple(r) for r in status.collect()} == {("Total", 6), ("Opened", 4), ("Duplicated", 1), ("Not extension", 1), ("None", 3)}
