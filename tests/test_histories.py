import random

import duckdb
import pytest
from pyspark.sql import functions as F
from techtrail.operators import patterns, sequences, slices

WORKED = {1: "A", 2: "AB", 3: "B", 4: "BC", 5: "C", 6: "AC"}


def history(spark, parts, project=1):
    return spark.createDataFrame([(project, p, x) for p, items in parts.items() for x in items], "user_id long, part int, label string")


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_worked_example(spark):
    trans = sequences.transitions(history(spark, WORKED))
    assert rows(trans, "part", "label", "op") == {
        (1, "A", "INIT"), (2, "A", "KEEP"), (2, "B", "IN"), (3, "A", "OUT"), (3, "B", "KEEP"), (4, "B", "KEEP"), (4, "C", "IN"), (5, "B", "OUT"), (5, "C", "KEEP"), (6, "A", "IN"), (6, "C", "KEEP"),
    }
    assert rows(patterns.substitution_cases(trans), "pattern", "x", "y") == {("S2", "A", "B"), ("S2", "B", "C")}
    assert rows(patterns.depth(trans), "label", "times", "inserted", "removed") == {("A", 1, 1, 1), ("A", 2, 1, 0), ("B", 1, 1, 1), ("C", 1, 1, 0)}
    kept = patterns.retention(trans).where("never_removed = 1")
    assert rows(kept, "label") == {("C",)}
    assert rows(patterns.life(trans).where("in_last"), "label") == {("A",), ("C",)}


def test_s1(spark):
    trans = sequences.transitions(history(spark, {1: "A", 2: "B", 3: "B"}))
    assert rows(patterns.substitution_cases(trans), "pattern", "x", "y") == {("S1", "A", "B")}
    assert rows(patterns.substitution_cases(trans, adjacent=True), "pattern", "x", "y") == {("S1", "A", "B")}


def test_adjacent_is_stricter(spark):
    trans = sequences.transitions(history(spark, {1: "A", 2: "AB", 3: "AB", 4: "B"}))
    assert rows(patterns.substitution_cases(trans), "pattern", "x", "y") == {("S2", "A", "B")}
    assert rows(patterns.substitution_cases(trans, adjacent=True), "pattern", "x", "y") == set()


def test_slicing(spark):
    commits = spark.createDataFrame([(1, i) for i in range(1, 12)], "p int, i int")
    assert rows(slices.slice_every(commits, "p", ["i"], 5), "i", "part") == {(5, 1), (10, 2)}
    assert [r["i"] for r in slices.slice_proportional(commits, "p", ["i"], 4).orderBy("i").collect()] == [2, 4, 6, 8, 10]
    assert slices.slice_proportional(commits, "p", ["i"], 0).count() == 11
    assert rows(slices.mark_last(commits, "p", ["i"]).where("is_last"), "i") == {(11,)}


@pytest.mark.parametrize(("n", "middle"), [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)])
def test_middle_slice(spark, n, middle):
    parts = history(spark, {p: "A" for p in range(1, n + 1)})
    assert rows(slices.pick_slice(parts, "user_id", "middle"), "part") == {(middle,)}
    assert rows(slices.pick_slice(parts, "user_id", "last"), "part") == {(n,)}


def test_at_least_to_exact(spark):
    counts = spark.createDataFrame([("x", 1, 10), ("x", 2, 4), ("x", 3, 2), ("x", 4, 1)], "label string, times int, inserted long")
    assert rows(patterns.at_least_to_exact(counts, ["inserted"]), "times", "inserted") == {(1, 6), (2, 2), (3, 1), (4, 1)}


def test_sequences(spark):
    hist = history(spark, {1: "BA", 3: "C"})
    named = sequences.named_sequences(hist).select(patterns.pattern_text(F.col("sequence"))).first()[0]
    assert named == "A B||C"
    tagged = sequences.sequence_text(sequences.tagged_sequences(sequences.transitions(hist))).first()["text"]
    assert tagged == "A B INITA INITB -1 OUTA OUTB -1 C INC -1 -2"


def test_contains_pattern(spark):
    row = spark.createDataFrame([([["a"], ["a", "b"], ["c"]],)], "s array<array<string>>")
    literal = lambda sets: F.array(*(F.array(*map(F.lit, x)) for x in sets))
    for sets, held in (([["a"], ["b"]], True), ([["b"], ["a"]], False), ([["a", "b"], ["c"]], True), ([["c"], ["c"]], False), ([["a"], ["a"], ["c"]], True)):
        assert row.select(patterns.contains_pattern(F.col("s"), literal(sets))).first()[0] is held


def test_replacement_figures(spark):
    """Adoption figures as published for one label: 137 inserted, 41 removed, 20 and 4 again."""
    counts = spark.createDataFrame([("m", 1, 137, 41), ("m", 2, 20, 4)], "label string, times int, inserted long, removed long")
    row = patterns.balance(counts).first()
    assert (row["adoption"], row["removals"], row["still"]) == (137, 41, 112)


def test_commit_dates(spark):
    df = spark.createDataFrame([("Tue, 3 May 2022 10:00:00 +0200",), ("Tue May 3 10:00:00 2022 +0200",), ("nonsense",)], "d string")
    found = [r[0] for r in df.select(slices.parse_commit_ts(F.col("d")).cast("string")).collect()]
    assert found == ["2022-05-03 08:00:00", "2022-05-03 08:00:00", None]


def test_properties(spark):
    """Insertions less removals are what is there at the end; depths never rise; nothing replaces itself."""
    from techtrail.plans import bindings

    trans = sequences.transitions(bindings.history(spark, "/root/testdata/sf0.001"))
    assert patterns.life(trans).where("n_in - n_out <> cast(in_last as int)").count() == 0
    assert patterns.at_least_to_exact(patterns.depth(trans, 20), ["inserted", "removed"]).where("inserted < 0 or removed < 0").count() == 0
    assert patterns.substitution_cases(trans).where("x = y").count() == 0


def test_rows_of_replacement_patterns(spark):
    """A pattern's own row counts each project once; it goes, and labels that are called X and Y stay."""
    hist = history(spark, {1: "XA", 2: "YB", 3: "YB"}).unionByName(history(spark, {1: "X", 2: "Y", 3: "Y"}, 2))
    found = patterns.substitution_rows(sequences.transitions(hist))
    pairs = {("S1", "X", "Y", 2), ("S1", "X", "B", 1), ("S1", "A", "Y", 1), ("S1", "A", "B", 1)}
    assert rows(found, "pattern", "x", "y", "unbound", "line_count") == {(p, x, y, None, n) for p, x, y, n in pairs} | {("S1", None, None, "X", 2)}
    assert rows(patterns.drop_variables(found, ["unbound"]), "pattern", "x", "y", "line_count") == pairs


def test_meta_rules_are_dropped_from_all_substitutions(spark, tmp_path):
    """The query counts replacements, on odd events too: labels named like variables, none, empty ones, no user, no time, equal times."""
    from techtrail.plans import registry

    draw = random.Random(5)
    drawn = [(i, draw.choice([None, *range(9)]), draw.choice([None, 1, *range(8)]), draw.choice(["X", "Y", "x", "", None, "X = a; Y", "é"])) for i in range(900)]
    events = spark.createDataFrame(drawn, "event_id long, at long, user_id long, event_type string").select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    sql = registry.oracle_sql()["drop_meta_rules"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duck.execute(f"SELECT pattern, x, y, line_count FROM ({sql})").fetchall()
    assert rows(registry.queries()["drop_meta_rules"](spark, str(tmp_path)), "pattern", "x", "y", "line_count") == set(want)
    assert {("X", "Y"), ("", "X")} <= {(x, y) for _, x, y, _ in want}
    small = "/root/testdata/sf0.001"
    assert rows(registry.queries()["drop_meta_rules"](spark, small), "pattern", "x", "y", "line_count") == rows(registry.queries()["substitution"](spark, small), "pattern", "x", "y", "line_count")
