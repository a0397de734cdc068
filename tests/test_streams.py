import pytest
from pyspark.sql import functions as F
from techtrail.operators import sequences
from techtrail.plans import files, histories
from techtrail.streaming import jobs, runs

LINES = "project string, path string, version string, line_no int, line string"
HEURISTICS = [("h", "database", ["hit"]), ("i", "database", ["it$"])]


def batches(spark, schema, *rows):
    return [spark.createDataFrame(x, schema) for x in rows]


def scanned(spark, folder, schema, waves, late=None):
    """Runs the scan once for each wave, as its feed brings it."""
    source, found, progress = (f"file://{folder}/{x}" for x in ("in", "out", "progress"))
    states = []
    for rows in waves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = jobs.run_available(jobs.scan_stream(spark.readStream.schema(schema).parquet(source), HEURISTICS, late), found, progress)
        states.append([p for p in query.recentProgress if p["numInputRows"]][0])
    return jobs.hits_of(spark, found), states


def test_lines_are_scanned_once(spark, tmp_path):
    waves = [
        [("p", "f", "1", 1, "hit"), ("p", "f", "1", 3, "none"), ("q", "f", "1", 1, "hit too")],  # one path in two projects
        [("p", "f", "1", 2, "a hit here"), ("p", "f", "1", 2, "a hit here")],  # the rest of a file, twice
        [("p", "f", "1", 1, "hit"), ("p", "g", "1", 1, "hit"), ("p", "f", "2", 1, "hit")],  # a line again, and a version that has changed
    ]
    found, _ = scanned(spark, tmp_path, LINES, waves)
    want = [("p", "f", "1", 1, "h"), ("p", "f", "1", 1, "i"), ("p", "f", "1", 2, "h"), ("p", "f", "2", 1, "h"), ("p", "f", "2", 1, "i"), ("p", "g", "1", 1, "h"), ("p", "g", "1", 1, "i"), ("q", "f", "1", 1, "h")]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_the_work_of_a_batch_is_its_own(spark, tmp_path):
    waves = [[(f"p{i % 3}", f"f{k}", "1", i, "hit") for i in range(50)] + [("p0", f"f{k - 1}", "1", 0, "hit")] for k in range(6)]
    found, states = scanned(spark, tmp_path, LINES, waves)
    assert found.where("label = 'h'").count() == 6 * 50 + 1
    assert {p["numInputRows"] for p in states} == {51}
    own = [s["stateOperators"][0]["numRowsUpdated"] for s in states]
    assert own == [51, 50, 50, 50, 50, 50]  # lines that are new, whatever has been seen before
    assert "rocksdbGetCount" in str(states[0]["stateOperators"][0]["customMetrics"])


def test_seen_lines_are_forgotten_after_a_while(spark, tmp_path):
    row = lambda line, day: ("p", "f", "1", line, "hit", f"2024-01-{day:02d}")
    waves = [[[*r[:5], __import__("datetime").datetime.fromisoformat(r[5])] for r in wave] for wave in ([row(1, 1), row(2, 1)], [row(1, 2), row(3, 20)], [row(4, 20), row(4, 20)])]
    found, states = scanned(spark, tmp_path, LINES + ", ts timestamp", waves, "5 days")
    assert sorted(r["line_no"] for r in found.where("label = 'h'").collect()) == [1, 2, 3, 4]
    assert states[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_spans():
    assert runs.spans(0, 4) == [] and runs.spans(3, 4) == [(0, 1), (1, 1), (2, 1)] and runs.spans(4, 4) == [(0, 4)]
    assert runs.spans(4 * 16 + 2 * 4 + 1, 4) == [(0, 64), (64, 4), (68, 4), (72, 1)]
    for n in range(200):
        assert sum(size for _, size in runs.spans(n, 3)) == n


VERDICTS = "k int, turn int, v string"


def verdicts(spark, path, n, fan=3):
    sink = jobs.stream_verdicts(VERDICTS, path, ["k"], ["turn"], fan)
    for number in range(n):
        sink(spark.createDataFrame([(number % 4, number, f"v{number}"), (9, -number, "old")], VERDICTS), number)
    return sink


def best(spark, path, last, fan=3):
    return {tuple(r) for r in jobs.latest_of(spark, path, last, VERDICTS, ["k"], ["turn"], fan).collect()}


def test_verdicts_of_many_batches_are_in_few_files(spark, tmp_path):
    path, n = f"file://{tmp_path}/v", 20
    verdicts(spark, path, n)
    want = {(x % 4, x, f"v{x}") for x in range(n - 4, n)} | {(9, 0, "old")}
    assert best(spark, path, n - 1) == want
    opened = runs.run_paths(spark, path, n, 3)
    assert len(opened) == 4  # 20 = 2 * 9 + 2: two merged runs, and batches 18 and 19
    assert sum(1 for x in tmp_path.glob("v/run-*")) <= 20
    with pytest.raises(ValueError, match="by itself"):
        best(spark, path, 4)


def test_a_merge_that_is_interrupted_loses_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    verdicts(spark, path, 3)
    sink = jobs.stream_verdicts(VERDICTS, path, ["k"], ["turn"], 3)
    sink(spark.createDataFrame([(7, 7, "x")], VERDICTS), 3)  # merges batches 0 to 2
    want = best(spark, path, 3)
    (tmp_path / "v" / "run-0000000000-3" / "_SUCCESS").unlink()  # as if it had ended before the mark
    assert best(spark, path, 3) == want
    sink(spark.createDataFrame([(7, 7, "x")], VERDICTS), 3)  # the batch runs again, and so does the merge
    assert best(spark, path, 3) == want and (tmp_path / "v" / "run-0000000000-3" / "_SUCCESS").exists()


def test_feed_has_what_a_batch_has_changed(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    one, two = batches(spark, VERDICTS, [(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], [(1, 2, "b"), (2, 5, "y"), (3, 1, "z")])
    sink = jobs.stream_verdicts(VERDICTS, path, ["k"], ["turn"])
    sink(one, 0), sink(two, 1)
    feed = lambda k: {tuple(r) for r in jobs.feed_of(spark, path, k, VERDICTS, ["k"], ["turn"]).collect()}
    assert feed(0) == {(1, 3, "c"), (2, 1, "x")} and feed(1) == {(2, 5, "y"), (3, 1, "z")}
    assert {tuple(r) for r in jobs.latest_of(spark, path, 1, VERDICTS, ["k"], ["turn"]).collect()} == {(1, 3, "c"), (2, 5, "y"), (3, 1, "z")}


def test_slices_that_come_in_three_batches(spark, tmp_path):
    schema = "project long, part long, label string, ts timestamp"
    parts = {1: {1: "A", 2: "AB", 3: "B", 4: "BC", 5: "C", 6: "AC"}, 2: {1: "Z", 2: "Y", 3: "XYZ"}}
    rows = [(p, k, x) for p, of in parts.items() for k, items in of.items() for x in items]
    hist = spark.createDataFrame(rows, "project long, part long, label string")
    want = {tuple(r) for r in sequences.transitions(hist, "project").select("project", "part", "label", "op").collect()}
    state, changes, source, progress = (f"file://{tmp_path}/{x}" for x in ("s", "c", "in", "progress"))
    sink, query = jobs.stream_transitions(state, changes, 2), None
    timed = hist.withColumn("ts", F.timestamp_seconds(F.col("part") * 86400)).withColumn("wave", F.expr("(part - 1) div 2 + ascii(label) % 3"))
    clock = spark.createDataFrame([(None, None, None, 40)], "project long, part long, label string, day int").selectExpr("project", "part", "label", "timestamp_seconds(day * 86400) as ts")
    late = spark.createDataFrame([(1, 2, "Q")], "project long, part long, label string").withColumn("ts", F.timestamp_seconds(F.lit(2 * 86400)))
    for k in range(6):
        wave = timed.where(F.col("wave") == k).drop("wave")
        wave = wave.unionByName(clock) if k == 4 else late if k == 5 else wave
        wave.write.mode("append").parquet(source)
        query = jobs.run_available(jobs.closed_slices(spark.readStream.schema(schema).parquet(source), "5 days"), sink, progress)
    found = jobs.transitions_of(spark, changes, jobs.last_number(query))
    assert found.count() == len(want) and {tuple(r) for r in found.collect()} == want


def test_slices_of_a_long_history_come_late(spark, tmp_path):
    """Labels that come a wave after the others belong to slices that are still open, however long the longest history is."""
    rows = [(u, u * 1000 + k, k, "abcde"[(k * k // 7 + u) % 5]) for u, n in ((1, 125), (2, 60), (3, 260)) for k in range(n)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, at long, event_type string")
    events.select("user_id", "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = files.stream_transitions(spark, str(tmp_path)).select("project", "part", "label", "op").collect()
    want = histories.transitions(spark, str(tmp_path)).select("user_id", "part", "label", "op").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == {tuple(r) for r in want}
