import itertools
import random

import pytest
from pyspark.sql import functions as F
from techtrail.operators import patterns, rules, sequences
from techtrail.plans import histories


def brute_sets(baskets, support):
    items = sorted({x for b in baskets for x in b})
    least = support * len(baskets) - 1e-9
    found = {s: sum(set(s) <= set(b) for b in baskets) for k in range(1, len(items) + 1) for s in itertools.combinations(items, k)}
    return {s: n for s, n in found.items() if n >= least and n}


def brute_rules(sets, n, metric, least):
    made = {}
    for s, freq in sets.items():
        for k in range(1, len(s)):
            for c in itertools.combinations(s, k):
                a = tuple(x for x in s if x not in c)
                values = {"confidence": freq / sets[a], "lift": freq * n / (sets[a] * sets[c])}
                if values[metric] >= least:
                    made[a, c] = (freq, round(values["confidence"], 9), round(values["lift"], 9))
    return made


def as_rules(found):
    return {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["freq"], round(r["confidence"], 9), round(r["lift"], 9)) for r in found.collect()}


def baskets(spark):
    rng = random.Random(4)
    rows = [sorted({x for x in "abcdef" if rng.random() < 0.55} | ({"a", "b"} if rng.random() < 0.5 else set())) for _ in range(120)] + [[], ["z"]]
    return rows, spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "k int, items array<string>")


def test_rules_are_all_rules(spark):
    rows, frame = baskets(spark)
    sets = brute_sets(rows, 0.1)
    for metric, least in (("lift", 0.0), ("lift", 1.05), ("confidence", 0.6)):
        assert as_rules(rules.rules(frame, 0.1, metric, least)) == brute_rules(sets, len(rows), metric, least)


def test_pairs_are_counted_alone(spark):
    rows, frame = baskets(spark)
    sets = {s: n for s, n in brute_sets(rows, 0.1).items() if len(s) <= 2}
    assert {tuple(r["items"]): r["freq"] for r in rules.pair_itemsets(frame, 0.1).collect()} == sets
    assert as_rules(rules.rules(frame, 0.1, "lift", 0.9, longest=2)) == brute_rules(sets, len(rows), "lift", 0.9)


def test_one_basket_of_forty_items(spark):
    """Twenty baskets of the same forty items: mined whole they would have a million million itemsets; their pairs are 780."""
    frame = spark.createDataFrame([([f"i{k:02d}" for k in range(40)],)] * 20, "items array<string>")
    assert rules.rules(frame, 0.5, "lift", 1.0, longest=2).count() == 40 * 39


def test_consequents_of_a_set_of_forty_items(spark):
    """Of forty items two, together and by themselves, follow from the rest; consequents of others do not hold, and are not grown."""
    names = [f"i{k:02d}" for k in range(40)]
    without = lambda *gone: [x for x in names if x not in gone]
    rows = [(names, 90), (without("i00"), 95), (without("i01"), 95), (without("i00", "i01"), 100), (["i00"], 200), (["i01"], 200), (["i00", "i01"], 150)]
    rows += [(without(x), 100_000) for x in names[2:]]
    sets = spark.createDataFrame(rows, "items array<string>, freq long")
    found = rules.rules_of(sets, spark.createDataFrame([(1000,)], "n long"), "confidence", 0.9)
    got = {(len(r["antecedent"]), tuple(r["consequent"])): r["confidence"] for r in found.collect() if len(r["antecedent"]) + len(r["consequent"]) == 40}
    assert got == {(39, ("i00",)): 90 / 95, (39, ("i01",)): 90 / 95, (38, ("i00", "i01")): 0.9}


def test_lists_have_what_matching_finds(spark):
    rng = random.Random(5)
    rows = [(u, p, x) for u in range(40) for p in range(1, rng.randint(2, 7)) for x in "ABCD" if rng.random() < 0.5]
    hist = spark.createDataFrame([*rows, *rows[:20]], "user_id long, part int, label string")
    whole = sequences.named_sequences(hist)
    want = patterns.pattern_sids(patterns.prefixspan(whole, 0.1, 4), whole, "user_id")
    found = patterns.mine_lists(hist, 0.1, 4)
    got = sorted(tuple(r) for r in found.select("pattern", "freq", "user_id").collect())
    assert got == sorted(tuple(r) for r in want.select("pattern", "freq", "user_id").collect())
    assert any(" " in p and "|" in p for p, _, _ in got) and len(got) == len(set(got))


def test_a_history_of_a_third_of_all_slices(spark):
    rows = [(1, p, "AB"[p % 2]) for p in range(1, 400)] + [(u, p, "ABC"[(u + p) % 3]) for u in range(2, 40) for p in range(1, 4)]
    found = patterns.mine_lists(spark.createDataFrame(rows, "user_id long, part int, label string"), 0.3, 2)
    got = {r["pattern"]: r["freq"] for r in found.select("pattern", "freq").distinct().collect()}
    brute = lambda x, y: len({u for u in range(1, 40) if any(a < b for uu, a, i in rows if uu == u and i == x for vv, b, j in rows if vv == u and j == y)})
    assert {k: v for k, v in got.items() if "|" in k} == {f"{x}|{y}": brute(x, y) for x in "ABC" for y in "ABC" if brute(x, y) >= 12}


def test_rows_of_variables_go(spark):
    df = spark.createDataFrame([("X", "Y"), ("X", "b"), ("a", "b"), (None, "b"), ("x", "y")], "x string, y string")
    assert {tuple(r) for r in patterns.drop_variables(df, ["x", "y"]).collect()} == {("a", "b"), (None, "b"), ("x", "y")}
    assert patterns.drop_variables(df, ["x"]).where(F.col("y") == "b").count() == 2


def test_shapes_and_parts_are_as_mining_finds_them(spark):
    rng = random.Random(8)
    rows = [(u, p, x) for u in range(60) for p in range(1, rng.randint(2, 9)) for x in "ABC" if rng.random() < 0.5]
    hist = spark.createDataFrame([*rows, (60, 1, "A"), (60, 5, "B"), (61, 2, "C")], "user_id long, part long, label string")
    trans = sequences.transitions(hist)
    least = 4
    mined = patterns.prefixspan(sequences.tagged_sequences(trans), (least - 0.5) / trans.select("user_id").distinct().count(), 4)
    freq = {r["p"]: r["freq"] for r in mined.select(patterns.pattern_text(F.col("sequence")).alias("p"), "freq").collect()}
    counts = patterns.shape_counts(trans)
    shaped = lambda found: sorted(tuple(r) for r in patterns.select_shapes(found).drop("itemsets").collect())
    want = shaped(mined)
    assert shaped(patterns.mine_shapes(counts, least)) == want and {r[1] for r in want} == {"S1", "S2"}
    sets = F.transform("sequence", lambda s: F.sort_array(s))
    parts = [tuple(r) for r in patterns.mine_parts(trans, counts).select(patterns.pattern_text(F.col("sequence")), patterns.pattern_text(sets), "freq").collect()]
    sorted_parts = {p: n for _, p, n in parts}
    assert len(parts) == len(sorted_parts) and {p: n for p, n in sorted_parts.items() if n >= least} == {p: n for p, n in freq.items() if p in sorted_parts}
    split = patterns.split_pattern(patterns.select_shapes(mined))
    assert {x for r in split.select("a", "ab", "abc", "b", "bc", "bcd", "c", "d").collect() for x in r} <= {p for p, _, _ in parts}
    assert {(r["c"], r["d"]) for r in split.collect()} == {(f"OUT{x}", y) for _, _, x, y, _ in want}  # though A to C come before OUT


@pytest.mark.parametrize("name", ["select_shapes", "split_pattern", "join_nested_lookup", "pattern_measures", "rank_patterns"])
def test_shapes_need_no_other_patterns(spark, monkeypatch, name):
    """Mining all patterns of four items takes thousands of times as many as have the shapes."""
    monkeypatch.setattr(patterns, "prefixspan", None)
    assert histories.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
