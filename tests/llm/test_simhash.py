import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from techtrail.llm import graph, simhash


def brute_fingerprint(text):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, links):
    parent = {x: x for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in ids}


def test_fingerprints_match_brute_force():
    for text in ["", "  \n", "One", "one two", "a b c", "A b C d e f g " * 40, "é ü ß Éa"]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, key int")


def test_components_match_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(5)
    rows, n = [(1000, None, "x", 1), (1001, "", "x", None), (1002, " \n", None, 2), (None, "alone here", "y", 3)], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(120)] = rng.choice(words)
            rows.append((n, " ".join(text), "x", n))
            n += 1
    rows.append(rows[-1])
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    value = {r[0]: brute_fingerprint(r[1] or "") for r in rows if r[0] is not None}
    ids = sorted(value)
    links = [(a, b) for a in ids for b in ids if a < b and (value[a] ^ value[b]).bit_count() <= 3]
    assert len(links) > 20
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == components(ids, links)


def test_no_rows(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_forest_matches_all_pairs():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2, 400), dtype=np.uint64)
    values = np.unique(np.concatenate((values, np.resize(values, 400) ^ flips[0] ^ flips[1])))
    group = np.sort(rng.integers(0, 3, len(values)))
    a, b = simhash.forest(values, group, simhash.reference_fingerprints(), most=100)
    names = list(enumerate(group.tolist()))
    place = {(int(v), g): i for i, (v, g) in enumerate(zip(values, group.tolist(), strict=True))}
    group_of = {int(v): g for v, g in zip(values, group.tolist(), strict=True)}
    links = [(i, j) for i, g in names for j, h in names if i < j and g == h and (int(values[i]) ^ int(values[j])).bit_count() <= 3]
    edges = [(place[int(x), group_of[int(x)]], place[int(y), group_of[int(y)]]) for x, y in zip(a, b, strict=True)]
    assert components(range(len(values)), links) == components(range(len(values)), edges)
    assert len(edges) < len(values)


def test_crowded_keys_are_dealt_again_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    rng = random.Random(1)
    base = rng.getrandbits(63)
    values = {base} | {base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(150)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.near_edges(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = components(signed, links)
    assert {x: found.get(x, x) for x in signed} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def test_exploded_keys_are_not_broadcast(spark):
    """Spark sizes them by the table before, which is a twentieth of them and may be small enough to be broadcast."""
    distinct = spark.range(4000).select(F.xxhash64("id").alias("fingerprint"))
    plan = simhash._dealt(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
