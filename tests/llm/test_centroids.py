import hashlib

import duckdb
import numpy as np
import pytest
from techtrail.llm import centroids

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, ids int, words int"


def brute(rows, size, k, rounds):
    """Lloyd's rounds in whole numbers of any size. rows: (id, components)."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(points))

    for _ in range(rounds):
        own = [[] for _ in points]
        for _, v in kept:
            own[place(v)[1]].append(v)
        points = [[sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else points[n] for n, mine in enumerate(own)]
    return sorted((repr(i), place(v)[1], place(v)[0]) for i, v in kept), points


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA)
    placed, points = centroids.cluster_vectors(frame, **more)
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in placed.collect()), points.tolist()


def test_rounds_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 500)]  # copies
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 5 + [None]), (604, [1.0] * 5 + [float("nan")]), (605, [float("-inf")] * 6)]
    for chunk in (64, 1 << 16):
        assert found(spark, rows, size=6, k=8, rounds=10, chunk=chunk) == brute(rows, 6, 8, 10)


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [0.5, -0.5]) for i in range(20)]
    assert found(spark, rows, size=2) == brute(rows, 2, 8, 10)
    assert {r[1] for r in found(spark, rows, size=2)[0]} == {0}


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert found(spark, rows, size=2) == brute(rows, 2, 8, 10)
    assert found(spark, [(1, [1.0])], size=2) == ([], [])
    assert found(spark, [], size=2) == ([], [])


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x), -1.0]) for i, x in enumerate([1e6, 1.5e6, 2e5, 131072.5, -1e6, 3.0, -7e5, 2.0, 1.0, 0.0])]
    assert found(spark, rows, size=2, k=3) == brute(rows, 2, 3, 10)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e30, 0.0])], size=2)


def test_dictionaries_are_lossless_and_widen():
    rng = np.random.default_rng(1)
    for matrix in (rng.integers(-900, 900, (500, 64)), rng.integers(0, 2, (4, 64)).repeat(300, axis=0), rng.integers(-(1 << 52), 1 << 52, (50, 7)), np.zeros((3, 1), np.int64)):
        blocks = centroids.encode(matrix)
        assert (centroids.decode(blocks) == matrix).all()
        assert all(len(np.unique(words, axis=0)) == len(words) for words, _ in blocks)
    assert len(centroids.encode(rng.integers(0, 2, (4, 64)).repeat(300, axis=0))) == 1  # few different vectors: one dictionary of whole vectors
    assert len(centroids.encode(rng.integers(-900, 900, (500, 64)))) == 32


def test_chunks_hold_the_vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = {r["vec_id"]: centroids.quantised(np.array(r["embedding"])).tolist() for r in rows.collect()}
    got = {}
    for batch in centroids.store_chunks(rows, chunk=33).toArrow().to_batches():
        for ids, blocks in centroids._blocks(batch):
            got |= dict(zip(ids.to_pylist(), centroids.decode(blocks).tolist(), strict=True))
    assert got == want


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    wanted = duck.execute(centroids.ORACLE_SQL)
    columns = [x[0] for x in wanted.description]
    rows = centroids.op11_subvector_centroids(spark, SMALL)
    assert set(rows.columns) == set(columns)
    assert sorted(tuple(r) for r in rows.select(*columns).collect()) == sorted(wanted.fetchall())
