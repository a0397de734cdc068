"""Clusters of vectors around exact integer centroids, over dictionaries of subvectors.

Vectors are stored once as chunks. A chunk cuts the dimensions into blocks and keeps, of each block, the distinct
subvectors and a code for each vector, from which the vectors can be made again exactly. In a round each distinct subvector's
squared distances to the centroids are computed once, and a vector's distances are the sums of those of its codes. A round
reads the chunks and moves a row of sums for each cluster and task; centroids (a few times the number of dimensions)
are all that the driver holds. No vector is moved between tasks, so copies of one vector are no one's burden: they make their chunk's dictionaries small.

Blocks have WIDTH dimensions at first. Neighbours become one block where their common dictionary has at most half as many subvectors as the chunk has vectors, and a
round gets cheaper: a block costs its distinct subvectors times its width, for distances, and a look-up for each vector.

Arithmetic is exact: in 64 bits where no sum can reach them, in whole numbers of any size elsewhere.

Defined cases: vectors that are null, of another number of components, or with a component that is null or not finite are left out. A null id is
kept, and comes last among the starts; equal ids and equal vectors each keep their row, and starts of equal hash are ordered by their components. Fewer vectors than clusters:
each is a start. No vectors: no rows. A component of 2**53 / scale or more, or a distance beyond 63 bits, raises an error, since the result's type can't hold it. Only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from techtrail.llm.common import stash

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3

#: Dimensions of a block at first.
WIDTH = 2

#: Vectors of a chunk, at most.
CHUNK = 1 << 16

#: Components below this in size can be squared and added up in 64 bits, whatever the number of dimensions (up to 256).
NARROW = 1 << 26

PLACES = StructType([StructField("cluster", IntegerType()), StructField("distance", LongType())])


def usable(vector: str, size: int) -> Column:
    """Whether a vector has so many components, all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == size) & ~F.coalesce(bad, F.lit(False))


def quantised(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit whole numbers."""
    made = np.floor(values.astype(np.float64) * scale)
    if made.size and np.abs(made).max() >= 1 << 53:
        raise ValueError("a component is too large for exact whole numbers")
    return made.astype(np.int64)


def _narrowest(values: np.ndarray) -> np.ndarray:
    """Values in the smallest type that holds them."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix and each row's code."""
    if rows.shape[1] == 1:
        found, codes = np.unique(rows[:, 0], return_inverse=True)
        return found[:, None], codes
    low = rows.min(axis=0)
    spans = [int(x) + 1 for x in rows.max(axis=0) - low]
    if np.prod(spans, dtype=object) < 1 << 62:  # rows as numbers of mixed base: quicker than comparing rows
        key = np.zeros(len(rows), np.int64)
        for j, span in enumerate(spans):
            key = key * span + (rows[:, j] - low[j])
        _, first, codes = np.unique(key, return_index=True, return_inverse=True)
        return rows[first], codes
    found, codes = np.unique(rows, axis=0, return_inverse=True)
    return found, codes.ravel()


def encode(vectors: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of a matrix of whole numbers, in the order of the dimensions: (distinct subvectors, a code for each row)."""
    n, size = vectors.shape
    blocks = [_distinct(vectors[:, i : i + width]) for i in range(0, size, width)]
    cost = lambda words: len(words) * words.shape[1] + n
    merged = True
    while merged and len(blocks) > 1:
        merged, wider = False, []
        for i in range(0, len(blocks), 2):
            pair = blocks[i : i + 2]
            if len(pair) == 2:
                (a, ca), (b, cb) = pair
                _, first, codes = np.unique(ca.astype(np.int64) * len(b) + cb, return_index=True, return_inverse=True)
                both = np.concatenate((a[ca[first]], b[cb[first]]), axis=1)
                if 2 * len(both) <= n and cost(both) < cost(a) + cost(b):
                    wider.append((both, codes))
                    merged = True
                    continue
            wider += pair
        blocks = wider
    return blocks


def decode(blocks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The matrix that was encoded."""
    return np.concatenate([words[codes] for words, codes in blocks], axis=1)


def _table(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Squared distances of a block's subvectors to the centroids' parts in that block."""
    large = max((int(np.abs(x).max()) for x in (words, part) if x.size), default=0) >= NARROW
    if large:
        words, part = words.astype(object), part.astype(object)
    return sum((words[:, None, j] - part[None, :, j]) ** 2 for j in range(part.shape[1]))


def nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (of equally near ones the first) and its squared distance: sums of the blocks' tables by code."""
    at, total = 0, None
    for words, codes in blocks:
        table = _table(words, centroids[:, at : at + words.shape[1]])
        at += words.shape[1]
        part = table[codes]
        total = part if total is None else total + part
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def sums_by_cluster(blocks: list[tuple[np.ndarray, np.ndarray]], cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors: a code counts once for each cluster, however many vectors have it."""
    made = []
    for words, codes in blocks:
        used, times = np.unique(codes * k + cluster, return_counts=True)
        sums = np.zeros((k, words.shape[1]), object)
        code, of = used // k, used % k
        for c in range(k):
            own = of == c
            values, n = words[code[own]], times[own]
            large = values.size and int(np.abs(values).max()) >= NARROW
            sums[c] = (values.astype(object) if large else values.astype(np.int64)).T.dot(n.astype(object) if large else n) if own.any() else 0
        made.append(sums)
    return np.concatenate(made, axis=1)


def _vectors(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """The matrix of a batch's embedding column."""
    flat = batch.column(1).flatten()
    return quantised(flat.to_numpy(zero_copy_only=False), scale).reshape(batch.num_rows, -1)


def _chunks(batches: Iterator[pa.RecordBatch], scale: int, width: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its ids, and of its blocks the widths, the words and the codes."""

    def made(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        blocks = encode(np.concatenate(parts), width)
        binary = lambda arrays: pa.array([[_narrowest(x).tobytes() for x in arrays]], pa.list_(pa.binary()))
        whole = lambda values: pa.array([[int(x) for x in values]], pa.list_(pa.int32()))
        columns = [whole([words.shape[1] for words, _ in blocks]), whole([len(words) for words, _ in blocks]), binary([words for words, _ in blocks]), binary([codes for _, codes in blocks])]
        held = pa.concat_arrays(ids)
        listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        return pa.RecordBatch.from_arrays([listed, *columns], names=["ids", "widths", "sizes", "words", "codes"])

    ids, parts, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        matrix, begin = _vectors(batch, scale), 0
        while begin < len(matrix):
            take = min(chunk - n, len(matrix) - begin)
            ids.append(batch.column(0).slice(begin, take))
            parts.append(matrix[begin : begin + take])
            n, begin = n + take, begin + take
            if n == chunk:
                yield made(ids, parts)
                ids, parts, n = [], [], 0
    if n:
        yield made(ids, parts)


def store_chunks(vectors: DataFrame, scale: int = SCALE, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Chunks of vectors (vec_id, embedding), all usable and of one size."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    schema = f"ids array<{rows.schema['vec_id'].dataType.simpleString()}>, widths array<int>, sizes array<int>, words array<binary>, codes array<binary>"
    return rows.mapInArrow(lambda batches: _chunks(batches, scale, width, chunk), schema)


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(data) // n]).astype(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    """ids and blocks of each chunk in a batch."""
    for i in range(batch.num_rows):
        ids, widths, sizes, words, codes = (batch.column(j)[i] for j in range(5))
        n = len(ids.values)
        of = zip(widths.as_py(), sizes.as_py(), words.values, codes.values, strict=True)
        yield ids.values, [(_read(w.as_buffer(), size * width).reshape(size, width), _read(c.as_buffer(), n)) for width, size, w, c in of]


def _sums(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), object)
        for batch in batches:
            for _, blocks in _blocks(batch):
                cluster, _ = nearest(blocks, centroids)
                counts += np.bincount(cluster, minlength=k)
                sums += sums_by_cluster(blocks, cluster, k)
        if counts.any():
            flat = pa.array([Decimal(int(x)) for x in sums.ravel()], pa.decimal128(38, 0))
            listed = pa.ListArray.from_arrays(pa.array(range(0, k * size + 1, size), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), listed], names=["cluster", "n", "sums"])

    return run


def moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: of each cluster the floors of its components' means; those without vectors stay."""
    part = chunks.mapInArrow(_sums(centroids), "cluster int, n long, sums array<decimal(38,0)>")
    total = lambda c: F.sum(c).cast("decimal(38,0)")
    rows = part.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(total("value").alias("value"), total("n").alias("n"))
    new = centroids.copy()
    for r in rows.collect():  # a row for each cluster and dimension
        if r["n"]:
            new[r["cluster"], r["at"]] = int(r["value"]) // int(r["n"])
    return new


def starts(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED, scale: int = SCALE) -> np.ndarray:
    """The k vectors (fewer, if there are fewer) of the smallest hashes of their ids."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    first = hashed.orderBy(F.asc_nulls_last("hash"), "embedding").limit(k).collect()
    return quantised(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), len(first[0]["embedding"]) if first else 0), scale)


def _assign(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blocks in _blocks(batch):
                cluster, distance = nearest(blocks, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, size: int = SIZE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, width: int = WIDTH, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of vectors (vec_id, embedding), and the last centroids. Rounds run when this is called; a round that changes nothing is the last one needed."""
    kept = vectors.where(usable("embedding", size)).select("vec_id", "embedding")
    centroids = starts(kept, k, seed, scale)
    schema = StructType([StructField("vec_id", vectors.schema["vec_id"].dataType), *PLACES.fields])
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids
    chunks = stash(store_chunks(kept, scale, width, chunk))
    for _ in range(rounds):
        new = moved(chunks, centroids)
        if (new == centroids).all():
            break
        centroids = new
    return chunks.mapInArrow(_assign(centroids), schema), centroids


def op11_subvector_centroids(spark, sf_dir):
    """Each vector's cluster and distance, the clusters' and the whole inertia, and digests of the centroids."""
    placed, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(c, hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    placed = stash(placed)
    total = lambda: F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")
    by_cluster = placed.groupBy("cluster").agg(total().alias("cluster_inertia"))
    every = placed.agg(total().alias("inertia"))
    facts = by_cluster.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(every))  # a row for each cluster, and one row
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other, each vector against each centroid."""
    dims = f"range(1, {SIZE + 1})"
    distance = f"list_sum(list_transform({dims}, lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT"
    near = "SELECT id, any_value(v) AS v, min(d * {k} + n) % {k} AS n, min(d) AS d FROM (SELECT x.id, x.v, c.n, {d} AS d FROM kept x CROSS JOIN c{r} c) GROUP BY id"
    made = [
        f"""WITH usable AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, v FROM usable)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS n, v FROM kept ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        made.append(f"a{r} AS MATERIALIZED ({near.format(k=CLUSTERS, d=distance, r=r)})")
        made.append(f"s{r} AS (SELECT n, i, sum(v[i])::BIGINT AS s, count(*) AS m FROM a{r}, LATERAL (SELECT unnest({dims}) AS i) GROUP BY n, i)")
        made.append(f"m{r} AS (SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS v FROM s{r} GROUP BY n)")
        made.append(f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (n))")
    made.append(f"last AS MATERIALIZED ({near.format(k=CLUSTERS, d=distance, r=ROUNDS)})")
    return (
        ", ".join(made)
        + f""" SELECT k.vec_id, l.n::INTEGER AS cluster, l.d AS distance, sum(l.d) OVER (PARTITION BY l.n)::BIGINT AS cluster_inertia, sum(l.d) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM last l JOIN kept k USING (id) JOIN c{ROUNDS} c ON c.n = l.n"""
    )


ORACLE_SQL = _oracle()
