"""Near-duplicates by SimHash, with pivot distance tables.

Fingerprints at a Hamming distance of at most 3 are linked, and each document
gets the smallest doc_id of its component.

Distances to reference fingerprints ("pivots") obey the triangle inequality: a pair whose
distances to any pivot differ by more than 3 is no pair. Since distances to random pivots all lie near 32 of 64 bits, they
thin out pairs but can't name the candidates of a fingerprint; so fingerprints
first meet by equal bits. Of six blocks of bits three or more are equal in any pair,
hence each fingerprint is dealt to the 20 keys of three blocks. Among those that meet under a key, the pivot
table discards pairs by maximum coordinate difference, and the rest are verified bit by bit. This loses no pair.

A key with very many fingerprints is dealt again, by three of six blocks of its other bits; what
meets then differs in at most 17 bits, so at most 2**17 distinct fingerprints can. From each key come the edges of a spanning forest,
not all pairs. Equal fingerprints are one node throughout.

Defined results: a null or empty text, and one of white space alone, has fingerprint zero and is linked like any other; a null
doc_id never names a component unless it has no other; repeated rows
have equal results; an empty table gives an empty result; other columns are left out; long texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from techtrail.llm.common import small_batches, stash, text_or_empty
from techtrail.llm.graph import connected_components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Reference fingerprints in the distance table.
PIVOTS = 24
#: Fingerprints under one key above which the key is dealt again.
CROWD = 4096

BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
SUBBLOCKS = [(0, 6), (6, 6), (12, 6), (18, 5), (23, 5), (28, 5)]
TRIPLES = list(itertools.combinations(range(6), 3))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only \t-\r and space split
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    if count == 1:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    total = np.zeros(64, np.int64)
    for i in range(0, count, 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, digest (64-bit hash of the text), fingerprint (long) for df (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            made = [fingerprint(x or "", shingle, seed) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(made, pa.int64())], names=["doc_id", "digest", "fingerprint"])

    kept = df.select("doc_id", F.xxhash64("text").alias("digest"), text_or_empty().alias("text"))
    return kept.mapInArrow(run, kept.select("doc_id", "digest", F.lit(None).cast("long").alias("fingerprint")).schema)


def _bits(value: Column, blocks: list[tuple[int, int]], chosen: tuple[int, ...]) -> Column:
    """The chosen blocks of bits of value, side by side."""
    out, at = F.lit(0).cast("long"), 0
    for k in chosen:
        begin, size = blocks[k]
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, begin).bitwiseAND(F.lit((1 << size) - 1).cast("long")), at))
        at += size
    return out


def _dealt(distinct: DataFrame) -> DataFrame:
    """fingerprint, key, part: the fingerprints that meet, one row for each key that has two or more."""
    value = F.col("fingerprint")
    keys = []
    for t, chosen in enumerate(TRIPLES):
        others = tuple(k for k in range(6) if k not in chosen)
        key = F.lit(t << 40).cast("long").bitwiseOR(_bits(value, BLOCKS, chosen))
        keys.append(F.struct(key.alias("key"), _bits(value, BLOCKS, others).alias("rest")))
    dealt = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.key", "k.rest")
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.hint("merge").join(shared, "key")  # Spark sizes exploded rows by the table before, a twentieth, and would broadcast them
    parts = F.array(*(F.lit((t + 1) << 40).cast("long").bitwiseOR(_bits(F.col("rest"), SUBBLOCKS, chosen)) for t, chosen in enumerate(TRIPLES)))
    few = F.array(F.lit(0).cast("long"))
    return met.select("fingerprint", "key", F.explode(F.when(F.col("n") > CROWD, parts).otherwise(few)).alias("part"))


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label each element by the first element of its component, given pairs (a, b) and the labels so far."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def forest(values: np.ndarray, group: np.ndarray, pivots: np.ndarray, distance: int = DISTANCE, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each group, what pairs at most so far apart connect.

    The table's first coordinate, sorted, gives each row's range of partners; the other coordinates
    discard pairs; XOR verifies the survivors. Pairs are taken in portions of about ``most``.
    """
    table = np.bitwise_count(values[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    values, group, table = values[order], group[order], table[order]
    place = np.cumsum(np.append(0, group[1:] != group[:-1])) * 256 + table[:, 0]
    partners = np.searchsorted(place, place + distance, side="right") - np.arange(len(place)) - 1
    label = np.arange(len(values))
    ends = np.cumsum(partners)
    begin = 0
    while begin < len(values):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        count = partners[begin:end]
        a = np.repeat(np.arange(begin, end), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        for j in range(1, table.shape[1]):
            near = np.abs(table[a, j] - table[b, j]) <= distance
            a, b = a[near], b[near]
        near = np.bitwise_count(values[a] ^ values[b]) <= distance
        label = _join_labels(label, a[near], b[near])
        begin = end
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def reference_fingerprints(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(count)], np.uint64)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows (fingerprint, key, part) sorted by key and part."""
    pivots, held = reference_fingerprints(), None

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        new = np.append(False, (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))
        a, b = forest(np.ascontiguousarray(rows[:, 0]).view(np.uint64), np.cumsum(new), pivots)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("fingerprint", "key", "part")], axis=1)
        rows = rows if held is None else np.concatenate((held, rows))
        last = (rows[:, 1:] == rows[-1, 1:]).all(axis=1)
        first = len(rows) - int(last[::-1].argmin()) if not last.all() else 0  # where the last group begins
        if first:
            yield edges(rows[:first])
        held = rows[first:]
    if held is not None:
        yield edges(held)


def near_edges(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs at distance 3 or less."""
    met = _dealt(distinct).repartition("key", "part").sortWithinPartitions("key", "part")
    return met.mapInArrow(_forests, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, digest, fingerprint (long), component_id for documents (doc_id, text)."""
    marked = stash(fingerprints(documents, shingle, seed))
    distinct = stash(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    component = connected_components(near_edges(distinct))
    linked = distinct.join(component.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = stash(linked.groupBy("component").agg(F.min("first_id").alias("component_id")))  # a table: the rows of a very large component can be split then
    ids = linked.join(smallest, "component").select("fingerprint", "component_id")
    return marked.join(ids, "fingerprint").select("doc_id", "digest", "fingerprint", "component_id")


def op3_simhash_pivots(spark, sf_dir):
    """Fingerprint and component of each document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
