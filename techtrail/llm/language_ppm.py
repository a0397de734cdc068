"""Language identification by prediction by partial matching.

For each language a tree of byte contexts (up to ``ORDER`` bytes before a byte) is counted over sample texts and then frozen. A byte's
probability in a context of the longest order seen is its count over the sum of counts and of the number of different bytes (escape method
C); a byte not seen there escapes to the next shorter context, and at last to 1/256 for each byte. A text's code length under each language is the sum over all its bytes; the shortest wins.

A code length is 8 bits a byte, the escapes of all contexts that precede a byte, and a correction for each run of bytes that ends with it and that the language has.
So a run's row names only the languages that have it, and all languages of the labels are learned, however many. Corrections are whole numbers of 1/65536 bit, so
sums are exact.

Bounds: the labelled rows that are learned from are at most ``TOTAL``, whatever the number of languages, and at most ``TEXTS`` of one language; languages share them alike, and if there are more languages than that, those with most texts are learned.
All runs of these texts are kept. A run takes 14 bytes for each language that has it, and some 40 more in all; this table is what the driver gathers and broadcasts.

Defined results: a null text and one without a letter are ``und`` with score 0; ties go to the language that sorts first; without samples all are ``und``;
repeated rows have equal results; an empty table gives an empty result; long texts are scored whole, in portions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techtrail.llm.common import small_batches, stash, text_or_empty

#: Bytes before a byte at most (3: runs are numbers of 32 bits).
ORDER = 3
#: Sample texts for each language at most, those of least hash in each of so many buckets of ids, and of all languages.
TEXTS, BUCKETS, TOTAL = 448, 64, 16_384
UNIT = 65536
#: Bytes that are scored at once.
PORTION = 1 << 17


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample_texts(documents: DataFrame, texts: int = TEXTS, total: int = TOTAL) -> DataFrame:
    """lang, text: sample texts of each language, chosen by hash and id alone, so that no text is moved to choose it, and within buckets, so that no language is one task's work."""
    known = documents.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    learned = stash(known.groupBy(F.col("lang").alias("learned lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "learned lang").limit(total).select("learned lang"))
    quota = max(1, min(texts, total // max(learned.count(), 1)))
    buckets = min(BUCKETS, quota)
    each = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets)).alias("bucket"))
    order = Window.partitionBy("lang", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota // buckets)
    chosen = few.join(learned, few["lang"] == learned["learned lang"], "left_semi")
    chosen = stash(chosen.select(F.col("doc_id").alias("chosen id"), F.col("lang").alias("chosen lang")).distinct())  # at most total rows; a table, whose size Spark sees before it joins
    return known.join(chosen, (known["doc_id"] == chosen["chosen id"]) & (known["lang"] == chosen["chosen lang"])).select(known["lang"], known["text"])


Tree = list[tuple[np.ndarray, np.ndarray]]


def runs_of(data: np.ndarray, size: int) -> np.ndarray:
    """Each run of so many bytes as a number."""
    n = len(data) - size + 1
    found = np.zeros(max(n, 0), np.uint32)
    for i in range(size if n > 0 else 0):
        found = found << np.uint32(8) | data[i : i + n]
    return found


def count_runs(samples: DataFrame, order: int = ORDER) -> dict[str, Tree]:
    """For each language and size 1 to order + 1: the runs of bytes, as sorted numbers, and how often each occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(np.frombuffer(text.encode(), np.uint8).astype(np.uint32))
            for lang, texts in by_lang.items():
                for size in range(1, order + 2):
                    found, n = np.unique(np.concatenate([runs_of(x, size) for x in texts]), return_counts=True)
                    columns = [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, np.int32)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "run", "n"])

    counted = samples.mapInArrow(count, "lang string, size int, run long, n long").groupBy("lang", "size", "run").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # the runs of at most TOTAL texts
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    lang, size, run, n = coded.indices.to_numpy(), rows.column("size").to_numpy(), rows.column("run").to_numpy().astype(np.uint32), rows.column("n").to_numpy()
    order_of = np.lexsort((run, size, lang))
    lang, size, run, n = lang[order_of], size[order_of], run[order_of], n[order_of]
    trees: dict[str, Tree] = {}
    for k in sorted(range(len(names)), key=names.__getitem__):
        low, high = np.searchsorted(lang, [k, k + 1])
        ends = low + np.searchsorted(size[low:high], np.arange(1, order + 3))
        trees[names[k]] = [(run[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return trees


def code_length(counts: list[dict[bytes, dict[int, int]]], context: bytes, byte: int) -> float:
    """Bits of a byte after a context, from counts of next bytes by context for each order: the definition itself."""
    bits = 0.0
    for order in range(len(context), -1, -1):
        after = counts[order].get(context[len(context) - order :])
        if not after:
            continue
        total = sum(after.values()) + len(after)
        if byte in after:
            return bits - math.log2(after[byte] / total)
        bits -= math.log2(len(after) / total)
    return bits + 8


def next_bytes(tree: list[dict[bytes, int]]) -> list[dict[bytes, dict[int, int]]]:
    """Counts of next bytes by context, for each order."""
    made: list[dict[bytes, dict[int, int]]] = []
    for runs in tree:
        after: dict[bytes, dict[int, int]] = {}
        for run, n in runs.items():
            after.setdefault(run[:-1], {})[run[-1]] = n
        made.append(after)
    return made


def corrections(tree: Tree) -> tuple[float, Tree, list[np.ndarray]]:
    """(escape of the empty context; for each size runs and their corrections; for each size the runs' escapes as contexts) in 1/UNIT bit."""
    made, escapes, shorter = [], [], None
    for k, (runs, n) in enumerate(tree):
        contexts, of = np.unique(runs >> np.uint32(8), return_inverse=True)
        different = np.bincount(of, minlength=len(contexts))
        total = np.bincount(of, weights=n, minlength=len(contexts)) + different
        bits = lambda p: np.rint(-np.log2(p) * UNIT).astype(np.int64)
        escape, cost = bits(different / total), bits(n / total[of])
        if shorter is None:
            before = np.full(len(runs), 8 * UNIT, np.int64)
            escapes.append(escape[:1])
        else:
            known, costs = shorter
            before = costs[np.searchsorted(known, runs & np.uint32((1 << 8 * k) - 1))]
            own = np.zeros(len(known), np.int64)
            own[np.searchsorted(known, contexts)] = escape
            escapes.append(own)
        made.append((runs, cost - escape[of] - before))
        shorter = runs, cost
    escapes.append(np.zeros(len(tree[-1][0]), np.int64))
    return float(escapes[0].sum()), made, escapes[1:]


class Places:
    """Places of numbers in an array without repeats, by open addressing, for many at once."""

    def __init__(self, numbers: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(numbers)).bit_length()))
        self.place = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.number = np.zeros(len(self.place), np.uint64)
        left, slot = np.arange(len(numbers)), self.slots(numbers)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            settled = self.place[slot] == left
            self.number[slot[settled]] = numbers[left[settled]]
            left, slot = left[~settled], (slot[~settled] + 1) % len(self.place)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """Place of each number, -1 if it is not there."""
        slot = self.slots(numbers)
        found = self.place[slot]
        left = np.flatnonzero((found >= 0) & (self.number[slot] != numbers))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) % len(self.place)
            found[left] = self.place[slot]
            wrong = (found[left] >= 0) & (self.number[slot] != numbers[left])
            left, slot = left[wrong], slot[wrong]
        return found


class Tables:
    """Corrections and escapes of all runs that any language has, for texts to look up."""

    def __init__(self, trees: dict[str, Tree]):
        self.languages = list(trees)
        self.order = len(next(iter(trees.values()))) - 1 if trees else 0
        self.start = np.zeros(len(trees))  # bits of a byte before any run is known
        sizes, runs, langs, values, escapes = [], [], [], [], []
        for k, tree in enumerate(trees.values()):
            empty, corrected, escaped = corrections(tree)
            self.start[k] = 8 * UNIT + empty
            for size, ((run, value), escape) in enumerate(zip(corrected, escaped, strict=True), 1):
                sizes.append(np.full(len(run), size, np.uint64)), runs.append(run.astype(np.uint64)), langs.append(np.full(len(run), k, np.int16))
                values.append(value), escapes.append(escape)
        if not trees:
            return
        key = np.concatenate(sizes) << np.uint64(32) | np.concatenate(runs)
        order = np.argsort(key, kind="stable")
        known, first = np.unique(key[order], return_index=True)
        self.begin = np.append(first, len(key)).astype(np.int32)
        self.lang, self.escape = np.concatenate(langs)[order], np.concatenate(escapes)[order].astype(np.int32)
        self.value = np.concatenate(values)[order].astype(np.int32) + self.escape
        self.places = Places(known)

    def add(self, total: np.ndarray, place: np.ndarray, text: np.ndarray, values: np.ndarray, sign: int = 1) -> None:
        """Adds the values of runs in certain places to the code lengths of the texts that they stand in."""
        begin, n = self.begin[place], self.begin[place + 1] - self.begin[place]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        total += sign * np.bincount(np.repeat(text, n) * len(self.languages) + self.lang[at], weights=values[at], minlength=total.size).reshape(total.shape)

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in 1/UNIT bit."""
        sizes = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(bytes(self.order) + b"".join(texts), np.uint8).astype(np.uint64)
        ends = np.cumsum(sizes)
        total = sizes[:, None] * self.start[None, :]
        for low in range(0, int(ends[-1]) if len(ends) else 0, PORTION):
            here = np.arange(low, min(low + PORTION, int(ends[-1])))
            text = np.searchsorted(ends, here, side="right")
            inside = here - (ends - sizes)[text]  # bytes of the text before this one
            last = here + 1 == ends[text]
            run = np.zeros(len(here), np.uint64)
            for size in range(1, self.order + 2):
                run |= data[here + self.order - size + 1] << np.uint64(8 * (size - 1))
                found = self.places.of(run | np.uint64(size << 32))
                use = (found >= 0) & (inside >= size - 1)
                self.add(total, found[use], text[use], self.value)
                use &= last  # no byte follows, so it is nothing's context
                self.add(total, found[use], text[use], self.escape, -1)
        return total


def identify(df: DataFrame, tables: Broadcast, column: str = "text") -> DataFrame:
    """Adds lang_pred and score (the winner's posterior probability under equal priors, at one part in eight of the code lengths' difference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables.value
        for batch in small_batches(batches, column):
            letters = batch.column("has_letter").to_pylist()
            texts = [x.encode() for x, y in zip(batch.column(column).to_pylist(), letters, strict=True) if y and known.languages]
            bits = known.costs(texts) if texts else np.zeros((0, 1))
            best = bits.argmin(axis=1)
            certain = 1 / np.exp2((bits.min(axis=1, keepdims=True) - bits) / (8 * UNIT)).sum(axis=1)
            found = iter(zip(best.tolist(), certain.tolist(), strict=True))
            rows = [next(found) if y and known.languages else (-1, 0.0) for y in letters]
            made = [pa.array([known.languages[k] if k >= 0 else "und" for k, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score"])

    marked = df.drop("has_letter", "lang_pred", "score").withColumn("has_letter", F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False)))
    schema = marked.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return marked.mapInArrow(run, schema).drop("has_letter")


def learn(documents: DataFrame) -> Broadcast:
    """Tables from documents (doc_id, text, lang), for the workers."""
    return documents.sparkSession.sparkContext.broadcast(Tables(count_runs(sample_texts(documents))))


def op5_language_ppm(spark, sf_dir):
    """Language of each document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(documents.select("doc_id", text_or_empty().alias("text")), learn(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
