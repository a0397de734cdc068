"""Removing passages that repeat across documents, by sliding spans of sentences.

Every run of several consecutive sentences is hashed, the hashes are joined over all documents, and sentences
that a span covers which is not the first of its hash are removed.

A text is cut into sentences after . ! ? and white space, and at line breaks. Runs are: from each sentence on, and back from each sentence, the
shortest with ``run`` sentences and ``words`` words (so each sentence of a repeated passage that has as many is
covered, those at its ends too), and runs of fewer sentences that have ``long_words`` words.
A passage may also begin and end inside sentences. Of the ``EDGE`` words from each word on, those of least hash among ``WINDOW`` in a row are
hashed too, wherever sentences end, so that any two equal passages of EDGE + WINDOW - 1 = 51 words have one in common. Such a run's words are
removed without the rest of their sentences; of a repeated passage at most WINDOW - 1 words are left at each end.
Hashes are 96 bits of a run's words, white space not counted, made of running sums of the words' hashes. The first span of a hash is that in the document of smallest doc_id, there
the earliest; a run of EDGE words that overlaps the first of its hash is no repeat.

Defined results: null and empty texts stay as they are; a text from which nothing is removed stays
as it is, byte for byte; rows that share a doc_id and a text are one document (repeated rows keep equal
texts), of different texts with one doc_id that of smaller digest is first; a null doc_id counts as the largest; other columns are kept; long texts
are read whole, in time in proportion to their length.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from techtrail.llm.common import small_batches, stash

RUN = 3
WORDS = 12
LONG_WORDS = 30
#: Words of a run that may begin inside a sentence, and of how many such runs in a row one at least is hashed.
EDGE, WINDOW = 30, 22
#: Hashes that a task takes together, and of which it sends each different one once.
PORTION = 1 << 20
#: Stands for a sentence's number where a span is EDGE words, from word "begin" of the text on.
IN_WORDS = -1
#: Stands for a null doc_id.
LAST_ID = (1 << 63) - 1

BREAK = re.compile(r"(?<![.!?])[.!?]+\s+|\n\s*")
#: A word with the white space around it that no other word has.
WORD = re.compile(r"^\s*\S+\s*|\S+\s*")


def sentences(text: str) -> list[str]:
    """The sentences of a text with the white space after them; joined, they are the text."""
    found, at = [], 0
    for m in BREAK.finditer(text):
        if text[at : m.end()].strip():
            found.append(text[at : m.end()])
            at = m.end()
    if at < len(text):
        found.append(text[at:])
    return found


def spans(counts: list[int], run: int = RUN, words: int = WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """(begin, end) of the runs to hash among sentences with so many words."""
    n, total = len(counts), [0]
    for x in counts:
        total.append(total[-1] + x)
    found = set()
    for begin in range(n):
        for size in range(1, run):
            if begin + size <= n and total[begin + size] - total[begin] >= long_words:
                found.add((begin, begin + size))
        end = begin + run
        while end <= n and total[end] - total[begin] < words:
            end += 1
        if end <= n:
            found.add((begin, end))
        elif begin + run <= n:
            break  # later ones have fewer words still
    for end in range(n, run - 1, -1):
        begin = end - run
        while begin >= 0 and total[end] - total[begin] < words:
            begin -= 1
        if begin < 0:
            break
        found.add((begin, end))
    return sorted(found)


class _Numbers(dict):
    """A hash of each word, kept until there are many."""

    def __missing__(self, word: str) -> int:
        number = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= 40:
            if len(self) > 1 << 18:
                self.clear()
            self[word] = number
        return number


def _over(values: np.ndarray, pick: np.ufunc, size: int) -> np.ndarray:
    """pick (minimum or maximum) of each ``size`` values in a row."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of any stretch of a text's words: differences of running sums of the words' hashes, each times a power of its place."""

    #: Odd numbers whose powers weigh places, for the upper 64 bits and for the lower 32.
    BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
    powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, words: list[str], numbers: dict[str, int] | None = None):
        numbers = _Numbers() if numbers is None else numbers
        n = len(words)
        if not self.powers or len(self.powers[0][0]) <= n:
            size = 2 * n + 1024
            up = [np.cumprod(np.append(np.uint64(1), np.full(size, base, np.uint64))) for x in self.BASES for base in (x, pow(x, -1, 1 << 64))]
            Ranges.powers = [(up[0], up[1]), (up[2], up[3])]
        own = np.fromiter(map(numbers.__getitem__, words), np.uint64, n)
        other = _mixed(own + np.uint64(1))
        self.sums = [np.append(np.uint64(0), np.cumsum(x * power[:n])) for x, (power, _) in zip((own, other), self.powers, strict=True)]
        self.size = n

    def high(self, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return self._hash(0, begin, end, seed)

    def low(self, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return (self._hash(1, begin, end, seed) >> np.uint64(32)).astype(np.uint32)

    def _hash(self, k: int, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        sums = self.sums[k]
        return _mixed((sums[end] - sums[begin]) * self.powers[k][1][begin] + (end - begin).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed))


def word_runs(ranges: Ranges, ends: np.ndarray, edge: int = EDGE, window: int = WINDOW) -> np.ndarray:
    """Where the runs of ``edge`` words begin that are least of some ``window`` in a row in their text; ends: where each text's words end."""
    n = ranges.size - edge + 1
    if n < window:
        return np.zeros(0, np.int64)
    begins = np.arange(n)
    sums = ranges.high(begins, begins + edge, 1)
    least = _over(sums, np.minimum, window)
    end = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
    least[begins[: len(least)] + window - 1 + edge > end] = 0  # windows that reach into the next text
    # a run is least of a window when the greatest of its windows' minima is itself
    outside = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_over(np.concatenate([outside, least, outside]), np.maximum, window) == sums)


def _owner() -> list[Column]:
    """What tells documents apart: rows that share an id and a text are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("digest")]


HASHED = "high long, low int, number long, id long, begin int, end int, kind int"
#: Kinds of rows: a span whose hash is sought elsewhere; a span known to be repeated; a document's number, with its digest in place of a hash.
SOUGHT, REPEATED, DOCUMENT = range(3)


def _kinds(rows: dict[str, np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kind of each row (high, low, begin, end) of the document in a place, and which rows count.

    SOUGHT is, of a hash, the least document's first row; others are REPEATED. A run of words that overlaps its document's first one does not count.
    """
    order = np.lexsort((rows["begin"], place, rows["low"], rows["high"]))
    high, low, at, begin = rows["high"][order], rows["low"][order], place[order], rows["begin"][order]
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(order)]
    own = new | np.append(True, at[1:] != at[:-1])[: len(order)]
    number = np.arange(len(order))
    first, own_first = (np.maximum.accumulate(np.where(x, number, 0)) for x in (new, own))
    kind, counts = np.empty(len(order), np.int32), np.empty(len(order), bool)
    kind[order] = np.where(own & (at == at[first]), SOUGHT, REPEATED)
    counts[order] = own | (rows["end"][order] != IN_WORDS) | (begin >= begin[own_first] + EDGE)
    return kind, counts


def _portion(parts: list[dict[str, np.ndarray]], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of HASHED for the spans of some documents (owners: id, digest, number). A hash that several of them have is sought once for all."""
    ids, digests, numbers = np.concatenate(owners, axis=1)
    order = np.lexsort((digests, ids))
    same = (ids[order][1:] == ids[order][:-1]) & (digests[order][1:] == digests[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(0, ~same))
    once = np.zeros(len(order), bool)  # of rows that are one document one is enough
    once[np.unique(rank, return_index=True)[1]] = True
    rows = {x: np.concatenate([part[x] for part in parts]) for x in parts[0]}
    rows = {x: y[once[rows["document"]]] for x, y in rows.items()}
    kind, counts = _kinds(rows, rank[rows["document"]])
    rows, kind = {x: y[counts] for x, y in rows.items()}, kind[counts]
    number = numbers[rows["document"]]
    high = np.where(kind == SOUGHT, rows["high"], number * 0x5851F42D4C957F2D + rows["begin"])  # what is known needs no partner: anywhere will do
    used = np.unique(rows["document"])
    n, none = len(kind), np.zeros(len(used), np.int32)
    columns = [
        np.append(high, digests[used]),
        np.append(np.where(kind == SOUGHT, rows["low"], np.int32(0)), none),
        np.append(number, numbers[used]),
        np.append(np.zeros(n, np.int64), ids[used]),
        np.append(rows["begin"], none),
        np.append(rows["end"], none),
        np.append(kind, np.full(len(used), DOCUMENT, np.int32)),
    ]
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in HASHED.split(", ")])
    for at in range(0, table.num_rows, 1 << 16):
        yield table.slice(at, 1 << 16)


def _spans_of(texts: list[str], numbers: dict[str, int], run: int, words: int, long_words: int) -> dict[str, np.ndarray]:
    """high, low, document (its place in the list), begin and end of the spans of some texts."""
    flat: list[str] = []
    sizes: list[int] = []  # words of each sentence
    whole: list[tuple[int, int]] = []
    ends, begins, each = [], [], []
    for text in texts:
        split = [x.split() for x in sentences(text)]
        counts = [len(x) for x in split]
        begins.append(len(sizes))
        sizes += counts
        flat += itertools.chain.from_iterable(split)
        ends.append(len(flat))
        found = spans(counts, run, words, long_words)
        each.append(len(found))
        whole += found
    ranges, total = Ranges(flat, numbers), np.append(0, np.cumsum(sizes, dtype=np.int64))
    of_sentences = np.array(whole, np.int64).reshape(-1, 2)
    first = np.repeat(np.array(begins, np.int64), each)
    a, b = total[of_sentences[:, 0] + first], total[of_sentences[:, 1] + first]
    c = word_runs(ranges, np.array(ends))
    document = np.searchsorted(ends, c, side="right")
    return {
        "high": np.append(ranges.high(a, b), ranges.high(c, c + EDGE, 1)).view(np.int64),
        "low": np.append(ranges.low(a, b), ranges.low(c, c + EDGE, 1)).view(np.int32),
        "document": np.append(np.repeat(np.arange(len(texts)), each), document),
        "begin": np.append(of_sentences[:, 0], c - np.append(0, ends)[document]).astype(np.int32),
        "end": np.append(of_sentences[:, 1], np.full(len(c), IN_WORDS)).astype(np.int32),
    }


def _hashed(run: int, words: int, long_words: int):
    """Rows of HASHED for rows (id, digest, number, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        parts: list[dict[str, np.ndarray]] = []
        owners: list[np.ndarray] = []
        held = documents = 0
        for batch in small_batches(batches, "text", 1 << 20):
            made = _spans_of(batch.column("text").to_pylist(), numbers, run, words, long_words)
            made["document"] += documents
            parts.append(made)
            owners.append(np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("id", "digest", "number")]))
            held, documents = held + len(made["high"]), documents + batch.num_rows
            if held >= PORTION:
                yield from _portion(parts, owners)
                parts, owners, held, documents = [], [], 0, 0
        if parts:
            yield from _portion(parts, owners)

    return rows


def repeated_spans(documents: DataFrame, run: int = RUN, words: int = WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """id, digest, begin, end of the spans that are not the first of their hash (sentences counted from 0; where end is IN_WORDS, begin counts words).

    All hashes are moved once, after those that meet in one portion of a task are one; so no hash has more rows than there are portions.
    Of a document only a number is moved with them, which the rows that turn out to be repeated find its id and text's digest by. Numbers
    are places in the partitions of documents, so pass a written table: one that is made again for a lost task must be made in the same order.
    """
    texts = documents.where("text is not null").select(*_owner(), F.monotonically_increasing_id().alias("number"), "text")
    hashed = texts.mapInArrow(_hashed(run, words, long_words), HASHED)
    met = F.count("*").over(Window.partitionBy("high", "low", "kind"))
    found = stash(hashed.withColumn("met", met).where((F.col("kind") != SOUGHT) | (F.col("met") > 1)).drop("met"))
    owners = found.where(F.col("kind") == DOCUMENT).select("number", "id", F.col("high").alias("digest"))
    spans_found = found.where(F.col("kind") != DOCUMENT).drop("id").join(owners, "number")
    first = F.min(F.struct("id", "digest")).over(Window.partitionBy("high", "low", "kind"))
    placed = spans_found.withColumn("first", first)
    return placed.where((F.col("kind") == REPEATED) | (F.struct("id", "digest") > F.col("first"))).select("id", "digest", "begin", "end")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        texts, removed, counts = [], [], []
        for text, covered in zip(batch.column("text").to_pylist(), batch.column("repeated spans").to_pylist(), strict=True):
            parts = sentences(text or "")
            gone, words = bytearray(len(parts)), set()
            for x in covered or ():
                if x["end"] == IN_WORDS:
                    words.update(range(x["begin"], x["begin"] + EDGE))
                else:
                    gone[x["begin"] : x["end"]] = b"\1" * (min(x["end"], len(parts)) - min(x["begin"], len(parts)))
            kept, at = [], 0
            for i, x in enumerate(parts if words else ()):
                pieces = WORD.findall(x)
                left = [w for k, w in enumerate(pieces, at) if k not in words]
                at += len(pieces)
                if len(left) < len(pieces):
                    gone[i] |= 2
                    x = "".join(left)
                kept.append(x)
            counts.append(len(parts))
            removed.append(sum(map(bool, gone)))
            texts.append("".join(x for x, y in zip(kept or parts, gone, strict=True) if not y & 1).strip() if any(gone) else text)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[batch.schema.get_field_index("text")] = pa.array(texts, pa.string())
        names = [*batch.schema.names[:-1], "sentences", "sentences removed"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], names=names)


def remove_repeats(documents: DataFrame, run: int = RUN, words: int = WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """documents with repeated sentences removed from text; columns "sentences" and "sentences removed" (whole or in part) are added, or replaced."""
    spans_of = repeated_spans(documents, run, words, long_words).groupBy(F.struct("id", "digest").alias("span owner")).agg(F.collect_set(F.struct("begin", "end")).alias("repeated spans"))
    spans_of = stash(spans_of)  # as a table it lets the join split the rows of a document that is repeated very often
    kept = documents.drop("sentences", "sentences removed", "span owner", "repeated spans")
    joined = kept.join(spans_of, F.struct(*_owner()) == F.col("span owner"), "left").drop("span owner")
    schema = StructType([*(StructField(x.name, x.dataType) for x in kept.schema.fields), StructField("sentences", IntegerType()), StructField("sentences removed", IntegerType())])
    return joined.mapInArrow(_cut, schema)


def op2_sentence_spans(spark, sf_dir):
    """Documents without the sentences of spans that another document, or an earlier place, has already."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.col("sentences").alias("n_sentences"), F.col("sentences removed").alias("n_removed"))
