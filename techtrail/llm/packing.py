"""Packing tokenised documents into sequences of fixed length, by linear grouping and best fit.

``token_pieces`` tokenises texts and cuts the longer ones; ``pack`` gives every
piece a sequence and an offset. The plan is made from the number of pieces of
each length alone, a table of at most ``capacity`` rows however large the input:

* large lengths, sorted, are cut into groups of equally many pieces, and each is rounded up to its group's largest
  (several thresholds of "large" are tried, and the best plan kept);
* the few sizes that remain are packed by the linear programme over configurations (columns are generated by a
  knapsack), rounded down to whole numbers;
* configurations get actual lengths in place of rounded ones, which never need more room;
* pieces left over and small ones go, largest first, where the least room remains (best fit).

Pieces are then numbered within their length, in buckets of a hash so that no
length is numbered by one task, and looked up in the plan.

Defined results: a null text is an empty one, whose only id is the end id;
repeated rows are packed like any others; an empty table gives an empty
result; other columns are left out. Which of several pieces of equal length stands where is not defined.
A text of any length is tokenised whole, long runs of white space or of one letter too.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from techtrail.llm.common import small_batches, stash, text_or_empty
from techtrail.llm.word_bpe import byte_letters

CAPACITY = 2048
#: Groups of equally many large pieces.
GROUPS = 80
#: What counts as large, in parts of the capacity: plans are made for each until one is this close to the least
#: number of sequences that the sum of lengths allows; the one with the fewest sequences is taken.
LARGE, CLOSE = (1 / 2, 2 / 5, 1 / 4, 1 / 8), 1.0005
#: Chunks of text that a worker keeps the ids of.
KEPT = 400_000
#: Pieces of one length are numbered in so many buckets at least, and in more where a bucket would have more pieces than that.
BUCKETS, IN_BUCKET = 256, 1 << 15

# A space that is not the start of a word's own token.
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


class ByteBpe(dict):
    """Ids, as little-endian 32-bit numbers, of " " + a word; filled as words are asked for."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {x: b for b, x in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if not any(token == x["content"] for x in spec["added_tokens"])}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path = path

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation(), tokenizer.no_padding()
        return tokenizer

    def encode(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode(text, allowed_special="all")
        except ValueError:  # the faster library's search has no room for some hundred thousand blanks in a row
            ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        made = self.encode(" " + word)
        if len(word) <= 40:
            if len(self) >= KEPT:
                self.clear()
            self[word] = made
        return made

    def text(self, text: str) -> bytes:
        """Ids of a text. A space before a word begins a token of its own, so a text can be cut there."""
        if LOOSE_SPACE.search(text):
            return self.encode(text)
        first, *words = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, words))


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: ids of each text and the end id, cut to at most capacity.

    All pieces but the first of a text have the full length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(tokenizer), struct.pack("<I", end_id)
        for batch in small_batches(batches, "text"):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(bpe.text(text or "") + end)
                total = len(ids) // 4
                length, start = total % capacity or min(total, capacity), 0
                for piece in range(-(-total // capacity)):
                    rows.append((i, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length = start + length, capacity
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kept = df.select("doc_id", "text")
    schema = kept.select("doc_id", *(F.lit(None).cast("long").alias(x) for x in ("piece", "start", "length", "ids_crc32"))).schema
    return kept.mapInArrow(run, schema)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (knapsack with repetition)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(worth > 1e-12)
    useful = useful[np.argsort(sizes[useful])]
    small_first, value = sizes[useful], worth[useful]
    fits = np.searchsorted(small_first, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], last[room] = best[room - 1], -1
        if n := fits[room]:
            with_each = best[room - small_first[:n]] + value[:n]
            k = int(with_each.argmax())
            if with_each[k] > best[room] + 1e-12:
                best[room], last[room] = with_each[k], useful[k]
    chosen, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            chosen[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), chosen


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations of the sizes and how many sequences get each, rounded down from the linear programme's optimum."""
    n = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse, amount = np.diag(1 / np.diag(columns)), counts / np.diag(columns)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value, column = best_configuration(sizes, dual, capacity)
        if value <= 1 + 1e-5:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        amount -= step * change
        amount[out] = step
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        columns[:, out] = column
    left, made = counts.astype(np.int64).copy(), []
    for j in np.argsort(-amount):
        column = columns[:, j].astype(np.int64)
        used = column > 0
        times = int(min(np.floor(amount[j] + 1e-6), (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            left -= times * column
            made.append((column, times))
    assert n == len(left)
    return made


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, number of such sequences)] for a histogram of lengths, the best of those for the given thresholds."""
    bound = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best: list[tuple[tuple[int, ...], int]] = []
    for part in large:
        made = plan_above(histogram, capacity, groups, part)
        if not best or sum(n for _, n in made) < sum(n for _, n in best):
            best = made
        if sum(n for _, n in best) <= CLOSE * bound:
            break
    return best


def plan_above(histogram: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[tuple[int, ...], int]]:
    """A plan in which lengths over this part of the capacity are packed by linear grouping, and the others by best fit into what room is left."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    done: list[tuple[tuple[int, ...], int]] = []
    if capacity in left:
        done.append(((capacity,), left.pop(capacity)))
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def keep(lengths: tuple[int, ...], times: int) -> None:
        if times:
            rest = capacity - sum(lengths)
            (room.setdefault(rest, []) if rest else done).append((lengths, times))

    for lengths, times in _grouped({k: v for k, v in left.items() if k > large * capacity}, capacity, groups):
        for k in lengths:
            left[k] -= times
        keep(lengths, times)

    for length in sorted((k for k, v in left.items() if v), reverse=True):
        count = left[length]
        while count:
            rest = min((r for r in room if r >= length), default=capacity)
            lengths, times = room[rest].pop() if rest in room else ((), -(-count // (capacity // length)))
            if rest in room and not room[rest]:
                del room[rest]
            each = rest // length
            filled = min(times, count // each)
            keep((*lengths, *[length] * each), filled)
            count -= filled * each
            times -= filled
            if times and count:  # fewer are left than fit
                keep((*lengths, *[length] * count), 1)
                times, count = times - 1, 0
            if times and lengths:
                room.setdefault(rest, []).append((lengths, times))
    return done + [x for rest in sorted(room) for x in room[rest]]


def _grouped(histogram: dict[int, int], capacity: int, groups: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Sequences of large pieces by linear grouping, with actual lengths."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    if not len(lengths):
        return
    counts = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1])
    cuts = np.unique(np.append(np.arange(1, groups) * total // groups, total))
    begins = np.concatenate(([0], cuts[:-1]))
    rounded = lengths[np.searchsorted(ends, begins, side="right")]
    sizes, group_of = np.unique(-rounded, return_inverse=True)
    sizes = -sizes
    first = np.array([begins[group_of == g].min() for g in range(len(sizes))])
    members = np.array([(cuts - begins)[group_of == g].sum() for g in range(len(sizes))])
    taken = first.copy()
    for column, times in configurations(sizes, members, capacity):
        slots = []
        for g in np.flatnonzero(column):
            for _ in range(int(column[g])):
                slots.append(int(taken[g]))
                taken[g] += times
        # where the actual length in any slot changes, a new run of sequences begins
        breaks = {0, times}
        for at in slots:
            inside = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, at + times, side="left")] - at
            breaks.update(int(x) for x in inside if 0 < x < times)
        marks = sorted(breaks)
        for a, b in zip(marks, marks[1:], strict=False):
            yield tuple(int(lengths[np.searchsorted(ends, at + a, side="right")]) for at in slots), b - a


def runs(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, pieces in a sequence, first sequence, offset of the first): pieces of a length, in their order, by sequence."""
    rows, used, base = [], {}, 0
    for lengths, times in planned:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            begin = used.get(length, 0)
            rows.append((length, begin, each, base, offset))
            used[length] = begin + each * times
            offset += each * length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds number: 0, 1, ... within each length, counted in buckets of a hash."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(inside))
    return ranked.join(begins, ["length", "bucket"]).withColumn("number", F.col("begin") + F.col("rank") - 1).drop("bucket", "rank", "begin")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and more); they are read more than once, so pass a written table."""
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length: at most capacity rows
    table = pieces.sparkSession.sparkContext.broadcast(runs(plan(counted, capacity)))
    buckets = max(BUCKETS, max(counted.values(), default=0) // IN_BUCKET)
    kept_columns = pieces.columns
    columns = [*kept_columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 44 | rows[:, 1] if len(rows) else rows
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "number"))
            run = rows[np.searchsorted(keys, length << 44 | number, side="right") - 1]
            nth = number - run[:, 1]
            made = [pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)]
            kept = batch.select(kept_columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=columns)

    schema = pieces.select("*", *(F.lit(None).cast("long").alias(x) for x in columns[-2:])).schema
    return numbered(pieces, buckets).select(*pieces.columns, "number").mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise documents (doc_id, text) and pack them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    texts = documents.select("doc_id", text_or_empty().alias("text"))
    return pack(stash(token_pieces(texts, tokenizer, capacity)), capacity)


def op8_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("piece", F.col("piece").cast("int"))
