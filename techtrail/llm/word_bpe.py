"""Byte-pair encoding by a priority queue over a doubly linked list of symbols.

``encode_decode`` turns texts into token ids and back as a tokenizers file of
kind "word BPE" says: texts are normalised (NFC, lower case), cut into words,
and the symbols of a word are merged, lowest merge rank first, leftmost among
equals. Decoding concatenates the vocabulary's strings, with a space between
tokens, as that file has no decoder.

White space is never inside a word, so texts are cut there first, and what a
piece between white space becomes is kept, if it is short, in a bounded table of each Python
worker. The tokenizer file is read on each worker from its path, a parameter.

Defined results: a null text is an empty one, which has no tokens and decodes to an
empty text. Rows are independent: repeated rows, ties and other columns
don't matter. Texts of any length are encoded whole; a single word of n bytes
takes the time of n log n steps and some 200 n bytes of memory.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techtrail.llm.common import small_batches, text_or_empty

#: Pieces, and words, that a worker keeps in a table; when it is full, it becomes the older of two and a new one begins.
#: Longer ones than so many characters are not kept, so the four tables have some 500 MB at most, and 100 MB in ordinary text.
KEPT, SHORT = 250_000, 40

# Signs that no rule of the tokenizer joins with letters, and the one letter whose lower case depends on its place in Python.
SIGNS = "!#$%&()*+,-./:;=?@[]^_`{}~"
SIGMA = "\u03a3"

POSITION = (1 << 40) - 1

# Python's split() also cuts at these; the tokenizer's \s does not match them.
ODD_SPACES = regex.compile(r"[\x1c-\x1f]")
SPACES = regex.compile(r"[\s--\x1c-\x1f]+", regex.V1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge adjacent symbols, lowest rank first, leftmost among equals.

    ranks has the rank of a pair at left << 20 | right, merged the symbol that
    each rank makes. The heap holds rank << 40 | position; an entry is stale, and skipped, when the
    pair now at its position has another rank or none.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    get, before, after = ranks.get, list(range(-1, n - 1)), list(range(1, n + 1))
    now = [get(a << 20 | b) for a, b in itertools.pairwise(symbols)]
    now.append(None)
    heap = [rank << 40 | i for i, rank in enumerate(now) if rank is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i, rank = entry & POSITION, entry >> 40
        if now[i] != rank:
            continue
        j = after[i]
        symbols[i], symbols[j], now[j] = merged[rank], -1, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            now[i] = rank = get(symbols[i] << 20 | symbols[k])
            if rank is not None:
                heapq.heappush(heap, rank << 40 | i)
        else:
            now[i] = None
        if (h := before[i]) >= 0:
            now[h] = rank = get(symbols[h] << 20 | symbols[i])
            if rank is not None:
                heapq.heappush(heap, rank << 40 | h)
    return [x for x in symbols if x >= 0]


class WordBpe(dict):
    """What a piece between white space becomes: (ids in decimal, strings, tokens); filled as pieces are asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {vocabulary[a] << 20 | vocabulary[b]: i for i, (a, b) in enumerate(model["merges"])}
        self.merged = [vocabulary[a + b] for a, b in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: x for x, i in (vocabulary | self.special).items()}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.words = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.inner, self.last = [vocabulary[x] for x in byte_letters()], [vocabulary[x + end] for x in byte_letters()]
        self.known: dict[str, tuple[str, str, int]] = {}
        self.known_before: dict[str, tuple[str, str, int]] = {}
        self.pieces_before: dict[str, tuple[str, str, int]] = {}

    def said(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), " ".join([self.strings[x] for x in ids]), len(ids)

    def word(self, word: str) -> tuple[str, str, int]:
        made = self.known.get(word)
        if made is None:
            made = self.known_before.get(word)
            if made is None:
                data = word.encode()
                symbols = [self.inner[b] for b in data]
                symbols[-1] = self.last[data[-1]]
                made = self.said(merge_word(symbols, self.ranks, self.merged))
            if len(word) > SHORT:
                return made
            if len(self.known) >= KEPT:
                self.known_before, self.known = self.known, {}
            self.known[word] = made
        return made

    def parts(self, piece: str) -> list[tuple[str, str, int]]:
        found = []
        for i, part in enumerate(self.cut_special.split(piece)):
            if i % 2:
                found.append(self.said([self.special[part]]))
            elif part:
                plain = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                found += map(self.word, self.words.findall(plain))
        return found

    def __missing__(self, piece: str) -> tuple[str, str, int]:
        made = self.pieces_before.get(piece)
        if made is None:
            stem = piece.rstrip(SIGNS)
            low = stem.lower()
            if not (stem.isalpha() and low.isalpha() and SIGMA not in stem and unicodedata.is_normalized("NFC", stem)):
                made = joined(self.parts(piece))
            elif len(stem) == len(piece):
                made = self.word(low)
            else:  # letters and then signs: two words
                made = joined([self.word(low), self.word(piece[len(stem) :])])
        if len(piece) > SHORT:
            return made
        if len(self) >= KEPT:
            self.pieces_before = dict(self)
            self.clear()
        self[piece] = made
        return made


def joined(parts: list[tuple[str, str, int]]) -> tuple[str, str, int]:
    return " ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum([x[2] for x in parts])


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(text: str) -> list[str]:
    """What is between white space."""
    return [x for x in SPACES.split(text) if x] if ODD_SPACES.search(text) else text.split()


def encode_decode(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Adds ids (decimal, joined by one space), decoded and n_tokens to df."""
    kept = df.select("*", F.lit("").alias("ids"), F.lit("").alias("decoded"), F.lit(0).cast("long").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in small_batches(batches, column):
            ids, decoded, counts = [], [], []
            for text in batch.column(column).to_pylist():
                found = [x for x in map(bpe.__getitem__, pieces(text or "")) if x[2]]
                ids.append(" ".join([x[0] for x in found]))
                decoded.append(" ".join([x[1] for x in found]))
                counts.append(sum([x[2] for x in found]))
            made = [pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "ids", "decoded", "n_tokens"])

    return df.mapInArrow(run, kept.schema)


def op10_word_bpe(spark, sf_dir):
    """Ids and decoded texts of documents under the word BPE tokenizer."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    return encode_decode(documents, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
