"""Secrets in texts: fixed patterns, and novelty under a primed compressor.

Patterns give the base spans. The method adds more: near a word such as "secret" or
"credential", each string of letters, digits and + / _ = - of CANDIDATE characters or more is a candidate, or of ALIKE if it is of letters alone or digits alone, as names and numbers are. Near is as far as NEAR code points, and on as long as
strings of BLOCK characters or more follow one another, as in a key of many lines. A private key between its BEGIN and END lines is one candidate. Its novelty is the number of bytes that it adds
to what zstandard makes of the text around it (without the candidates in it, which may be copies), where the compressor is primed with a
dictionary of code words and of the identifiers that stand in such surroundings anywhere in the corpus. Names and paths add few bytes;
strings of at least ``novel`` added bytes a character are reported.

Defined results: a null text is an empty one, without spans; rows are independent, so repeated
rows have equal results; an empty table gives an empty result. Positions are code points, ends
exclusive. Long texts and long strings are read whole, in time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from techtrail.llm.common import small_batches, text_or_empty

#: Kinds of spans, in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "novel"]

# The base patterns, and how long their matches must be. A run of hex digits or an access key is matched whole.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authorization|AKIA", re.IGNORECASE | re.ASCII)
STRING = re.compile(r"[A-Za-z0-9+/_=-]+")
STRING_END = re.compile(r"[A-Za-z0-9+/_=-]*\Z")
#: Characters of a candidate at least: of one with letters and digits, of letters alone or digits alone, and of one that goes on with the string before it.
CANDIDATE, ALIKE, BLOCK = 12, 24, 32
# The lines around a private key, and what may stand between the strings of one value.
PEM_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
BETWEEN = re.compile(r"""[\s"'\\,+]{1,64}""")
IDENTIFIER = re.compile(r"[A-Za-z_]{3,32}")
#: Code points on either side of a sensitive word where candidates are sought at least, and around a candidate that are compressed with it.
NEAR = 96
#: Bytes a character that a reported string adds at least, and the identifiers in the dictionary.
NOVEL, IDENTIFIERS = 0.6, 2000

# Words of configuration and code that any dictionary has.
CODE_WORDS = """import from return const static final public private class function export default string bytes base64 sha256 md5 uuid
https http localhost example com org net www api auth oauth bearer authorization header content type application json client_id
client_secret access_key_id secret_access_key aws_access_key_id aws_secret_access_key password passwd passphrase secret token
api_key apikey private_key public_key BEGIN END RSA PRIVATE KEY environment variable config settings credentials username user
database host port connection url endpoint region bucket""".split()


def _continued(text: str, end: int) -> int:
    """Where the strings that follow one another from end on come to their end: long ones, with blanks, quotes and the like between them."""
    at = STRING.match(text, end)
    end = at.end() if at and end and STRING.match(text, end - 1) else end  # the string that the window cuts
    if not (end and STRING.match(text, end - 1)):
        return end
    while (gap := BETWEEN.match(text, end)) and (more := STRING.match(text, gap.end())) and more.end() - more.start() >= BLOCK:
        end = more.end()
    return end


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches near sensitive words, merged where they overlap, and on to the end of the strings that follow one another at their end."""
    begin = end = -1
    for m in SENSITIVE.finditer(text):
        a, b = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if a > end:
            if end >= 0:
                yield begin, end
            begin = a
        if b > end:
            end = _continued(text, b)
    if end >= 0:
        yield begin, end


def private_keys(text: str) -> list[tuple[int, int]]:
    """(begin, end) of private keys, from their BEGIN to their END line; one that has no END, or another BEGIN before it, ends with the strings that follow one another."""
    found: list[tuple[int, int]] = []
    begins, ends = [m.span() for m in PEM_BEGIN.finditer(text)], [m.span() for m in PEM_END.finditer(text)]
    k = 0
    for i, (a, b) in enumerate(begins):
        while k < len(ends) and ends[k][0] < b:
            k += 1
        limit = begins[i + 1][0] if i + 1 < len(begins) else len(text)
        if k < len(ends) and ends[k][0] < limit:
            found.append((a, ends[k][1]))
        elif (gap := BETWEEN.match(text, b)) and (more := STRING.match(text, gap.end())) and more.end() - more.start() >= BLOCK:
            found.append((a, min(limit, _continued(text, more.end()))))
    return found


def is_candidate(found: str) -> bool:
    if len(found) < CANDIDATE:
        return False
    return len(found) >= ALIKE or bool(re.search("[0-9]", found) and re.search("[A-Za-z]", found))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Private keys, and whole strings outside them that begin or end near a sensitive word and are long enough."""
    keys = private_keys(text) if "PRIVATE KEY" in text else []
    k = done = 0
    for begin, end in windows(text):
        begin, size = max(begin, done), 64
        while begin > done and STRING.match(text, begin - 1):  # the string that the window cuts begins before it
            low = max(done, begin - size)
            begin, size = low + STRING_END.search(text[low:begin]).start(), 2 * size
        while begin < end and (m := STRING.search(text, begin, end)):
            a, begin = m.start(), m.end()
            if begin == end:
                begin = STRING.match(text, a).end()
            while k < len(keys) and keys[k][0] <= a:
                yield keys[k]
                done = keys[k][1]
                k += 1
            if a < done:
                begin = max(begin, done)
                continue
            done = begin
            if is_candidate(text[a:begin]):
                yield a, begin
    yield from keys[k:]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def added_bytes(compressor: zstandard.ZstdCompressor, before: str, text: str, after: str) -> int:
    """Bytes that text adds to what its surroundings compress to."""
    around = len(compressor.compress((before + after).encode()))
    return len(compressor.compress((before + text + after).encode())) - around


def without(text: str, begin: int, end: int, spans: list[tuple[int, int]], secret: str) -> str:
    """text[begin:end] without the spans (sorted) and without the places of a secret, those that reach over its ends too."""
    at = text.find(secret, max(0, begin - len(secret)), end + len(secret))
    gone = [(a, b) for a, b in spans if a < end and begin < b]
    while at >= 0:
        gone.append((at, at + len(secret)))
        at = text.find(secret, at + 1, end + len(secret))
    parts = []
    for a, b in sorted(gone):
        parts.append(text[begin : max(begin, min(a, end))])
        begin = max(begin, b)
    return "".join([*parts, text[begin:end]])


def novel_spans(text: str, compressor: zstandard.ZstdCompressor, taken: list[tuple[int, int, int]], novel: float = NOVEL) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that add enough to their surroundings, in which no candidate stands: a copy nearby takes nothing away."""
    found, sought = [], list(candidates(text))
    k = reached = 0
    for i, (a, b) in enumerate(sought):
        while k < len(taken) and taken[k][0] < b:
            reached, k = max(reached, taken[k][2]), k + 1
        if reached > a:
            continue
        first = last = i
        while first and sought[first - 1][1] > a - NEAR:
            first -= 1
        while last + 1 < len(sought) and sought[last + 1][0] < b + NEAR:
            last += 1
        near, secret = sought[first : last + 1], text[a:b]
        if added_bytes(compressor, without(text, max(0, a - NEAR), a, near, secret), secret, without(text, b, min(len(text), b + NEAR), near, secret)) >= novel * (b - a):
            found.append((a, 3, b))
    return found


def primed(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=data, write_checksum=False, write_content_size=False)


def values(text: str) -> list[tuple[int, int]]:
    """(begin, end), sorted, of what may be secret: candidates, and the base patterns' values (an assigned one without its name)."""
    found = [*candidates(text), *(m.span(2) for m in ASSIGN.finditer(text)), *(m.span() for x in (ACCESS, HEX) for m in x.finditer(text))]
    return sorted(found)


def identifiers(text: str) -> set[str]:
    """The identifiers near sensitive words, without what is part of a candidate or of a base pattern's value."""
    found: set[str] = set()
    near = list(windows(text))
    secret = values(text) if near else []
    k = gone = 0
    for begin, end in near:
        begin = max(begin, min(gone, end))
        while k < len(secret) and secret[k][0] < end:
            a, b = secret[k]
            if begin < a:
                found.update(IDENTIFIER.findall(text, begin, a))
            gone, k = max(gone, b), k + 1
            begin = max(begin, min(gone, end))
        found.update(IDENTIFIER.findall(text, begin, end))
    return found


def identifier_dictionary(df: DataFrame, size: int = IDENTIFIERS) -> bytes:
    """The identifiers near sensitive words in most different texts (at most ``size``), the most frequent last."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found: set[tuple[str, int]] = set()
            for text in set(batch.column("text").to_pylist()):
                if text and (near := identifiers(text)):
                    digest = xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
                    found.update((word, digest) for word in near)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["word", "digest"])

    counted = df.select("text").mapInArrow(words, "word string, digest long").distinct().groupBy("word").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).collect()
    found = sorted(((r["n"], r["word"]) for r in top))
    return " ".join([*CODE_WORDS, *(word for _, word in found)]).encode()


SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def find_secrets(df: DataFrame, dictionary: bytes, novel: float = NOVEL) -> DataFrame:
    """Adds, or replaces, secret_spans: kind, start and end of each span in text, by start and then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = primed(dictionary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small_batches(batches, "text"):
            spans = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                both = sorted([*base, *novel_spans(text or "", compressor, base, novel)])
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in both])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "secret_spans"])

    kept = df.drop("secret_spans")
    schema = StructType([*(StructField(x.name, x.dataType) for x in kept.schema.fields), StructField("secret_spans", SPAN)])
    return kept.mapInArrow(run, schema)


def redact(df: DataFrame, dictionary: bytes, mark: str = "[secret]", novel: float = NOVEL) -> DataFrame:
    """df with each span of text (overlapping ones as one) replaced by a mark; texts without spans stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = primed(dictionary)
        for batch in small_batches(batches, "text"):
            texts = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                both = sorted([*base, *novel_spans(text or "", compressor, base, novel)])
                if not both:
                    texts.append(text)
                    continue
                parts, at = [], 0
                for a, _, b in both:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                texts.append("".join([*parts, text[at:]]))
            columns = list(batch.columns)
            columns[batch.schema.get_field_index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def op9_secret_novelty(spark, sf_dir):
    """Spans of secrets in each document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    found = find_secrets(documents, identifier_dictionary(documents)).drop("text")
    said = F.transform("secret_spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = F.filter(said, lambda x: ~x.startswith("novel"))
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(said, ",").alias("spans"), count("novel"))
