"""One very long text among short ones, in the operators whose other tests have none."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from techtrail.llm import language_ppm, quality_rules, simhash, telephony

rng = random.Random(11)
LONG = " ".join(rng.choice(["alpha", "Beta", "gamma\n", "δέλτα", "e!", "zz", "#", f"n{k}"]) for k in range(250_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(1, LONG, "en", "s", 1), (2, LONG, "en", "s", 1), (3, "short", "en", "s", 1)], SCHEMA)


def test_media_of_a_long_text(frame):
    found = {r["doc_id"]: r for r in telephony.store_and_read(telephony.text_payload(frame)).select("doc_id", "payload", "n_bytes").collect()}
    data = LONG.encode()
    padded = data + b"\xff" * (-len(data) % 576)
    assert len(data) > 1_000_000 and found[1]["n_bytes"] == len(data) and sha256(bytes(found[1]["payload"])).digest() == sha256(padded).digest() and found[1]["payload"] == found[2]["payload"]


def test_fingerprint_of_a_long_text(frame):
    import xxhash

    words = LONG.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    found = {r["doc_id"]: (r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(frame).collect()}
    assert found[1] == found[2] == (want, 1)


def test_counts_of_a_long_text(frame):
    words = re.findall(r"[^\x20\x09-\x0D]+", LONG)
    times, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if times[words[i], words[i + 1], words[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    row = {r["doc_id"]: r for r in quality_rules.judged(frame).collect()}[1]
    assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))


def test_language_of_a_long_text(spark):
    rows = [(i, "the cat and the dog sat here " * 3 if i % 2 else "le chat et le chien sont ici " * 3, "en" if i % 2 else "fr") for i in range(200)]
    tables = language_ppm.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = spark.createDataFrame([(1, "the dog sat " * 100_000), (2, "le chien ici " * 100_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_ppm.identify(long, tables).collect()} == {1: "en", 2: "fr"}


def test_equal_languages_go_to_the_first(spark):
    """Two languages with the same texts have the same code lengths."""
    rows = [(i, "one and the same text ", lang) for i, lang in enumerate(["zz", "aa", "mm"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = frame.where(~language_ppm.held_out())
    same = own.groupBy("lang").count().agg(F.min("count")).first()[0]
    parts = [own.where(F.col("lang") == x).limit(same) for x in ("aa", "mm", "zz")]
    found = language_ppm.identify(frame.drop("lang"), language_ppm.learn(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    assert {r["lang_pred"] for r in found.collect()} == {"aa"}
    assert zlib.crc32(b"0") % 4 != 2
