import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from techtrail.llm import packing, word_bpe
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a", "a  b ", "a \n b", "a\x1cb \x1f c", "<|endoftext|>abc <|STARTOFTEXT|> x<|startoftext|>", "Σας ΟΔΟΣ İstanbul ǅ", "é ̸< ̸", "don't 'S 'ſ 12345 ½ ²", "日本語 🙂🙂‍👩", "​a ﬁ \x85a", "A" * 3000, "a " * 3000]


def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + ODD


def test_word_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rows = Tokenizer.from_file(path), texts(spark)
    frame = spark.createDataFrame([(i, x, "clash", "x") for i, x in enumerate(rows)], "doc_id long, text string, other string, piece string")
    found = {r["doc_id"]: r for r in word_bpe.encode_decode(frame, path).collect()}
    for i, x in enumerate(rows):
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert found[i]["ids"] == " ".join(map(str, ids))
        assert found[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert found[i]["n_tokens"] == len(ids)


def test_word_bpe_tables_turn_over(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "KEPT", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, bpe = Tokenizer.from_file(path), word_bpe.WordBpe(path)
    for x in texts(spark)[:20]:
        assert " ".join(y[0] for y in map(bpe.__getitem__, word_bpe.pieces(x))) == " ".join(map(str, library.encode(x, add_special_tokens=False).ids))


def test_long_pieces_are_not_kept():
    bpe = word_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(300):
        bpe[f"{'long' * 1000}{i}"]
        bpe[f"{'x!' * 2000}{i}"]
    assert not bpe and not any(len(x) > word_bpe.SHORT for x in bpe.known) and len(bpe.known) < 1000


def test_one_very_long_word(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    frame = spark.createDataFrame([(1, "a" * 200_000), (2, "ab" * 100_000)], "doc_id long, text string")
    for r in word_bpe.encode_decode(frame, path).collect():
        assert r["ids"] == " ".join(map(str, Tokenizer.from_file(path).encode(r["text"], add_special_tokens=False).ids))


def test_very_long_runs_are_tokenised_as_by_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, bpe = Tokenizer.from_file(path), packing.ByteBpe(path)
    rng = np.random.default_rng(4)
    letters = "".join(map(chr, rng.integers(32, 0x3000, 300_000).tolist()))
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "word" + " \n" * 300_000 + "word", " a" * 300_000, letters):
        assert bpe.text(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_buckets_of_any_number_give_whole_plans(spark, monkeypatch):
    monkeypatch.setattr(packing, "IN_BUCKET", 2)
    monkeypatch.setattr(packing, "BUCKETS", 3)
    pieces = spark.createDataFrame([(i, 0, 0, 700 if i % 3 else 900, i) for i in range(500)], "doc_id long, piece long, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 500


def plain_merge(symbols, ranks, merged):
    symbols = list(symbols)
    while pairs := [(ranks[a << 20 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a << 20 | b in ranks]:
        rank, i = min(pairs)
        symbols[i : i + 2] = [merged[rank]]
    return symbols


def test_merging_matches_repeated_search():
    rng = np.random.default_rng(2)
    merged, ranks = [], {}
    for new in range(4, 40):
        a, b = rng.integers(0, new, 2).tolist()
        if a << 20 | b not in ranks:
            ranks[a << 20 | b] = len(merged)
            merged.append(new)
    for _ in range(200):
        word = rng.integers(0, 4, rng.integers(1, 40)).tolist()
        assert word_bpe.merge_word(word, ranks, merged) == plain_merge(word, ranks, merged)


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), texts(spark)
    frame = spark.createDataFrame([(i, x or "") for i, x in enumerate(rows)], "doc_id long, text string")
    pieces = packing.token_pieces(frame, path).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, x in enumerate(rows):
        ids = np.array([*library.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert k == 0 or r["length"] == 2048
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 30, 400, 3000, 20000][seed]
    lengths = np.minimum(rng.lognormal(6, 1.2, n).astype(int) + 1, 2048)
    histogram = Counter(lengths.tolist())
    plan = packing.plan(histogram)
    assert all(0 < sum(x) <= 2048 and times > 0 for x, times in plan)
    placed = Counter()
    for x, times in plan:
        for length in x:
            placed[length] += times
    assert placed == histogram
    sequences, bound = sum(times for _, times in plan), -(-int(lengths.sum()) // 2048)
    assert sequences <= bound * 1.02 + 2


@pytest.mark.parametrize("large", packing.LARGE)
def test_grouped_plans_are_whole_for_each_threshold(large):
    rng = np.random.default_rng(9)
    histogram = Counter(rng.integers(1, 2048, 5000).tolist() + [700] * 900 + [683] * 600)
    plan = packing.plan_above(histogram, 2048, packing.GROUPS, large)
    placed = Counter()
    for x, times in plan:
        assert sum(x) <= 2048
        for length in x:
            placed[length] += times
    assert placed == histogram


def test_configurations_beat_best_fit_where_it_is_weak():
    histogram = {1000: 3000, 700: 3000, 348: 3000, 500: 3000, 450: 3000, 1098: 3000}
    best = sum(n for _, n in packing.plan(histogram))
    assert best <= sum(n for _, n in packing.plan_above(histogram, 2048, packing.GROUPS, 1 / 2))
    assert best <= 1.01 * sum(k * v for k, v in histogram.items()) / 2048 + 1


def test_packing_is_gapless(spark):
    rows = [(i, "word " * k) for i, k in enumerate([0, 1, 5, 700, 2047, 2048, 3000, 9000, 5, 5])] + [(3, "word " * 700), (None, "x"), (11, None)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({(r["doc_id"], r["piece"]) for r in packed if r["doc_id"] is not None}) + 1 + 1 == len(packed)  # one row is repeated, one id is null
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests(spark):
    row = word_bpe.op10_word_bpe(spark, SMALL).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").first()["text"]
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
