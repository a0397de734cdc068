import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from techtrail.llm import spelling

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n long, id string, form string, key long"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point, tried out."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def found(spark, rows):
    frame = spark.createDataFrame([(d, t, "clash", 1, "x", "y", 2) for d, t in rows], SCHEMA)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in spelling.spelling_variants(frame).select(*columns).collect())


def test_words_match_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abÀÿ×") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    base += ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "aaaaaba", "baaaaaa"]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, [1 / (k + 1) ** 2 for k in range(len(base))], k=60))) for i in range(60)]
    rows += [(3, None), (None, "aaaaaaaa, aaaaaaaa1aaaaaaa"), (4, ""), (5, "short words only"), (70, "chainone " * 2 + "chainonx " * 20 + "chainoxx " * 200 + "chainzxx " * 2001), *rows[:5]]
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain of forms


def test_ties_go_to_the_first_word(spark):
    rows = [(0, "zbcdefgh zbcdefgh " + "abcdefgh ybcdefgh " * 40)]
    got = {r[0]: r for r in found(spark, rows)}
    assert got["zbcdefgh"][1:] == ("abcdefgh", "abcdefgh", 2, 2, 40) and got == {r[0]: r for r in brute(rows)}


def test_very_long_words_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(spelling.grouped, "__defaults__", (2, 16, 4, 1 << 18))  # groups of more than four words are dealt again
    rng = random.Random(4)
    stem = "".join(rng.choice("abc") for _ in range(60))
    words = {stem[:30] + "".join(rng.choice("ab") for _ in range(5)) + stem[30:] for _ in range(25)}
    words |= {stem[:31] + stem[32:], stem, stem + "a", "b" + stem, "x" * 50_000, "x" * 49_999, "x" * 25_000 + "y" + "x" * 24_999}
    rows = [(1, " ".join(sorted(words) * 2))]
    assert found(spark, rows) == brute(rows)


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "a b c"), (3, "abcdefgh")]) == []


def test_tiles_find_what_single_comparisons_find():
    rng = random.Random(6)
    for tile in (1, 3, 16):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice((7, 8)))) for _ in range(120)})
        points, begin = spelling.code_points(pa.array(words))
        n, sizes = len(words), np.diff(begin)
        whole = np.zeros(n, int)
        a, b = spelling.compare(points, begin[:-1], sizes, 8, whole, whole + 8, whole, tile)
        got = {frozenset((words[i], words[j])) for i, j in zip(a, b, strict=True)}
        assert len(got) == len(a)
        assert got == {frozenset((x, y)) for x in words for y in words if x < y and max(len(x), len(y)) == 8 and one_edit(x, y)}


def test_other_alphabets(spark):
    words = spark.createDataFrame([("日本語の単語です", 2), ("日本語の単語でした", 2), ("日本語の単語でし", 2), ("🙂🙂🙂🙂🙂🙂🙂", 2), ("🙂🙂🙂🙂🙂🙂", 3)], "word string, n long")
    got = {(r["word"], r["other"], r["other_n"]) for r in spelling.near_pairs(words).collect()}
    names = {r["word"]: r["n"] for r in words.collect()}
    assert got == {(a, b, names[b]) for a in names for b in names if one_edit(a, b)}


def test_query_equals_its_sql(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = duck.execute(spelling.ORACLE_SQL)
    columns = [x[0] for x in wanted.description]
    rows = spelling.op12_spelling_tiles(spark, str(tmp_path))
    assert set(rows.columns) == set(columns)
    key = lambda r: r[columns.index("word")]
    assert sorted((tuple(r) for r in rows.select(*columns).collect()), key=key) == sorted(wanted.fetchall(), key=key)
