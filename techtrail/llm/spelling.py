"""Spelling variants: words of a corpus, pairs of them one edit apart, and each word's prevailing form.

Of two different words, let L be the longer one's length, p their common prefix's and s their common suffix's. They are one inserted, deleted or replaced
code point apart exactly if p + s >= L - 1, and the edit stands at p. The L places are cut into windows; a pair whose edit stands in
the window [low, high) shares its first low code points and its last L - high. So words are dealt by (L, window, those two ends), as words of length L and as the shorter
words of a pair of length L + 1, and every pair meets in one group, that of the window with its p, and is found there once.

Within a group, words are rows of padded matrices of code points, one aligned at the left and one at the right, and tiles of TILE rows are compared
with each other densely: p and s of all pairs of two tiles at once. Windows have WINDOW places, so that a group holds words that differ in these alone; the
longest words have no more than WINDOWS windows, wider ones, and of these the groups with more than CROWD words (or very many letters) are dealt again by halves of their window, until they are small or the window has WINDOW places. No group is the corpus's share of a
common beginning or ending.

Words are counted before they are compared. What a driver holds are numbers of rows.

Defined cases: a null text has no words; a null doc_id counts as the empty text in the hash. Rows that are repeated count again. Among near words of equal number the first in code-point order is the form.
A word of a million letters is compared with those of its group like any other. No words: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from techtrail.llm.common import stash

#: Code points and occurrences that a word has at least; how many times a form must be as frequent as its word.
LENGTH, TIMES, RATIO = 7, 2, 10

#: Of so many hashes one loses a code point of its run.
DAMAGE = 31

WINDOW, WINDOWS = 2, 16

#: Words, and code points, of a group that is compared as it is.
CROWD, LETTERS = 512, 1 << 22

TILE = 16

#: Bytes of one comparison of tiles.
ROOM = 1 << 22

# The letters of a run, and those whose case is dropped.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(documents: DataFrame, least: int = LENGTH, damage: int = DAMAGE) -> DataFrame:
    """word: of each run of letters with so many code points or more what is left of it after damage. Shorter runs can't give a word, so they are not made rows."""
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{least},}})"), F.lit(1))).alias("run"))
    lower = found.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word, n."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _ends(low: Column, high: Column) -> Column:
    """Hash of what a word shares with the words of its group: its length as the longer word, the window, and what stands before and after it."""
    return F.xxhash64("longer", low, high, F.left("word", low), F.right("word", F.col("longer") - high))


def _keyed(words: DataFrame, window: int, windows: int) -> DataFrame:
    """word, n, longer, low, high, key: a row for each group of a word."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    rows = rows.withColumn("parts", F.least(F.ceil(F.col("longer") / window), F.lit(windows)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bound = lambda k: F.expr(f"cast(cast(part + {k} as bigint) * longer div parts as int)")
    rows = rows.select("word", "n", "longer", bound(0).alias("low"), bound(1).alias("high"))
    return rows.withColumn("key", _ends(F.col("low"), F.col("high")))


def grouped(words: DataFrame, window: int = WINDOW, windows: int = WINDOWS, crowd: int = CROWD, letters: int = LETTERS) -> DataFrame:
    """word, n, longer, low, high, key of the groups in which words (word, n) are compared.

    Windows of more than ``window`` places, which only words of more than window * windows code points have, are halved in crowded groups. Their groups are counted when this is called, in as many
    rounds as halving takes.
    """
    every = _keyed(words, window, windows)
    settled = every.where(F.col("high") - F.col("low") <= window)
    wide = stash(every.where((F.char_length("word") >= window * windows) & (F.col("high") - F.col("low") > window)))
    while not wide.isEmpty():
        sizes = wide.groupBy("key").agg(F.count("*").alias("words"), F.max("longer").cast("long").alias("longest"))
        crowded = stash(sizes.where((F.col("words") > crowd) | (F.col("words") * F.col("longest") > letters)).select("key"))
        settled = settled.unionByName(wide.join(crowded, "key", "left_anti").select(*wide.columns))
        middle = F.expr("cast((low + high) div 2 as int)")
        halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
        again = wide.join(crowded, "key", "left_semi").select("word", "n", "longer", F.explode(halves).alias("h")).select("word", "n", "longer", "h.low", "h.high")
        again = again.withColumn("key", _ends(F.col("low"), F.col("high")))
        settled = settled.unionByName(again.where(F.col("high") - F.col("low") <= window))
        wide = stash(again.where(F.col("high") - F.col("low") > window))
    return settled


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of words, in the narrowest type, and where each word begins (one more at the end)."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    kind = np.uint8 if not points.size or points.max() < 1 << 8 else np.uint16 if points.max() < 1 << 16 else np.uint32
    return points.astype(kind), np.append(0, np.cumsum(sizes))


def _padded(points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int, right: bool) -> np.ndarray:
    """Words as rows of a matrix, aligned at one side. What is no code point of a word differs from row to row of unlike lengths only, which is all that is asked of it."""
    place = np.arange(width)[None, :]
    place = place - (width - sizes)[:, None] if right else np.broadcast_to(place, (len(sizes), width))
    inside = (place >= 0) & (place < sizes[:, None])
    made = np.zeros((len(sizes), width), points.dtype)
    made[inside] = points[(begin[:, None] + place)[inside]]
    return made


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all pairs of rows of tiles: a, b (tiles, rows, width) give (tiles, rows, rows)."""
    unlike = a[:, :, None, :] != b[:, None, :, :]
    return np.where(unlike.any(axis=3), unlike.argmax(axis=3), a.shape[2])


def compare(points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, longer: int, low: np.ndarray, high: np.ndarray, group: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) one edit apart whose edit is in their window, of different words of length longer or longer - 1 that are sorted by group (0, 1, ...)."""
    n = len(sizes)
    tile = max(1, min(tile, int((ROOM / longer) ** 0.5)))
    tiles = -(-n // tile)
    rows = np.minimum(np.arange(tiles * tile), n - 1)  # the last row again, to fill the last tile
    real = (np.arange(tiles * tile) < n).reshape(tiles, tile)
    left, right = (_padded(points, begin, sizes, longer, side) for side in (False, True))
    right = right[:, ::-1]
    first, last = group[np.arange(tiles) * tile], group[np.minimum(np.arange(1, tiles + 1) * tile, n) - 1]
    found_a, found_b = [], []
    step = max(1, ROOM // (tile * tile * longer))
    reach = 0
    while True:
        near = np.flatnonzero(last[: tiles - reach] == first[reach:]) if reach else np.arange(tiles)  # tiles that share a group with the one so many further
        if not len(near):
            break
        for k in range(0, len(near), step):
            one = near[k : k + step]
            two = one + reach
            a, b = (rows.reshape(tiles, tile)[x] for x in (one, two))
            may = (group[a][:, :, None] == group[b][:, None, :]) & real[one][:, :, None] & real[two][:, None, :]
            may &= (sizes[a][:, :, None] == longer) | (sizes[b][:, None, :] == longer)
            if not reach:
                may &= np.triu(np.ones((tile, tile), bool), 1)[None]
            busy = may.any(axis=(1, 2))
            if not busy.any():
                continue
            a, b, may = a[busy], b[busy], may[busy]
            p = np.minimum(_common(left[a], left[b]), longer - 1)
            s = _common(right[a], right[b])
            may &= (p + s >= longer - 1) & (p >= low[a][:, :, None]) & (p < high[a][:, :, None])
            t, i, j = np.nonzero(may)
            found_a.append(a[t, i])
            found_b.append(b[t, j])
        reach += 1
    whole = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return whole(found_a), whole(found_b)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of near pairs from rows (word, n, longer, low, high, key), sorted by longer and key."""
    held: list[pa.RecordBatch] = []

    def compared(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, n = rows.column(0), rows.column(1)
        longer, low, high, key = (rows.column(j).to_numpy(zero_copy_only=False) for j in range(2, 6))
        new = np.append(True, (key[1:] != key[:-1]) | (longer[1:] != longer[:-1]))
        group = np.cumsum(new) - 1
        kept = np.flatnonzero(np.bincount(group)[group] > 1)  # words that are alone in their group meet no one
        if not len(kept):
            return
        words, n, longer, low, high, group = words.take(pa.array(kept)), n.take(pa.array(kept)), longer[kept], low[kept], high[kept], group[kept]
        points, begin = code_points(words)
        sizes = np.diff(begin)
        ends = np.append(np.flatnonzero(longer[1:] != longer[:-1]) + 1, len(longer))
        at = 0
        for end in ends:
            own = slice(at, end)
            a, b = compare(points, begin[:-1][own], sizes[own], int(longer[at]), low[own], high[own], group[own])
            if len(a):
                one, two = pa.array(np.concatenate((a, b)) + at), pa.array(np.concatenate((b, a)) + at)
                yield pa.RecordBatch.from_arrays([words.take(one), words.take(two), n.take(two)], names=["word", "other", "other_n"])
            at = end

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        longer, key = rows.column(2).to_numpy(zero_copy_only=False), rows.column(5).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((key[1:] != key[:-1]) | (longer[1:] != longer[:-1]))
        if len(changes):  # all groups but the last are whole
            yield from compared(rows.slice(0, changes[-1] + 1))
            held = [rows.slice(changes[-1] + 1)]
        else:
            held = [rows]
    if held:
        yield from compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def near_pairs(words: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of the pairs of words (word, n) that are one edit apart."""
    met = grouped(words).repartition("longer", "key").sortWithinPartitions("longer", "key").select("word", "n", "longer", "low", "high", "key")
    return met.mapInArrow(_pairs, "word string, other string, other_n long")


def with_forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n."""
    best = F.struct((-F.col("other_n")).alias("less"), F.col("other"))
    rows = pairs.select("word", F.lit(None).cast("long").alias("n"), best.alias("best"))
    rows = words.select("word", "n", F.lit(None).cast(rows.schema["best"].dataType).alias("best")).unionByName(rows)
    made = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    return made.select("word", "n", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds root: the end of the chain of forms that begins with a word.

    A form is at least RATIO times as frequent, so chains are no longer than the logarithm of the largest number; the reach of each word's known link doubles in a round.
    """
    links = stash(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stash(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = now.select("word", "root")
        if now.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(documents: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of documents (doc_id, text)."""
    words = stash(vocabulary(runs(documents)))
    return with_roots(stash(with_forms(words, near_pairs(words))))


def op12_spelling_tiles(spark, sf_dir):
    """The words of all documents with their near words, forms and roots."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


def _oracle() -> str:
    """Near words by the texts that are left when a code point is taken out, in place of tiles; the checksum by half bytes."""
    half = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        half.append(i)
    take = lambda c: f"xor(({c}) >> 4, list_extract({half}, ((({c}) & 15) + 1)::INTEGER)::BIGINT)"
    byte = lambda i: f"((instr('0123456789ABCDEF', substr(x, {i}, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, {i} + 1, 1)) - 1)::BIGINT"
    return f"""WITH RECURSIVE found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]{{{LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
hexed AS (SELECT doc_id, run, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x, count(*) AS times FROM found GROUP BY doc_id, run),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: {byte("i")})), lambda c, b: {take(take("xor(c, b)"))}), 4294967295::BIGINT) AS h FROM hexed),
cut AS (SELECT times, CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(times) >= {TIMES}),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.rest = w.word UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN -b.less >= {RATIO} * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, max_by(root, steps) AS root FROM chain GROUP BY word) c USING (word)"""


ORACLE_SQL = _oracle()
