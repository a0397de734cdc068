"""Quality rules with thresholds that adapt to language and source, in DataFrame operations alone.

Each text is measured (``measure``). For each language and source a quantile sketch of each measure is built: counts in buckets that are
exact up to 64 and 1/32 of a power of two wide above. Such sketches merge by adding counts, so they are aggregated before anything
is shuffled, and a group with few texts takes the sketch of its language, or of all texts. From the quartiles of a sketch
come the fences (third quartile and three times the quartiles' distance, which counts as at least a slack of its own); the fences are
joined to the texts, and a text outside any of them is rejected.

Counts are whole numbers and quartiles are edges of buckets, so results are exact and the same however the input is cut.

Defined results: a null text has no words and fails; null languages and sources are groups like others; rows are measured one
by one, so repeated rows have equal results; an empty table gives an empty result. Long texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from techtrail.llm.common import stash, text_or_empty

SPACES = r"[\x20\x09-\x0D]"
#: Bits of a window's number that are its place in the text; the others are of its hash.
PLACE_BITS = 24
#: Texts that a group needs for a sketch of its own.
LEAST_TEXTS = 50
#: Quartile distances beyond the quartile at which a text is rejected.
FENCE = 3
#: (measure, least quartile distance): shares are per mille, word_length is in hundredths.
MEASURES = [("symbols", 10), ("dup_lines", 120), ("repeats", 60), ("capitals", 60), ("exclamations", 20), ("word_length", 40)]


def measure(df: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, and the measures that have fences."""
    # Columns that are used more than once are made in steps of their own, so that no text is cut twice.
    texts = df.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    cut = texts.select(
        "*",
        F.filter(F.split("text", SPACES + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    size = F.length("text")
    counted = cut.select(
        "doc_id",
        "lang",
        "source",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (size - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        (size - F.length(F.translate("text", "!", ""))).cast("long").alias("n_exclamations"),
    )
    # A window of three words as one number: 40 bits of its hash, and the place of its first word. Sorted, equal windows are neighbours,
    # unless another window of the same 40 bits stands between them.
    windows = F.when(
        F.col("n_words").between(3, 1 << PLACE_BITS),
        F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_words") - 2), lambda i: F.xxhash64(F.slice("words", i.cast("int"), F.lit(3))).bitwiseAND(F.lit(~((1 << PLACE_BITS) - 1))).bitwiseOR(i)),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = counted.select("*", F.sort_array(windows).alias("windows"))
    met = _neighbours("windows", lambda a, b: F.when(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.when(_window(_place(a)) == _window(_place(b)), F.array(_place(a), _place(b))).otherwise(F.array(F.lit(0)))))
    found = placed.select("*", F.flatten(F.filter(met, lambda x: x.isNotNull())).alias("found"))
    # Where different windows share their bits (0 marks it), and in texts with more places than there are bits, the windows' own texts are sorted.
    texts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.struct(F.array_join(_window(i), " ").alias("window"), i.alias("place")))
    exact = _neighbours(F.sort_array(texts), lambda a, b: F.when(a["window"] == b["window"], F.array(a["place"], b["place"])))
    unsure = F.array_contains("found", 0) | (F.col("n_words") > 1 << PLACE_BITS)
    repeated = found.select("*", F.array_distinct(F.when(unsure, F.flatten(F.filter(exact, lambda x: x.isNotNull()))).otherwise(F.col("found"))).alias("repeated"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("repeated", lambda i: F.array(i, i + 1, i + 2)))))
    base = repeated.withColumn("n_repeat_words", covered.cast("long"))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    share = lambda part, whole: F.floor(1000 * F.col(part) / whole).cast("long")
    return base.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", chars).alias("symbols"),
        share("n_dup_lines", lines).alias("dup_lines"),
        share("n_repeat_words", words).alias("repeats"),
        share("n_capitals", chars).alias("capitals"),
        share("n_exclamations", words).alias("exclamations"),
        F.floor(100 * F.col("word_chars") / words).cast("long").alias("word_length"),
    )


def _place(window: Column) -> Column:
    return window.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _window(place: Column) -> Column:
    return F.slice("words", place, F.lit(3))


def _neighbours(sorted_windows: Column | str, pair: Callable[[Column, Column], Column]) -> Column:
    """pair of each two windows that stand side by side; null where there is no next one."""
    rest = F.slice(sorted_windows, 2, F.greatest(F.size(sorted_windows), F.lit(1)))
    return F.zip_with(sorted_windows, rest, lambda a, b: F.when(b.isNotNull(), pair(a, b)))


def bucket(x: Column) -> Column:
    """The sketch's bucket of a whole number, as the bucket's lower edge."""
    fine = F.length(F.bin(x)) - 6  # bits below the six that count
    return F.when(x < 64, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, fine), fine))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, edge, n: how many texts have the measure in the bucket."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), bucket(F.col(name)).alias("edge")) for name, _ in MEASURES))).alias("m")
    return measured.select("lang", "source", each).groupBy("lang", "source", "m.measure", "m.edge").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of a coarser grouping: counts add up."""
    return sketch.groupBy(*by, "measure", "edge").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """For each group: measure, texts, q1 and q3, each the edge at which so many of the texts are reached."""
    group = Window.partitionBy(*by, "measure")
    running = sketch.withColumn("texts", F.sum("n").over(group)).withColumn("reached", F.sum("n").over(group.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda k: F.min(F.when(4 * F.col("reached") >= k * F.col("texts"), F.col("edge")))
    return running.groupBy(*by, "measure").agg(F.max("texts").alias("texts"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and, for each measure, low and high."""
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(merged(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("lm"), F.col("texts").alias("lt"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    overall = quartiles(merged(sketch, []), []).select(F.col("measure").alias("am"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm"))).join(overall, F.col("measure") == F.col("am"))
    pick = lambda own_q, lang_q, all_q: F.when(F.col("texts") >= LEAST_TEXTS, F.col(own_q)).when(F.col("lt") >= LEAST_TEXTS, F.col(lang_q)).otherwise(F.col(all_q))
    slack = F.create_map(*(F.lit(x) for pair in MEASURES for x in pair))[F.col("measure")]
    q1, q3 = pick("q1", "l1", "a1"), pick("q3", "l3", "a3")
    reach = FENCE * F.greatest(q3 - q1, slack)
    fenced = joined.select("lang", "source", "measure", (q1 - reach).alias("low"), (q3 + reach).alias("high"))
    one = lambda name, side: F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}")
    return fenced.groupBy("lang", "source").agg(*(one(name, side) for name, _ in MEASURES for side in ("low", "high")))


def judged(df: DataFrame) -> DataFrame:
    """measure(df) with kept: within the fences of its language and source, and not failed. The fences come from all texts that did not fail."""
    measured = stash(measure(df))
    limits = fences(sketches(measured.where("not base_failed"))).withColumnRenamed("lang", "fence_lang").withColumnRenamed("source", "fence_source")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")
    inside = F.lit(True)
    for name, _ in MEASURES:
        inside &= F.col(name) <= F.col(f"{name}_high")
    inside &= F.col("word_length") >= F.col("word_length_low")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op4_adaptive_quality(spark, sf_dir):
    """Base counts of each document and whether it is kept."""
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    measures = ", ".join(f"('{name}', {name}, {slack})" for name, slack in MEASURES)
    inside = ", ".join(f"max(q3 + reach) FILTER (measure = '{name}') AS {name}_high" for name, _ in MEASURES)
    within = " AND ".join(f"{name} <= {name}_high" for name, _ in MEASURES)
    quartile = lambda by: f"""SELECT {by}measure, max(slack) AS slack, max(texts) AS texts, min(edge) FILTER (4 * reached >= texts) AS q1, min(edge) FILTER (4 * reached >= 3 * texts) AS q3
        FROM (SELECT {by}measure, edge, slack, sum(n) OVER (PARTITION BY {by}measure) AS texts, sum(n) OVER (PARTITION BY {by}measure ORDER BY edge) AS reached
              FROM (SELECT {by}measure, edge, max(slack) AS slack, sum(n) AS n FROM sketch GROUP BY {by}measure, edge)) GROUP BY {by}measure"""  # noqa: E731
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + 2]) AS times FROM cut, unnest(range(1, len(words) - 1)) t(i)),
covered AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE times > 1) GROUP BY rid),
base AS (SELECT cut.rid, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
        coalesce(covered.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_capitals,
        length(text) - length(translate(text, '!', '')) AS n_exclamations FROM cut LEFT JOIN covered ON cut.rid = covered.rid),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
        1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
        1000 * n_capitals // greatest(word_chars, 1) AS capitals, 1000 * n_exclamations // greatest(n_words, 1) AS exclamations,
        100 * word_chars // greatest(n_words, 1) AS word_length FROM base),
each AS (SELECT lang, source, m.measure, m.x, m.slack FROM measured, LATERAL (VALUES {measures}) m(measure, x, slack) WHERE NOT base_failed),
sketch AS (SELECT lang, source, measure, slack, CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END AS edge, count(*) AS n
        FROM each GROUP BY ALL),
own AS ({quartile("lang, source, ")}),
by_lang AS ({quartile("lang, ")}),
overall AS ({quartile("")}),
picked AS (SELECT own.lang, own.source, own.measure, own.slack,
        CASE WHEN own.texts >= {LEAST_TEXTS} THEN own.q1 WHEN by_lang.texts >= {LEAST_TEXTS} THEN by_lang.q1 ELSE overall.q1 END AS q1,
        CASE WHEN own.texts >= {LEAST_TEXTS} THEN own.q3 WHEN by_lang.texts >= {LEAST_TEXTS} THEN by_lang.q3 ELSE overall.q3 END AS q3
        FROM own JOIN by_lang ON own.measure = by_lang.measure AND own.lang IS NOT DISTINCT FROM by_lang.lang JOIN overall ON own.measure = overall.measure),
fences AS (SELECT lang, source, {inside}, max(q1 - reach) FILTER (measure = 'word_length') AS word_length_low
        FROM (SELECT *, {FENCE} * greatest(q3 - q1, slack) AS reach FROM picked) GROUP BY lang, source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce({within} AND word_length >= word_length_low, false) AS kept
FROM measured LEFT JOIN fences ON measured.lang IS NOT DISTINCT FROM fences.lang AND measured.source IS NOT DISTINCT FROM fences.source"""


ORACLE_SQL = _sql()
