"""Labels that are used together: frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from techtrail.sources.shared import written


def baskets(df: DataFrame, key: list[str], item: str) -> DataFrame:
    """key, items: the sorted set of each key's items."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_set(item)).alias("items"))


def slice_baskets(hist: DataFrame, chosen: DataFrame, project: str) -> DataFrame:
    """Baskets at the chosen slice for all projects with a label somewhere in their history; others than the slice's have empty baskets."""
    ever = hist.select(project).distinct()
    return ever.join(baskets(chosen, [project], "label"), project, "left").select(project, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def itemsets(transactions: DataFrame, support: float) -> DataFrame:
    """items (sorted), freq."""
    found = FPGrowth(itemsCol="items", minSupport=support).fit(transactions.select("items")).freqItemsets
    return found.select(F.sort_array("items").alias("items"), "freq")


def pair_itemsets(transactions: DataFrame, support: float) -> DataFrame:
    """items (sorted), freq of itemsets of one and two items alone, counted; each basket gives the pairs of its frequent items.

    Frequent items, of which there are at most a basket's mean size by the support, are one row.
    """
    baskets_of = transactions.select(F.array_distinct("items").alias("items"))
    least = baskets_of.agg(F.ceil(F.count("*") * F.lit(support) - 1e-9).alias("least"))
    single = baskets_of.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("freq")).crossJoin(F.broadcast(least)).where("freq >= least").select("item", "freq", "least")  # one row
    single = written(single, "items")
    known = single.agg(F.collect_list("item").alias("known"), F.max("least").alias("least"))
    kept = baskets_of.crossJoin(F.broadcast(known)).select(F.sort_array(F.array_intersect("items", "known")).alias("items"))
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.array(x, y))))
    double = kept.where(F.size("items") > 1).select(F.explode(pairs).alias("items")).groupBy("items").agg(F.count("*").alias("freq"))
    double = double.crossJoin(F.broadcast(known.select("least"))).where("freq >= least").select("items", "freq")
    return single.select(F.array("item").alias("items"), "freq").unionByName(double)


def _confident(candidates: DataFrame, sets: DataFrame, confidence: float) -> DataFrame:
    """items, freq, antecedent, consequent, fa of the candidates (items, freq, consequent) that hold with the confidence."""
    parted = candidates.withColumn("antecedent", F.array_except("items", "consequent"))
    known = parted.join(sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("fa")), "antecedent")
    return known.where(F.col("freq") >= F.lit(confidence) * F.col("fa")).select("items", "freq", "antecedent", "consequent", "fa")


def rules_of(sets: DataFrame, n: DataFrame, metric: str = "lift", least: float = 1.0, consequents: int | None = None) -> DataFrame:
    """antecedent, consequent (both sorted), freq, supports, confidence and lift of rules over itemsets (items, freq: each with all its subsets that rules may ask for), n: one row, the number of baskets.

    Consequents grow level by level: two of an itemset that differ in their last item alone give one of the next level, if both have held. Where the metric is confidence, those that fail it are not grown, as no larger
    consequent of the set can reach it; by another metric all hold. consequents: the largest size of one. sets must be a table; levels are written when this is called.
    """
    confidence = least if metric == "confidence" else 0.0
    wide = sets.where(F.size("items") > 1)
    held = written(_confident(wide.select("items", "freq", F.explode(F.transform("items", lambda x: F.array(x))).alias("consequent")), sets, confidence), "rules")
    largest, size, every = wide.agg(F.max(F.size("items"))).first()[0] or 0, 1, held
    while size < min(largest - 1, consequents or largest):
        ends = held.where(F.size("items") > size + 1).select("items", "freq", F.slice("consequent", 1, size - 1).alias("begin"), F.element_at("consequent", -1).alias("last"))
        other = ends.select("items", "begin", F.col("last").alias("next"))
        grown = ends.join(other, ["items", "begin"]).where(F.col("last") < F.col("next")).select("items", "freq", F.concat("begin", F.array("last", "next")).alias("consequent"))
        held, size = written(_confident(grown, sets, confidence), "rules"), size + 1
        every = every.unionByName(held)
    made = every.join(sets.select(F.col("items").alias("consequent"), F.col("freq").alias("fc")), "consequent").crossJoin(F.broadcast(n))  # n is one row
    measured = made.select(
        "antecedent",
        "consequent",
        "freq",
        (F.col("fa") / F.col("n")).alias("antecedent_support"),
        (F.col("fc") / F.col("n")).alias("consequent_support"),
        (F.col("freq") / F.col("n")).alias("support"),
        (F.col("freq") / F.col("fa")).alias("confidence"),
        (F.col("freq") * F.col("n") / (F.col("fa") * F.col("fc"))).alias("lift"),
    )
    return measured.where(F.col(metric) >= least)


def rules(transactions: DataFrame, support: float, metric: str = "lift", least: float = 1.0, longest: int | None = None) -> DataFrame:
    """Rules (as in rules_of) over the frequent itemsets of transactions; longest=2: over those of one and two items, which are counted without mining any others. Itemsets are found and written when this is called."""
    n = transactions.agg(F.count("*").alias("n"))
    sets = pair_itemsets(transactions, support) if longest == 2 else itemsets(transactions, support)
    if longest not in (None, 2):
        sets = sets.where(F.size("items") <= longest)
    return rules_of(written(sets, "itemsets"), n, metric, least)


def pair_rules(found: DataFrame) -> DataFrame:
    """Rules of one item on either side: a, c and their measures."""
    return found.where((F.size("antecedent") == 1) & (F.size("consequent") == 1)).select(F.col("antecedent")[0].alias("a"), F.col("consequent")[0].alias("c"), *[x for x in found.columns if x not in ("antecedent", "consequent")])


def about(found: DataFrame, label: str, side: str | None = None, confidence: float = 0.0) -> DataFrame:
    """Pair rules with a label on a side (or either), over a confidence."""
    sides = {"a": F.col("a") == label, "c": F.col("c") == label, None: (F.col("a") == label) | (F.col("c") == label)}
    return found.where(sides[side] & (F.col("confidence") > confidence))


def absolute(found: DataFrame, n: DataFrame) -> DataFrame:
    """Supports as numbers of projects (n: one row, baskets)."""
    with_n = found.crossJoin(F.broadcast(n))  # one row
    return with_n.withColumns({f"{c}_n": F.floor(F.round(F.col(c) * F.col("baskets"), 6)).cast("long") for c in ("antecedent_support", "consequent_support", "support")}).drop("baskets")


def dedupe_mirrored(found: DataFrame) -> DataFrame:
    """Of a -> c and c -> a the one of higher confidence, then the first by name."""
    pair = F.sort_array(F.array("a", "c"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(pair).orderBy(F.desc("confidence"), "a"))).where("nth = 1").drop("nth")


def profile(found: DataFrame, by: list[str], floor: float = 0.0) -> DataFrame:
    """Mean support, confidence and lift of rules by a side or pair, over a floor of support."""
    return found.where(F.col("support") >= floor).groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 9).alias(c) for c in ("support", "confidence", "lift")))


def matrix(found: DataFrame) -> DataFrame:
    """a, c, support of the lower triangle, labels ranked by their total: each pair once, the more frequent label second."""
    both = found.select("a", "c", "support").unionByName(found.select(F.col("c").alias("a"), F.col("a").alias("c"), "support")).distinct()
    totals = both.groupBy("a").agg(F.round(F.sum("support"), 9).alias("total"))
    ranks = totals.select("a", F.row_number().over(Window.orderBy(F.desc("total"), "a")).alias("rank"))  # a row for each label in rules
    placed = both.join(ranks.withColumnRenamed("rank", "rank_a"), "a").join(ranks.select(F.col("a").alias("c"), F.col("rank").alias("rank_c")), "c")
    return placed.where("rank_a > rank_c").select("a", "c", "support", "rank_a", "rank_c")


def labels_in(found: DataFrame) -> DataFrame:
    """One row: different labels as antecedents, as consequents, on both sides, and at all."""
    long = found.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("label")), F.struct(F.lit("c").alias("side"), F.col("c").alias("label")))).alias("x")).select("x.*")
    per = long.groupBy("label").agg(F.bool_or(F.col("side") == "a").alias("in_a"), F.bool_or(F.col("side") == "c").alias("in_c"))
    return per.agg(F.count_if("in_a").alias("antecedents"), F.count_if("in_c").alias("consequents"), F.count_if(F.col("in_a") & F.col("in_c")).alias("in_both"), F.count("*").alias("labels"))
