"""Counts, statistics and rankings."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from techtrail.operators.ordering import quantiles


def usage(df: DataFrame, project: str) -> DataFrame:
    """label, projects."""
    return df.groupBy("label").agg(F.countDistinct(project).alias("projects"))


def coverage(used: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: labels with no, exactly one, some project."""
    n = F.coalesce("projects", F.lit(0))
    joined = universe.join(used, "label", "left")
    return joined.agg(F.count_if(n == 0).alias("unused"), F.count_if(n == 1).alias("by_one"), F.count_if(n > 0).alias("used"))


def uses_model(df: DataFrame, model: str, project: str) -> DataFrame:
    """project, uses: whether it has a label of the model."""
    return df.groupBy(project).agg(F.bool_or(F.col("model") == model).alias("uses"))


def venn(flags: DataFrame, a: str, b: str) -> DataFrame:
    """One row: only a, only b, both, single, total, and shares of the total."""
    x, y = F.col(a), F.col(b)
    counted = flags.where(x | y).agg(F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), F.count_if(x & y).alias("in_both"), F.count("*").alias("total"))
    counted = counted.withColumn("single", F.col("total") - F.col("in_both"))
    share = lambda c: (F.col(c) / F.nullif(F.col("total"), F.lit(0))).alias(f"{c}_share")
    return counted.select("*", *map(share, ("only_a", "only_b", "in_both", "single")))


def group_sum(df: DataFrame, key: str, columns: list[str], digits: int = 2) -> DataFrame:
    return df.groupBy(key).agg(*(F.round(F.sum(c), digits).alias(c) for c in columns))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def measures_of(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """keep, measure, value: a row for each of the columns."""
    each = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*(keep or []), F.explode(each).alias("m")).select(*(keep or []), "m.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each measure its number, least, most, mean, sample deviation, sum and exact quartiles (linear interpolation)."""
    long, v = measures_of(df, columns), F.col("value")
    plain = [F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.sum(v), 2).alias("total")]
    return long.groupBy("measure").agg(*plain).join(quantiles(long, ["measure"], "value", QUARTILES), "measure", "left")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def corr_matrix(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """a, b, r for each pair of measures, all in one aggregation."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*(F.round(F.corr(a, b), digits).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (1..bins), n: equal widths from the least to the greatest value, which is in the last."""
    bounds = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.floor((F.col(column) - F.col("low")) / width) + 1, F.lit(bins)))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # bounds is one row


def iqr_bounds(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """measure (and group), q1, q3, iqr, low and high: quartiles and 1.5 times their distance beyond them."""
    q = quantiles(measures_of(df, columns, group), [*(group or []), "measure"], "value", {"q1": 0.25, "q3": 0.75})
    return q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("low", F.col("q1") - 1.5 * F.col("iqr")).withColumn("high", F.col("q3") + 1.5 * F.col("iqr"))


def iqr_filter(df: DataFrame, column: str) -> DataFrame:
    """Rows within the bounds of their column."""
    bounds = iqr_bounds(df, [column]).select("low", "high")
    return df.crossJoin(F.broadcast(bounds)).where(F.col(column).between(F.col("low"), F.col("high"))).drop("low", "high")  # bounds is one row


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """measure, n: values out of bounds."""
    bounds = iqr_bounds(df, columns)
    joined = measures_of(df, columns).join(F.broadcast(bounds), "measure")  # a row for each measure named
    return joined.groupBy("measure").agg(F.count_if(~F.col("value").between(F.col("low"), F.col("high"))).alias("n"))


def box(df: DataFrame, group: str, column: str) -> DataFrame:
    """group, whiskers and quartiles; whiskers end at the last values within the bounds."""
    bounds = iqr_bounds(df, [column], [group])
    inside = F.when(F.col(column).between(F.col("low"), F.col("high")), F.col(column))
    return df.join(bounds.drop("measure"), group).groupBy(group).agg(F.min(inside).alias("whisker_low"), F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("q3"), 6).alias("q3"), F.max(inside).alias("whisker_high"), F.count_if(inside.isNull() & F.col(column).isNotNull()).alias("outliers"))


def set_union(arrays: Column) -> Column:
    """Union of arrays of a group, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(arrays))))


def joined(values: Column, separator: str = ",") -> Column:
    """Texts of a group, sorted and joined."""
    return F.array_join(F.sort_array(F.collect_list(values)), separator)


def combo_values(df: DataFrame, project: str, item: str, value: str) -> DataFrame:
    """combo, projects, total: projects by the combination of items they have, with the sum of a value over them."""
    per = df.groupBy(project).agg(F.array_join(F.sort_array(F.collect_set(item)), "/").alias("combo"), F.sum(value).alias("value"))
    return per.groupBy("combo").agg(F.count("*").alias("projects"), F.sum("value").alias("total"))


def agg_of_aggs(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One row: mean and median over the groups of the sum of each group's means, and of its medians."""
    means = df.groupBy(group).agg(reduce(lambda a, b: a + b, [F.avg(c) for c in columns]).alias("a"))
    medians = quantiles(measures_of(df, columns, [group]), [group, "measure"], "value", {"median": 0.5})
    of = lambda c: F.max(F.when(F.col("measure") == c, F.col("median")))
    sums = medians.groupBy(group).agg(reduce(lambda a, b: a + b, map(of, columns)).alias("m"))
    middle = quantiles(means, [], "a", {"median": 0.5}).select(F.round("median", 6).alias("median_of_means"))
    rows = means.agg(F.round(F.avg("a"), 6).alias("mean_of_means")).crossJoin(middle).crossJoin(sums.agg(F.round(F.avg("m"), 6).alias("mean_of_medians")))  # one row each
    return rows


def pair_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows with a alone, b alone, both; rows with neither count nowhere."""
    x, y = F.col(a) == 1, F.col(b) == 1
    return df.agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x & y).alias("in_both"))


def row_sum_class(df: DataFrame, columns: list[str]) -> DataFrame:
    """flags, n: rows by the number of their flags."""
    return df.groupBy(reduce(lambda a, b: a + b, [F.col(c) for c in columns]).alias("flags")).agg(F.count("*").alias("n"))


def domain_model(classes: DataFrame, domain: str) -> DataFrame:
    """domain, Relational, Non Relational, Both, Total for rows (domain, class)."""
    counts = [F.count_if(F.col("class") == k).alias(k) for k in ("Relational", "Non Relational", "Both")]
    return classes.where("class <> 'None'").groupBy(domain).agg(*counts, F.count("*").alias("Total"))


def shares(matrix: DataFrame) -> DataFrame:
    """Shares of Both in the total, and of each model in the single ones."""
    single = F.nullif(F.col("Relational") + F.col("Non Relational"), F.lit(0))
    both = F.col("Both") / F.nullif(F.col("Total"), F.lit(0))
    return matrix.select(matrix.columns[0], both.alias("both_share"), (F.col("Relational") / single).alias("relational_share"), (F.col("Non Relational") / single).alias("other_share"))


def predominant(matrix: DataFrame) -> DataFrame:
    """One row: domains where Both exceeds the others, their number and share."""
    wins = (F.col("Both") > F.col("Relational")) & (F.col("Both") > F.col("Non Relational"))
    return matrix.agg(F.count_if(wins).alias("n"), (F.count_if(wins) / F.count("*")).alias("share"))


def model_counts(df: DataFrame, project: str) -> DataFrame:
    """kind, model, projects: by model, and projects by how many models they have."""
    by = df.groupBy("model").agg(F.countDistinct(project).alias("projects")).select(F.lit("model").alias("kind"), "model", "projects")
    several = df.groupBy(project).agg(F.countDistinct("model").alias("k")).groupBy(F.col("k").cast("string").alias("model")).agg(F.count("*").alias("projects"))
    return by.unionByName(several.select(F.lit("number").alias("kind"), "model", "projects"))


def score_bins(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bin, n: values from each edge up to the next."""
    place = reduce(lambda acc, e: F.when(F.col(column) >= e[1], e[0] + 1).otherwise(acc), enumerate(edges), F.lit(0))
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(value), tie).limit(k)


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the k most frequent values of the key."""
    top = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k).select(key)
    return df.join(F.broadcast(top), key, "left_semi")  # k rows


def arg_max(df: DataFrame, label: str, value: str) -> DataFrame:
    """One row: the label of the greatest value, of equal ones the first by name."""
    return df.agg(F.min(F.struct((-F.col(value)).alias("less"), F.col(label), F.col(value))).alias("best")).select(f"best.{label}", f"best.{value}")


def top_per_group(counts: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The row of the largest value in each group: one pass of aggregation, no sort."""
    rest = [c for c in counts.columns if c not in (group, value, tie)]
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col(value)).alias("neg"), F.col(tie), F.col(value), *rest)).alias("best"))
    return best.select(group, f"best.{tie}", f"best.{value}", *(f"best.{c}" for c in rest))


def appearance_rank(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """value, rank: values by first appearance in the sorted table, first all of one column, then of the next.

    The table is of rules, which are few; numbering it is one task's work.
    """
    numbered = df.withColumn("row", F.row_number().over(Window.orderBy(*order)))
    long = numbered.select("row", F.explode(F.array(*(F.struct(F.lit(i).alias("phase"), F.col(c).alias("value")) for i, c in enumerate(columns)))).alias("v"))
    first = long.groupBy("v.value").agg(F.min(F.struct("v.phase", "row")).alias("first"))
    return first.select("value", F.row_number().over(Window.orderBy("first")).alias("rank"))


def first_row(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in an explicit order, nulls first: an aggregation, so no group is sorted or in one task whole."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("first row"))
    return first.select(*(F.col(c) if c in key else F.col("first row")[c].alias(c) for c in df.columns))
