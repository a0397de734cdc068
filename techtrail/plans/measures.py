"""Queries that count, summarise and rank."""

from __future__ import annotations

from pyspark.sql import functions as F
from techtrail.operators import aggregates as a
from techtrail.operators import joins, models
from techtrail.operators.ordering import carry_last
from techtrail.plans import bindings as b
from techtrail.plans.book import Book
from techtrail.plans.histories import MODELS_SQL, catalogue
from techtrail.plans.tables import META_SQL, WIDE_SQL, meta, wide

book = Book()
HIST = f"WITH {b.HISTORY_SQL}"
LAST_SQL = "today AS (SELECT h.* FROM hist h JOIN sizes s ON h.user_id = s.user_id AND h.part = s.n_parts)"


def typed(spark, sf_dir):
    return models.attach_model(b.history(spark, sf_dir), catalogue(spark))


TYPED = f"WITH {b.HISTORY_SQL}, {MODELS_SQL}, typed AS (SELECT h.*, model FROM hist h JOIN typed_labels USING (label))"
CLASS_SQL = f"""{TYPED}, flags AS (SELECT user_id, bool_or(model = 'Relational') AS rel, bool_or(model <> 'Relational') AS non FROM typed WHERE part = 1 GROUP BY user_id),
classes AS (SELECT user_id, c_mktsegment AS domain, CASE WHEN rel AND non THEN 'Both' WHEN rel THEN 'Relational' WHEN non THEN 'Non Relational' ELSE 'None' END AS class FROM flags JOIN customer ON user_id = c_custkey),
matrix AS (SELECT domain, count(*) FILTER (class = 'Relational') AS "Relational", count(*) FILTER (class = 'Non Relational') AS "Non Relational", count(*) FILTER (class = 'Both') AS "Both", count(*) AS "Total" FROM classes WHERE class <> 'None' GROUP BY domain)"""


def flags(spark, sf_dir):
    first = typed(spark, sf_dir).where("part = 1")
    return first.groupBy("user_id").agg(F.bool_or(F.col("model") == "Relational").alias("rel"), F.bool_or(F.col("model") != "Relational").alias("non"))


def matrix(spark, sf_dir):
    classes = flags(spark, sf_dir).select("user_id", models.model_class(F.col("rel"), F.col("non")).alias("class")).join(b.segments(spark, sf_dir), "user_id")
    return a.domain_model(classes, "domain")


@book.query("usage_count", f"{HIST} SELECT label, count(DISTINCT user_id) AS projects FROM hist GROUP BY label")
def usage_count(spark, sf_dir):
    return a.usage(b.history(spark, sf_dir), "user_id")


@book.query("count_nonzero", f"{HIST}, u AS (SELECT l.label, count(DISTINCT user_id) AS n FROM (VALUES ('click'), ('view'), ('unknown'), ('error')) l(label) LEFT JOIN hist h ON l.label = h.label AND part = 1 GROUP BY l.label) SELECT count(*) FILTER (n = 0) AS unused, count(*) FILTER (n = 1) AS by_one, count(*) FILTER (n > 0) AS used FROM u")
def count_nonzero(spark, sf_dir):
    universe = spark.createDataFrame([("click",), ("view",), ("unknown",), ("error",)], "label string")
    return a.coverage(a.usage(b.history(spark, sf_dir).where("part = 1"), "user_id"), universe)


@book.query("count_zero", f"{HIST} SELECT count(*) FILTER (n > 0) AS with_label, count(*) FILTER (n = 0) AS without FROM (SELECT c_custkey, count(DISTINCT h.label) AS n FROM customer LEFT JOIN hist h ON c_custkey = user_id GROUP BY c_custkey)")
def count_zero(spark, sf_dir):
    projects = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    used = b.history(spark, sf_dir).select("user_id").distinct().withColumn("used", F.lit(True))
    return projects.join(used, "user_id", "left").agg(F.count_if("used").alias("with_label"), F.count_if(F.col("used").isNull()).alias("without"))


@book.query("any_in_group", f"{TYPED} SELECT user_id, bool_or(model = 'Relational') AS uses FROM typed GROUP BY user_id")
def any_in_group(spark, sf_dir):
    return a.uses_model(typed(spark, sf_dir), "Relational", "user_id")


@book.query("venn_counts", f"{CLASS_SQL}, c AS (SELECT count(*) FILTER (rel AND NOT non) AS only_a, count(*) FILTER (non AND NOT rel) AS only_b, count(*) FILTER (rel AND non) AS in_both, count(*) AS total FROM flags WHERE rel OR non) SELECT *, total - in_both AS single, only_a / total AS only_a_share, only_b / total AS only_b_share, in_both / total AS in_both_share, (total - in_both) / total AS single_share FROM c")
def venn_counts(spark, sf_dir):
    return a.venn(flags(spark, sf_dir), "rel", "non")


@book.query("group_sum", f"WITH {META_SQL} SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal, round(sum(n_orders), 2)::BIGINT AS n_orders FROM meta GROUP BY c_mktsegment")
def group_sum(spark, sf_dir):
    return a.group_sum(meta(spark, sf_dir), "c_mktsegment", ["c_acctbal", "n_orders"])


@book.query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority")
def value_counts(spark, sf_dir):
    return a.value_counts(b.table(spark, sf_dir, "orders"), "o_orderpriority")


STATS_SQL = "count(v) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(sum(v), 2) AS total, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3"


@book.query("summary_stats", f"SELECT 'o_totalprice' AS measure, {STATS_SQL} FROM (SELECT o_totalprice AS v FROM orders) UNION ALL SELECT 'o_custkey', {STATS_SQL} FROM (SELECT o_custkey::DOUBLE AS v FROM orders)")
def summary_stats(spark, sf_dir):
    return a.describe(b.table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])


@book.query("describe_all", " UNION ALL ".join(f"SELECT '{x}' AS measure, {STATS_SQL} FROM (SELECT {x}::DOUBLE AS v FROM part)" for x in ("p_partkey", "p_size", "p_retailprice")))
def describe_all(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    return a.describe(part, a.numeric_columns(part))


CORR = ["l_quantity", "l_extendedprice", "l_discount"]


@book.query("correlation", " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) AS r FROM lineitem" for i, x in enumerate(CORR) for y in CORR[i:]))
def correlation(spark, sf_dir):
    return a.corr_matrix(b.table(spark, sf_dir, "lineitem"), CORR)


@book.query("histogram", "WITH s AS (SELECT min(o_totalprice) AS low, (max(o_totalprice) - min(o_totalprice)) / 50 AS width FROM orders) SELECT least(floor((o_totalprice - low) / width) + 1, 50)::INTEGER AS bin, count(*) AS n FROM orders, s GROUP BY ALL")
def histogram(spark, sf_dir):
    return a.histogram(b.table(spark, sf_dir, "orders"), "o_totalprice", 50)


IQR_SQL = "q AS (SELECT '{0}' AS measure, quantile_cont({0}::DOUBLE, 0.25) AS q1, quantile_cont({0}::DOUBLE, 0.75) AS q3 FROM {1})"


@book.query("iqr_bounds", f"WITH {IQR_SQL.format('o_totalprice', 'orders')} SELECT measure, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q")
def iqr_bounds(spark, sf_dir):
    return a.iqr_bounds(b.table(spark, sf_dir, "orders"), ["o_totalprice"])


@book.query("iqr_filter", f"WITH {META_SQL}, q AS (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM meta) SELECT c_custkey, total FROM meta, q WHERE total BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
def iqr_filter(spark, sf_dir):
    return a.iqr_filter(meta(spark, sf_dir), "total").select("c_custkey", "total")


@book.query("iqr_outlier_count", f"WITH {META_SQL} " + " UNION ALL ".join(f"SELECT '{x}' AS measure, count(*) FILTER ({x} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n FROM meta, (SELECT quantile_cont({x}::DOUBLE, 0.25) AS q1, quantile_cont({x}::DOUBLE, 0.75) AS q3 FROM meta)" for x in ("total", "n_orders", "c_acctbal")))
def iqr_outlier_count(spark, sf_dir):
    return a.outliers(meta(spark, sf_dir), ["total", "n_orders", "c_acctbal"])


@book.query(
    "box_summary",
    f"""WITH {META_SQL}, q AS (SELECT c_mktsegment, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM meta GROUP BY c_mktsegment), m AS (SELECT meta.c_mktsegment, total, q1, q3, total BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM meta JOIN q USING (c_mktsegment))
    SELECT c_mktsegment, min(total) FILTER (inside) AS whisker_low, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, max(total) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM m GROUP BY c_mktsegment""",
)
def box_summary(spark, sf_dir):
    return a.box(meta(spark, sf_dir), "c_mktsegment", "total")


@book.query("rank_columns_by_iqr", " UNION ALL ".join(f"SELECT '{x}' AS measure, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr FROM lineitem" for x in CORR))
def rank_columns_by_iqr(spark, sf_dir):
    return a.iqr_bounds(b.table(spark, sf_dir, "lineitem"), CORR).select("measure", "iqr").orderBy("iqr", "measure")


@book.query("collect_set_union", f"{HIST}, s AS (SELECT DISTINCT part, label FROM hist) SELECT part, string_agg(label, ',' ORDER BY label) AS labels FROM s GROUP BY part")
def collect_set_union(spark, sf_dir):
    sets = b.history(spark, sf_dir).groupBy("user_id", "part").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return sets.groupBy(F.col("part").cast("long").alias("part")).agg(F.array_join(a.set_union(F.col("labels")), ",").alias("labels"))


@book.query("collect_list_by", "WITH p AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '/' ORDER BY l_returnflag) AS combo, sum(l_quantity) AS v FROM lineitem GROUP BY l_orderkey) SELECT combo, count(*) AS projects, sum(v) AS total FROM p GROUP BY combo")
def collect_list_by(spark, sf_dir):
    return a.combo_values(b.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity")


@book.query("concat_group", "SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY l_orderkey")
def concat_group(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(a.joined(F.col("l_suppkey").cast("string")).alias("suppliers"))


@book.query("avg_of_columns", "WITH p AS (SELECT o_custkey, avg(o_totalprice) + avg(o_orderkey) AS a, quantile_cont(o_totalprice, 0.5) + quantile_cont(o_orderkey::DOUBLE, 0.5) AS m FROM orders GROUP BY o_custkey) SELECT round(avg(a), 6) AS mean_of_means, round(quantile_cont(a, 0.5), 6) AS median_of_means, round(avg(m), 6) AS mean_of_medians FROM p")
def avg_of_columns(spark, sf_dir):
    return a.agg_of_aggs(b.table(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice", "o_orderkey"])


def flag_table(spark, sf_dir):
    """user_id with 0 or 1 for two event types in the first slice."""
    first = b.history(spark, sf_dir).where("part = 1").groupBy("user_id")
    return first.agg(*(F.max((F.col("label") == x).cast("int")).alias(x) for x in ("click", "view")))


FLAGS_SQL = f"{HIST}, f AS (SELECT user_id, max((label = 'click')::INTEGER) AS click, max((label = 'view')::INTEGER) AS view FROM hist WHERE part = 1 GROUP BY user_id)"


@book.query("overlap_pair", f"{FLAGS_SQL} SELECT count(*) FILTER (click = 1 AND view <> 1) AS only_a, count(*) FILTER (click <> 1 AND view = 1) AS only_b, count(*) FILTER (click = 1 AND view = 1) AS in_both FROM f")
def overlap_pair(spark, sf_dir):
    return a.pair_overlap(flag_table(spark, sf_dir), "click", "view")


@book.query("row_sum_class", f"{FLAGS_SQL} SELECT click + view AS flags, count(*) AS n FROM f GROUP BY ALL")
def row_sum_class(spark, sf_dir):
    return a.row_sum_class(flag_table(spark, sf_dir), ["click", "view"])


@book.query("share_table", f'{CLASS_SQL} SELECT domain, "Both" / "Total" AS both_share, "Relational" / nullif("Relational" + "Non Relational", 0) AS relational_share, "Non Relational" / nullif("Relational" + "Non Relational", 0) AS other_share FROM matrix')
def share_table(spark, sf_dir):
    return a.shares(matrix(spark, sf_dir))


@book.query("domain_model_matrix", f"{CLASS_SQL} SELECT * FROM matrix")
def domain_model_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@book.query("predominant_domains", f'{CLASS_SQL} SELECT count(*) FILTER ("Both" > "Relational" AND "Both" > "Non Relational") AS n, count(*) FILTER ("Both" > "Relational" AND "Both" > "Non Relational") / count(*) AS share FROM matrix')
def predominant_domains(spark, sf_dir):
    return a.predominant(matrix(spark, sf_dir))


@book.query("model_membership", f"{TYPED}, k AS (SELECT user_id, count(DISTINCT model) AS k FROM typed GROUP BY user_id) SELECT 'model' AS kind, model, count(DISTINCT user_id) AS projects FROM typed GROUP BY model UNION ALL SELECT 'number', k::VARCHAR, count(*) FROM k GROUP BY k")
def model_membership(spark, sf_dir):
    return a.model_counts(typed(spark, sf_dir), "user_id")


@book.query(
    "trend_by_year",
    """WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders GROUP BY o_custkey), g AS (SELECT o_custkey, make_date(unnest(range(y, 1999)), 7, 1) AS due FROM f WHERE y <= 1998),
    r AS (SELECT g.o_custkey, g.due, o.o_orderpriority, row_number() OVER (PARTITION BY g.o_custkey, g.due ORDER BY o.o_orderdate DESC, o.o_orderpriority DESC) AS rn FROM g JOIN orders o ON o.o_custkey = g.o_custkey AND o.o_orderdate <= g.due)
    SELECT due, o_orderpriority AS label, count(DISTINCT o_custkey) AS projects FROM r WHERE rn = 1 AND year(due) >= 1994 GROUP BY ALL""",
)
def trend_by_year(spark, sf_dir):
    grid = joins.asof_grid(b.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderpriority", 7, 1, 1998)
    return grid.where(F.year("due") >= 1994).groupBy("due", F.col("o_orderpriority").alias("label")).agg(F.countDistinct("o_custkey").alias("projects"))


@book.query("vulnerability_by", "SELECT source AS label, (2000 + doc_id % 20)::BIGINT AS year, count(*) AS n FROM documents WHERE contains(lower(text), 'licensed') GROUP BY ALL")
def vulnerability_by(spark, sf_dir):
    found = b.table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("licensed")))
    return found.groupBy(F.col("source").alias("label"), (2000 + F.col("doc_id") % 20).alias("year")).agg(F.count("*").alias("n"))


@book.query("score_bins", "SELECT CASE WHEN c_acctbal >= 9000 THEN 4 WHEN c_acctbal >= 7000 THEN 3 WHEN c_acctbal >= 4000 THEN 2 WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM customer GROUP BY ALL")
def score_bins(spark, sf_dir):
    return a.score_bins(b.table(spark, sf_dir, "customer"), "c_acctbal", [0, 4000, 7000, 9000])


@book.query("status_counters", "SELECT action, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'keep' WHEN o_orderstatus = 'O' THEN 'add' ELSE 'skip' END AS action FROM orders) GROUP BY action")
def status_counters(spark, sf_dir):
    action = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "add").otherwise("skip")
    return b.table(spark, sf_dir, "orders").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@book.query("code_vs_test_totals", f"WITH {WIDE_SQL} SELECT 'click' AS label, sum(click)::BIGINT AS value FROM wide UNION ALL SELECT 'view', sum(view)::BIGINT FROM wide")
def code_vs_test_totals(spark, sf_dir):
    return wide(spark, sf_dir).agg(F.sum("click").alias("click"), F.sum("view").alias("view")).unpivot([], ["click", "view"], "label", "value")


@book.query("usage_by_model_columns", f'{TYPED} SELECT label, count(DISTINCT user_id) FILTER (model = \'Relational\') AS "Relational", count(DISTINCT user_id) FILTER (model <> \'Relational\') AS "Non Relational", count(DISTINCT user_id) AS total FROM typed GROUP BY label')
def usage_by_model_columns(spark, sf_dir):
    rows = typed(spark, sf_dir)
    count = lambda rule, name: F.count_distinct(F.when(rule, F.col("user_id"))).alias(name)
    return rows.groupBy("label").agg(count(F.col("model") == "Relational", "Relational"), count(F.col("model") != "Relational", "Non Relational"), F.countDistinct("user_id").alias("total"))


@book.query("label_by_domain", f"{HIST} SELECT c_mktsegment AS domain, count(DISTINCT user_id) AS projects FROM hist JOIN customer ON user_id = c_custkey WHERE label = 'click' GROUP BY c_mktsegment")
def label_by_domain(spark, sf_dir):
    rows = b.history(spark, sf_dir).where("label = 'click'").join(b.segments(spark, sf_dir), "user_id")
    return rows.groupBy("domain").agg(F.countDistinct("user_id").alias("projects")).orderBy(F.desc("projects"), "domain")


BRANDS_SQL = "brands AS (SELECT p_brand AS label, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)"


def brands(spark, sf_dir):
    joined = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("label")).agg(F.countDistinct("l_orderkey").alias("n"))


@book.query("top_k", f"WITH {BRANDS_SQL} SELECT * FROM brands ORDER BY n DESC, label LIMIT 5")
def top_k(spark, sf_dir):
    return a.top_k(brands(spark, sf_dir), "n", 5, "label")


@book.query("arg_max", f"WITH {BRANDS_SQL} SELECT label, n FROM brands ORDER BY n DESC, label LIMIT 1")
def arg_max(spark, sf_dir):
    return a.arg_max(brands(spark, sf_dir), "label", "n")


@book.query("top_groups_filter", "WITH t AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5) SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM t)")
def top_groups_filter(spark, sf_dir):
    return a.top_groups(b.table(spark, sf_dir, "part"), "p_brand", 5).select("p_partkey", "p_brand")


@book.query("top_label_per_group", f"{HIST}, u AS (SELECT c_mktsegment AS domain, label, count(DISTINCT user_id) AS n FROM hist JOIN customer ON user_id = c_custkey GROUP BY ALL) SELECT domain, label, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, label) AS rn FROM u) WHERE rn = 1")
def top_label_per_group(spark, sf_dir):
    rows = b.history(spark, sf_dir).join(b.segments(spark, sf_dir), "user_id")
    return a.top_per_group(rows.groupBy("domain", "label").agg(F.countDistinct("user_id").alias("n")), "domain", "n", "label")


@book.query("sort_ci", "SELECT c_name, lower(c_mktsegment) AS domain FROM customer ORDER BY lower(c_mktsegment), lower(c_name)")
def sort_ci(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").select("c_name", F.lower("c_mktsegment").alias("domain")).orderBy("domain", F.lower("c_name"))


@book.query("sort_multi", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand, p_type DESC")
def sort_multi(spark, sf_dir):
    return b.table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", F.desc("p_type"))


@book.query("sort_by_usage", f"{HIST}, u AS (SELECT label, count(DISTINCT user_id) AS n FROM hist GROUP BY label) SELECT l.label, u.n FROM (VALUES ('unknown'), ('click'), ('view'), ('error')) l(label) LEFT JOIN u USING (label) ORDER BY u.n DESC NULLS LAST, l.label")
def sort_by_usage(spark, sf_dir):
    universe = spark.createDataFrame([("unknown",), ("click",), ("view",), ("error",)], "label string")
    used = a.usage(b.history(spark, sf_dir), "user_id").withColumnRenamed("projects", "n")
    return universe.join(used, "label", "left").orderBy(F.desc_nulls_last("n"), "label")


@book.query("first_of_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_of_group(spark, sf_dir):
    return a.first_row(b.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@book.query("last_nonnull_carry", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_value FROM events")
def last_nonnull_carry(spark, sf_dir):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return carry_last(b.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], bought, "last_value").select("event_id", "last_value")


QUERIES, ORACLE = book.queries, book.sql
