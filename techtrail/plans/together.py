"""Queries over rules, scalar functions, vulnerabilities and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F
from techtrail.functions import scalars as s
from techtrail.operators import aggregates, reviews, rules, sequences, slices
from techtrail.plans import bindings as b
from techtrail.plans.book import Book
from techtrail.sources.shared import written

book = Book()
SUPPORT = 0.021

BASKETS_SQL = "baskets AS (SELECT DISTINCT l_orderkey AS k, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT k) AS n FROM baskets)"
RULES_SQL = f"""{BASKETS_SQL}, one AS (SELECT item, count(*) AS f FROM baskets GROUP BY item), two AS (SELECT p.item AS a, q.item AS c, count(*) AS freq FROM baskets p JOIN baskets q ON p.k = q.k AND p.item <> q.item GROUP BY ALL),
pairs AS (SELECT a, c, freq, x.f / n AS antecedent_support, y.f / n AS consequent_support, freq / n AS support, freq / x.f AS confidence, freq * n / (x.f * y.f) AS lift FROM two JOIN one x ON a = x.item JOIN one y ON c = y.item, n WHERE freq >= ceil({SUPPORT} * n))"""
PAIR = ["a", "c", "freq", "antecedent_support", "consequent_support", "support", "confidence", "lift"]


def orders_baskets(spark, sf_dir):
    joined = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rules.baskets(joined, ["l_orderkey"], "p_type")


def pairs(spark, sf_dir, least=0.0):
    return rules.pair_rules(rules.rules(orders_baskets(spark, sf_dir), SUPPORT, "lift", least, longest=2))


#: All itemsets, as bits of the items in their order: each basket is compared with each set.
SETS_SQL = f"""{BASKETS_SQL}, items AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS place FROM (SELECT DISTINCT item FROM baskets)),
masks AS (SELECT mask, count(*) AS times FROM (SELECT k, sum(1 << place)::BIGINT AS mask FROM baskets JOIN items USING (item) GROUP BY k) GROUP BY mask),
bits AS (SELECT unnest(range(1, (1 << (SELECT count(*) FROM items))::BIGINT)) AS bits),
sets AS (SELECT bits, sum(times)::BIGINT AS freq FROM bits JOIN masks ON mask & bits = bits GROUP BY bits HAVING sum(times) >= (SELECT ceil({SUPPORT} * n) FROM n)),
named AS (SELECT bits, any_value(freq) AS freq, string_agg(item, ',' ORDER BY item) AS items FROM sets JOIN items ON (bits >> place) & 1 = 1 GROUP BY bits)"""


@book.query("frequent_itemsets", f"WITH {SETS_SQL} SELECT items, freq FROM named")
def frequent_itemsets(spark, sf_dir):
    return rules.itemsets(orders_baskets(spark, sf_dir), SUPPORT).select(F.array_join("items", ",").alias("items"), "freq")


@book.query(
    "association_rules",
    f"""WITH {SETS_SQL}, made AS (SELECT a.items AS antecedent, c.items AS consequent, w.freq, a.freq AS fa, c.freq AS fc, n.n
        FROM named w JOIN named a ON a.bits & w.bits = a.bits AND a.bits <> w.bits JOIN named c ON c.bits = w.bits - a.bits, n)
    SELECT antecedent, consequent, freq, round(fa / n, 9) AS antecedent_support, round(fc / n, 9) AS consequent_support, round(freq / n, 9) AS support,
        round(freq / fa, 9) AS confidence, round(freq * n / (fa * fc), 9) AS lift FROM made WHERE freq * n / (fa * fc) >= 0.9""",
)
def association_rules(spark, sf_dir):
    found = rules.rules(orders_baskets(spark, sf_dir), SUPPORT, "lift", 0.9)
    return found.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "freq", *(F.round(x, 9).alias(x) for x in PAIR[3:]))


@book.query(
    "confident_rules",
    f"""WITH {SETS_SQL} SELECT a.items AS antecedent, c.items AS consequent, w.freq, round(w.freq / a.freq, 9) AS confidence
        FROM named w JOIN named a ON a.bits & w.bits = a.bits AND a.bits <> w.bits JOIN named c ON c.bits = w.bits - a.bits WHERE w.freq / a.freq >= 0.45""",
)
def confident_rules(spark, sf_dir):
    """Rules by confidence, whose consequents grow only where they hold."""
    found = rules.rules(orders_baskets(spark, sf_dir), SUPPORT, "confidence", 0.45)
    return found.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "freq", F.round("confidence", 9).alias("confidence"))


@book.query("pair_rules", f"WITH {RULES_SQL} SELECT a, c, freq, round(antecedent_support, 9) AS antecedent_support, round(consequent_support, 9) AS consequent_support, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM pairs")
def pair_rules(spark, sf_dir):
    return pairs(spark, sf_dir).select("a", "c", "freq", *(F.round(x, 9).alias(x) for x in PAIR[3:]))


@book.query("rules_single_consequent", f"WITH {RULES_SQL} SELECT a, c, freq FROM pairs WHERE a = 'STANDARD'")
def rules_single_consequent(spark, sf_dir):
    return rules.about(pairs(spark, sf_dir), "STANDARD", "a").select("a", "c", "freq")


@book.query("rules_thresholds", f"WITH {RULES_SQL} SELECT a, c, freq FROM pairs WHERE support >= 0.03 AND confidence >= 0.2 AND lift >= 0.98")
def rules_thresholds(spark, sf_dir):
    found = rules.rules(orders_baskets(spark, sf_dir), 0.03, "lift", 0.98, longest=2).where("confidence >= 0.2")
    return rules.pair_rules(found).select("a", "c", "freq")


@book.query("slice_transactions", f"WITH {b.HISTORY_SQL} SELECT s.user_id, coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '') AS items FROM sizes s LEFT JOIN hist h ON s.user_id = h.user_id AND h.part = greatest(s.n_parts // 2, 1) GROUP BY s.user_id")
def slice_transactions(spark, sf_dir):
    hist = b.history(spark, sf_dir)
    found = rules.slice_baskets(hist, slices.pick_slice(hist, "user_id", "middle"), "user_id")
    return found.select("user_id", F.array_join("items", ",").alias("items"))


@book.query("absolute_support", f"WITH {RULES_SQL} SELECT a, c, f1.f AS antecedent_support_n, f2.f AS consequent_support_n, freq AS support_n FROM pairs JOIN one f1 ON a = f1.item JOIN one f2 ON c = f2.item")
def absolute_support(spark, sf_dir):
    n = orders_baskets(spark, sf_dir).agg(F.count("*").alias("baskets"))
    return rules.absolute(pairs(spark, sf_dir), n).select("a", "c", "antecedent_support_n", "consequent_support_n", "support_n")


@book.query("dedupe_mirrored", f"WITH {RULES_SQL} SELECT a, c, freq FROM (SELECT *, row_number() OVER (PARTITION BY least(a, c), greatest(a, c) ORDER BY confidence DESC, a) AS rn FROM pairs) WHERE rn = 1")
def dedupe_mirrored(spark, sf_dir):
    return rules.dedupe_mirrored(pairs(spark, sf_dir)).select("a", "c", "freq")


@book.query("group_mean_rules", f"WITH {RULES_SQL} SELECT a, count(*) AS n, round(avg(support), 9) AS support, round(avg(confidence), 9) AS confidence, round(avg(lift), 9) AS lift FROM pairs WHERE support >= 0.03 GROUP BY a")
def group_mean_rules(spark, sf_dir):
    return rules.profile(pairs(spark, sf_dir), ["a"], 0.03)


@book.query("filter_rules_about", f"WITH {RULES_SQL} SELECT a, c, freq FROM pairs WHERE c = 'ECONOMY' AND confidence > 0.3")
def filter_rules_about(spark, sf_dir):
    return rules.about(pairs(spark, sf_dir), "ECONOMY", "c", 0.3).select("a", "c", "freq")


@book.query("high_lift", f"WITH {RULES_SQL} SELECT a, c, round(lift, 9) AS lift FROM pairs WHERE lift > 0.99 AND confidence > 0.1 ORDER BY pairs.lift DESC, a")
def high_lift(spark, sf_dir):
    return pairs(spark, sf_dir).where("lift > 0.99 and confidence > 0.1").orderBy(F.desc("lift"), "a").select("a", "c", F.round("lift", 9).alias("lift"))


@book.query(
    "symmetric_matrix",
    f"""WITH {RULES_SQL}, totals AS (SELECT a, round(sum(support), 9) AS total FROM pairs GROUP BY a), ranks AS (SELECT a, row_number() OVER (ORDER BY total DESC, a)::INTEGER AS r FROM totals)
    SELECT p.a, p.c, round(support, 9) AS support, x.r AS rank_a, y.r AS rank_c FROM pairs p JOIN ranks x ON p.a = x.a JOIN ranks y ON p.c = y.a WHERE x.r > y.r""",
)
def symmetric_matrix(spark, sf_dir):
    return rules.matrix(pairs(spark, sf_dir)).withColumn("support", F.round("support", 9))


@book.query("distinct_labels_in_rules", f"WITH {RULES_SQL}, p AS (SELECT * FROM pairs WHERE lift > 1) SELECT (SELECT count(DISTINCT a) FROM p) AS antecedents, (SELECT count(DISTINCT c) FROM p) AS consequents, (SELECT count(*) FROM (SELECT a FROM p INTERSECT SELECT c FROM p)) AS in_both, (SELECT count(*) FROM (SELECT a FROM p UNION SELECT c FROM p)) AS labels")
def distinct_labels_in_rules(spark, sf_dir):
    return rules.labels_in(pairs(spark, sf_dir).where("lift > 1"))


@book.query("projects_lists", f"WITH {b.HISTORY_SQL} SELECT user_id, string_agg(DISTINCT label, ',' ORDER BY label) AS items FROM hist GROUP BY user_id")
def projects_lists(spark, sf_dir):
    return rules.baskets(b.history(spark, sf_dir), ["user_id"], "label").select("user_id", F.array_join("items", ",").alias("items"))


@book.query("first_appearance_rank", f"WITH {RULES_SQL}, r AS (SELECT a, c, row_number() OVER (ORDER BY freq DESC, a, c) AS nth FROM pairs), v AS (SELECT value, min((phase, nth)) AS first FROM (SELECT a AS value, 0 AS phase, nth FROM r UNION ALL SELECT c, 1, nth FROM r) GROUP BY value) SELECT value, row_number() OVER (ORDER BY first)::INTEGER AS rank FROM v")
def first_appearance_rank(spark, sf_dir):
    found = pairs(spark, sf_dir).withColumn("less", -F.col("freq"))
    return aggregates.appearance_rank(found, ["a", "c"], ["less", "a", "c"])


@book.query("fn_string", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare, (length(url) - length(replace(url, 'e', '')))::INTEGER AS e_count, nullif(split_part(url, '/', 3), '') AS host, lower(url) AS low, contains(url, 'page') AS has_page FROM pages")
def fn_string(spark, sf_dir):
    url = F.col("url")
    return b.table(spark, sf_dir, "pages").select("page_id", s.remove_prefix(url, "https://").alias("bare"), s.count_of(url, "e").alias("e_count"), s.split_part(url, "/", 2).alias("host"), F.lower(url).alias("low"), url.contains("page").alias("has_page"))


@book.query("fn_date", "SELECT o_orderkey, (year(o_orderdate) + (month(o_orderdate) >= 7)::INTEGER)::INTEGER AS y, strftime(o_orderdate, '%Y-%m-%d') AS day, make_date(year(o_orderdate), 7, 1) AS july FROM orders")
def fn_date(spark, sf_dir):
    ts = F.col("o_orderdate")
    return b.table(spark, sf_dir, "orders").select("o_orderkey", s.year_from_july(ts).alias("y"), s.iso_day(ts).alias("day"), F.make_date(F.year(ts), F.lit(7), F.lit(1)).alias("july"))


@book.query("fn_math", "SELECT o_orderkey, ceil(o_totalprice / 50)::BIGINT AS up, floor(o_totalprice / 50)::BIGINT AS down, printf('%.1f%%', round(o_custkey * 100.0::DOUBLE / o_orderkey, 1)) AS share FROM orders WHERE o_orderkey <> 0")
def fn_math(spark, sf_dir):
    x = F.col("o_totalprice") / 50
    return b.table(spark, sf_dir, "orders").where("o_orderkey <> 0").select("o_orderkey", F.ceil(x).alias("up"), F.floor(x).alias("down"), s.pct(F.col("o_custkey"), F.col("o_orderkey")).alias("share"))


FIRST_LAST_SQL = f"WITH {b.HISTORY_SQL}, s AS (SELECT h.user_id, list(DISTINCT label) FILTER (part = 1) AS x, list(DISTINCT label) FILTER (part = n_parts) AS y FROM hist h JOIN sizes z USING (user_id) GROUP BY h.user_id)"


@book.query("fn_array_set", FIRST_LAST_SQL + " SELECT user_id, len(list_intersect(x, y))::INTEGER AS shared, len(list_distinct(list_concat(x, y)))::INTEGER AS all_, len(list_filter(x, lambda v: NOT list_contains(y, v)))::INTEGER AS gone, list_contains(x, 'click') AS has_click FROM s WHERE x IS NOT NULL AND y IS NOT NULL")
def fn_array_set(spark, sf_dir):
    hist = b.history(spark, sf_dir)
    of = lambda which: rules.baskets(slices.pick_slice(hist, "user_id", which), ["user_id"], "label")
    both = of("first").withColumnRenamed("items", "x").join(of("last").withColumnRenamed("items", "y"), "user_id")
    first = hist.where("part = 1").select("user_id").distinct()
    return both.join(first, "user_id", "left_semi").select("user_id", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("all_"), F.size(F.array_except("x", "y")).alias("gone"), F.array_contains("x", "click").alias("has_click"))


@book.query("fn_json", "SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k, coalesce(props->>'$.none', 'absent') AS missing FROM events")
def fn_json(spark, sf_dir):
    props = F.col("props")
    return b.table(spark, sf_dir, "events").select("event_id", s.json_get(props, "$.k", "bigint", -1).alias("k"), s.json_get(props, "$.none", "string", "absent").alias("missing"))


@book.query("fn_first_number", "SELECT doc_id, coalesce(list_filter(list_transform(string_split('version ' || (doc_id % 7) || '.' || (doc_id % 10) || ' of 10.2.1', ' '), lambda t: try_cast(t AS DOUBLE)), lambda t: t IS NOT NULL)[1], 0) AS number FROM documents")
def fn_first_number(spark, sf_dir):
    text = F.concat(F.lit("version "), (F.col("doc_id") % 7).cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string"), F.lit(" of 10.2.1"))
    return b.table(spark, sf_dir, "documents").select("doc_id", s.first_number(text).alias("number"))


@book.query("fn_cve_year", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y FROM orders")
def fn_cve_year(spark, sf_dir):
    ident = F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", s.id_year(ident).alias("y"))


@book.query("udf_identify_model", "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey % 2 = 0 THEN 'Both' WHEN c_acctbal > 0 THEN 'Relational' WHEN c_nationkey % 2 = 0 THEN 'Non Relational' ELSE 'None' END AS class FROM customer")
def udf_identify_model(spark, sf_dir):
    from techtrail.operators.models import model_class

    return b.table(spark, sf_dir, "customer").select("c_custkey", model_class(F.col("c_acctbal") > 0, F.col("c_nationkey") % 2 == 0).alias("class"))


@book.query("udf_categorize", f"WITH {b.HISTORY_SQL} SELECT user_id, part, label, CASE WHEN label IN ('click', 'view') THEN 'Relational' WHEN label IN ('purchase', 'signup') THEN 'Document' ELSE 'Multi Model' END AS model FROM hist")
def udf_categorize(spark, sf_dir):
    from techtrail.operators.models import attach_model
    from techtrail.plans.histories import catalogue

    return attach_model(b.history(spark, sf_dir), catalogue(spark)).select("user_id", F.col("part").cast("long").alias("part"), "label", "model")


@book.query("udf_group_apply", f"WITH {b.HISTORY_SQL} SELECT user_id, max(part) AS part FROM hist WHERE part <= greatest((SELECT n_parts FROM sizes s WHERE s.user_id = hist.user_id) // 2, 1) GROUP BY user_id")
def udf_group_apply(spark, sf_dir):
    """A function of each group's rows, as a user would write one: the middle slice."""
    from techtrail.operators.groups import apply_group

    def middle(rows):
        parts = sorted(rows["part"].unique())
        return rows[rows["part"] == parts[max(len(parts) // 2, 1) - 1]].head(1)[["user_id", "part"]]

    return apply_group(b.history(spark, sf_dir).withColumn("part", F.col("part").cast("long")), ["user_id"], middle, "user_id long, part long")


@book.query("udtf_commit_lists", "WITH t AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '; ' ORDER BY o_orderkey::VARCHAR) AS ids FROM orders GROUP BY o_custkey) SELECT o_custkey, o_orderkey FROM orders")
def udtf_commit_lists(spark, sf_dir):
    texts = b.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(aggregates.joined(F.col("o_orderkey").cast("string"), "; ").alias("ids"))
    return texts.select("o_custkey", F.explode(s.split_rows(F.col("ids"), ";")).alias("o_orderkey")).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@book.query("udaf_union", f"WITH {b.HISTORY_SQL} SELECT label, user_id // {b.BLOCK} AS block, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users FROM hist GROUP BY ALL")
def udaf_union(spark, sf_dir):
    """Users of each label, in blocks of bounded size."""
    sets = b.history(spark, sf_dir).groupBy("label", b.block("user_id"), "part").agg(F.collect_set(F.col("user_id").cast("string")).alias("users"))
    return sets.groupBy("label", "block").agg(F.array_join(aggregates.set_union(F.col("users")), ",").alias("users"))


@book.query("strategy_hook", f"WITH {b.TRANSITIONS_SQL} SELECT label, count(DISTINCT user_id) AS projects, 'usage' AS strategy FROM hist GROUP BY label UNION ALL SELECT label, count(*), 'changes' FROM tr GROUP BY label")
def strategy_hook(spark, sf_dir):
    from techtrail.operators.groups import Strategy, run_strategies

    shared = {"hist": written(b.history(spark, sf_dir), "history")}
    made = run_strategies(shared, [Strategy("usage", lambda ctx: aggregates.usage(ctx["hist"], "user_id")), Strategy("changes", lambda ctx: sequences.transitions(ctx["hist"]).groupBy("label").agg(F.count("*").alias("projects")))])
    return made["usage"].withColumn("strategy", F.lit("usage")).unionByName(made["changes"].withColumn("strategy", F.lit("changes")))


NAMES = [("licence", "licensed under"), ("token", "token ="), ("rights", "rights reserved")]


@book.query(
    "vuln_build",
    """WITH m AS (SELECT 'CVE-' || (2000 + doc_id % 20) || '-' || doc_id AS name, n.label, n.k, text FROM documents, (VALUES ('licence', 'licensed under', 1), ('token', 'token =', 2), ('rights', 'rights reserved', 3)) n(label, alias, k) WHERE contains(lower(text), n.alias)),
    f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS rn FROM m) SELECT name, label, split_part(name, '-', 2)::INTEGER AS year, coalesce(list_filter(list_transform(string_split(text, ' '), lambda t: try_cast(t AS DOUBLE)), lambda t: t IS NOT NULL)[1], 0) AS version FROM f WHERE rn = 1""",
)
def vuln_build(spark, sf_dir):
    name = F.concat(F.lit("CVE-"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    texts = b.table(spark, sf_dir, "documents").select(name.alias("name"), F.col("text").alias("description"))
    return reviews.build_vulnerabilities(texts, NAMES, {"licence": 1, "token": 2, "rights": 3})


@book.query("vuln_export", "SELECT 'CVE-' || (2000 + doc_id % 20) || '-' || doc_id AS name, source AS label, (2000 + doc_id % 20)::INTEGER AS year FROM documents WHERE contains(lower(text), 'rights reserved')")
def vuln_export(spark, sf_dir):
    found = vuln_build(spark, sf_dir).select("name", "year")
    name = F.concat(F.lit("CVE-"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    labels = b.table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("rights reserved"))).select(name.alias("name"), F.col("source").alias("label"))
    return found.join(labels, "name").select("name", "label", "year")


RATED_SQL = "rated AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS a, CASE WHEN toxic = 0 THEN 'yes' ELSE 'no' END AS b FROM labels)"


def rated(spark, sf_dir):
    word = lambda c: F.when(c, "yes").otherwise("no")
    return b.table(spark, sf_dir, "labels").select("doc_id", word(F.col("quality") == 1).alias("a"), word(F.col("toxic") == 0).alias("b"))


@book.query("agreement", f"WITH {RATED_SQL} SELECT count(*) AS rated, count(*) FILTER (a = b) AS agreed, avg((a = b)::INTEGER) AS share FROM rated")
def agreement(spark, sf_dir):
    return reviews.agreement(rated(spark, sf_dir), "a", "b")


@book.query("agreement_rows", f"WITH {RATED_SQL} SELECT doc_id, a, b FROM rated WHERE a = b")
def agreement_rows(spark, sf_dir):
    return reviews.agreed(rated(spark, sf_dir), "a", "b")


EXEC_SQL = "executions AS (SELECT conv_id AS project, role AS label, CASE WHEN bool_or(text IS NULL) THEN '' ELSE max(md5(text)) END AS output, false AS is_validated, false AS is_accepted, '' AS user FROM conversations GROUP BY ALL), verdicts AS (SELECT conv_id AS project, role AS label, turn, turn % 2 = 0 AS is_validated, turn % 3 = 0 AS is_accepted, 'user' || (turn % 4) AS user FROM conversations), latest AS (SELECT project, label, max((turn, is_validated, is_accepted, user)) AS v FROM verdicts GROUP BY ALL)"


def executions(spark, sf_dir):
    rows = b.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("project"), F.col("role").alias("label"))
    made = rows.agg(F.when(F.bool_or(F.col("text").isNull()), "").otherwise(F.max(F.md5("text"))).alias("output"))
    return made.withColumns({"is_validated": F.lit(False), "is_accepted": F.lit(False), "user": F.lit("")})


def verdicts(spark, sf_dir):
    turn = F.col("turn")
    return b.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.col("role").alias("label"), turn, (turn % 2 == 0).alias("is_validated"), (turn % 3 == 0).alias("is_accepted"), F.concat(F.lit("user"), (turn % 4).cast("string")).alias("user"))


def applied(spark, sf_dir):
    return reviews.apply_verdicts(executions(spark, sf_dir), verdicts(spark, sf_dir), ["project", "label"], ["turn"])


APPLIED_SQL = f"{EXEC_SQL}, applied AS (SELECT project, label, output, v[2] AS is_validated, v[3] AS is_accepted, v[4] AS user FROM executions JOIN latest USING (project, label))"


@book.query("apply_verdict", f"WITH {APPLIED_SQL} SELECT project, label, is_validated, is_accepted, user FROM applied")
def apply_verdict(spark, sf_dir):
    return applied(spark, sf_dir).select("project", "label", "is_validated", "is_accepted", "user")


@book.query("review_status", f"WITH {APPLIED_SQL} SELECT project, label, is_validated, is_accepted, user FROM applied WHERE output <> ''")
def review_status(spark, sf_dir):
    nested = reviews.review_status(applied(spark, sf_dir))
    return nested.select("project", F.explode("status").alias("label", "v")).select("project", "label", "v.is_validated", "v.is_accepted", "v.user")


@book.query("review_lists", f"WITH {APPLIED_SQL} SELECT project, label FROM applied WHERE output <> '' ORDER BY project, lower(label)")
def review_lists(spark, sf_dir):
    return applied(spark, sf_dir).where("output <> ''").select("project", "label").orderBy("project", F.lower("label"))


QUERIES, ORACLE = book.queries, book.sql
