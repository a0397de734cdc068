"""Queries that filter, reshape, join and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from techtrail.operators import columns as c
from techtrail.operators import joins as j
from techtrail.plans import bindings as b
from techtrail.plans.book import Book

book = Book()
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def meta(spark, sf_dir):
    """Projects with their measures: customers, their orders and sums."""
    orders = b.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    customers = b.table(spark, sf_dir, "customer").join(b.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.col("n_name").alias("language"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "total")


META_SQL = "meta AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name AS language, coalesce(n_orders, 0) AS n_orders, total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"
WIDE_SQL = "wide AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS {x}" for x in EVENT_TYPES) + " FROM events GROUP BY user_id)"


def wide(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"))
    return c.pivot_labels(events, ["user_id"], EVENT_TYPES, F.count(F.lit(1)))


@book.query("filter_threshold", f"WITH {META_SQL} SELECT c_custkey, n_orders FROM meta WHERE n_orders >= 10 AND c_acctbal >= 1000 AND c_mktsegment = 'BUILDING'")
def filter_threshold(spark, sf_dir):
    return c.filter_corpus(meta(spark, sf_dir), {"n_orders": 10, "c_acctbal": 1000}, {"c_mktsegment": "BUILDING"}).select("c_custkey", "n_orders")


@book.query("filter_discarded", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN 'done' END IS NULL")
def filter_discarded(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").withColumn("reason", F.when(F.col("o_orderstatus") == "F", "done"))
    return c.drop_discarded(rows, "reason").select("o_orderkey")


@book.query("filter_regex_any", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(?:https://m\\.)|^(?:http://t)')")
def filter_regex_any(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").where(c.matches_any(F.col("url"), [r"https://m\.", "http://t"])).select("page_id", "url")


@book.query("filter_position", "SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 101 AND 300")
def filter_position(spark, sf_dir):
    return c.filter_position(b.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate")), ["o_orderdate", "o_orderkey"], 101, 300)


@book.query("filter_group_size", "SELECT event_id, user_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 70")
def filter_group_size(spark, sf_dir):
    return c.filter_group_size(b.table(spark, sf_dir, "events"), ["user_id"], 70).select("event_id", "user_id")


@book.query("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@book.query("filter_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@book.query("filter_contains_ci", "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed')")
def filter_contains_ci(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").where(c.contains_ci(F.col("text"), "Licensed")).select("doc_id")


@book.query("flag_keywords", "SELECT doc_id, coalesce(regexp_matches(text, '(?i)(?:licen[sc]e)|(?:token)|(?:rights)'), false) OR coalesce(regexp_matches(source, '(?i)(?:licen[sc]e)|(?:token)|(?:rights)'), false) AS flagged FROM documents")
def flag_keywords(spark, sf_dir):
    return c.flag_keywords(b.table(spark, sf_dir, "documents"), ["text", "source"], ["licen[sc]e", "token", "rights"], "flagged").select("doc_id", "flagged")


@book.query("flatten_first_leaf", "SELECT o_orderkey, o_custkey AS customer, o_totalprice AS price FROM orders")
def flatten_first_leaf(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    nested = orders.select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("totalCount")).alias("nodes"), "o_orderstatus").alias("customer"), F.struct(F.col("o_totalprice").alias("total")).alias("price"))
    return c.flatten_first_leaf(nested)


@book.query("flag_mirror", "SELECT doc_id, doc_id % 10 = 0 OR coalesce(regexp_matches(text, '(?i)\\bthe\\b'), false) AS is_mirror FROM documents")
def flag_mirror(spark, sf_dir):
    rows = b.table(spark, sf_dir, "documents").withColumn("is_mirror", F.col("doc_id") % 10 == 0)
    return c.flag_regex(rows, "text", r"(?i)\bthe\b", "is_mirror").select("doc_id", "is_mirror")


@book.query("rename_map", "SELECT label, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'press' ELSE event_type END AS label FROM events) GROUP BY label")
def rename_map(spark, sf_dir):
    return b.table(spark, sf_dir, "events").groupBy(c.canonical(F.col("event_type"), {"click": "press", "view": "press"}).alias("label")).agg(F.count("*").alias("n"))


@book.query("regex_replace_map", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '', 'g'), '[?#].*$', '', 'g') AS url FROM pages")
def regex_replace_map(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", c.replace_all(F.col("url"), {"^https?://": "", "[?#].*$": ""}).alias("url"))


@book.query("drop_columns", f"WITH {WIDE_SQL} SELECT {', '.join(EVENT_TYPES)} FROM wide")
def drop_columns(spark, sf_dir):
    found = wide(spark, sf_dir)
    return found.select(*c.label_columns(found, ["user_id"]))


@book.query("select_range", f"WITH {WIDE_SQL} SELECT user_id, purchase, signup FROM wide")
def select_range(spark, sf_dir):
    """Label columns by name from one on to another; a place in the table means nothing."""
    found = wide(spark, sf_dir)
    names = c.label_columns(found, ["user_id"])
    return found.select("user_id", *names[names.index("purchase") : names.index("signup") + 1])


@book.query("combine_multimodel", f"WITH {WIDE_SQL} SELECT user_id, error, purchase, signup, click + view AS seen FROM wide")
def combine_multimodel(spark, sf_dir):
    return c.combine(wide(spark, sf_dir), ["click", "view"], "seen")


@book.query("and_join_columns", f"WITH {b.HISTORY_SQL} SELECT user_id, part, label FROM hist WHERE label NOT IN ('click', 'view') UNION ALL SELECT user_id, part, 'click and view' FROM hist WHERE label IN ('click', 'view') GROUP BY ALL HAVING count(DISTINCT label) = 2")
def and_join_columns(spark, sf_dir):
    return c.and_labels(b.history(spark, sf_dir).withColumn("part", F.col("part").cast("long")), ["user_id", "part"], "click", "view", "click and view")


@book.query("binarise", f"WITH {WIDE_SQL} SELECT user_id, {', '.join(f'({x} > 0)::INTEGER AS {x}' for x in EVENT_TYPES)} FROM wide")
def binarise(spark, sf_dir):
    return c.binarise(wide(spark, sf_dir), EVENT_TYPES)


@book.query("zero_to_null", f"WITH {WIDE_SQL} SELECT user_id, {', '.join(f'nullif({x}, 0) AS {x}' for x in EVENT_TYPES)} FROM wide")
def zero_to_null(spark, sf_dir):
    return c.zero_to_null(wide(spark, sf_dir), EVENT_TYPES)


@book.query("drop_all_zero_rows", f"WITH {WIDE_SQL} SELECT user_id FROM wide WHERE error + signup > 30")
def drop_all_zero_rows(spark, sf_dir):
    less = wide(spark, sf_dir).select("user_id", (F.col("error") + F.col("signup") - 30).alias("over"))
    return c.drop_unlabelled(less, ["over"]).select("user_id")


@book.query("drop_all_null_rows", f"WITH {META_SQL} SELECT c_custkey FROM meta WHERE total IS NOT NULL OR nullif(n_orders, 0) IS NOT NULL")
def drop_all_null_rows(spark, sf_dir):
    return c.zero_to_null(meta(spark, sf_dir), ["n_orders"]).na.drop("all", subset=["total", "n_orders"]).select("c_custkey")


@book.query("fill_null", f"WITH {META_SQL} SELECT c_custkey, coalesce(total, 0) AS total FROM meta")
def fill_null(spark, sf_dir):
    return meta(spark, sf_dir).na.fill(0.0, ["total"]).select("c_custkey", "total")


@book.query("pivot_labels", f"WITH {WIDE_SQL} SELECT * FROM wide")
def pivot_labels(spark, sf_dir):
    return wide(spark, sf_dir)


@book.query("unpivot_labels", f"WITH {WIDE_SQL} SELECT user_id, label, value FROM wide UNPIVOT (value FOR label IN ({', '.join(EVENT_TYPES)}))")
def unpivot_labels(spark, sf_dir):
    return c.unpivot_labels(wide(spark, sf_dir), ["user_id"], EVENT_TYPES)


DAYS = range(1, 32)


@book.query("transpose", "SELECT event_type AS label, " + ", ".join(f"max(n) FILTER (day = {d}) AS d{d}" for d in DAYS) + " FROM (SELECT event_type, day(ts) AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def transpose(spark, sf_dir):
    """Days of the month become columns."""
    rows = b.table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.day("ts").cast("string")).alias("day"), F.col("event_type").alias("label"))
    return c.transpose(c.pivot_labels(rows, ["day"], EVENT_TYPES, F.count(F.lit(1)), None), "day", EVENT_TYPES, [f"d{d}" for d in DAYS])


@book.query("derive_path_parts", "SELECT page_id, nullif(split_part(url, '/', 4), '') AS project, nullif(regexp_extract(url, '\\.([^./]+)$', 1), '') AS extension, contains(url, 'src/test') AS is_test FROM pages")
def derive_path_parts(spark, sf_dir):
    parts = c.path_parts(F.col("url"), 4)
    return b.table(spark, sf_dir, "pages").select("page_id", F.nullif(parts["project"], F.lit("")).alias("project"), parts["extension"].alias("extension"), parts["is_test"].alias("is_test"))


@book.query("needs_refresh", f"WITH {META_SQL} SELECT c_mktsegment || '/' || c_name AS repository FROM meta WHERE n_orders < 8 AND c_acctbal >= 0")
def needs_refresh(spark, sf_dir):
    """A measure is not known yet where there are few orders; those in debt are discarded."""
    rows = meta(spark, sf_dir).withColumn("reason", F.when(F.col("c_acctbal") < 0, "debt")).withColumn("measured", F.when(F.col("n_orders") >= 8, F.col("total")))
    return c.needs_refresh(rows, "reason", "measured", "c_mktsegment", "c_name")


@book.query("bibtex_format", "SELECT '@article{' || doc_id || ',' || chr(10) || '  author = {' || source || '},' || chr(10) || '  title = {' || regexp_replace(split_part(text, chr(10), 1), '\\.$', '') || '},' || chr(10) || '  year = {' || (2000 + doc_id % 20) || '},' || chr(10) || '  url = {' || lang || '}' || chr(10) || '}' AS entry FROM documents WHERE text IS NOT NULL")
def bibtex_format(spark, sf_dir):
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    record = c.bibtex(F.lit("article"), F.col("doc_id").cast("string"), F.col("source"), title, (2000 + F.col("doc_id") % 20).cast("string"), F.col("lang"))
    return b.table(spark, sf_dir, "documents").where("text is not null").select(record.alias("entry"))


@book.query("join_inner_chain", "SELECT e.event_id, c_name, n_name, r_name FROM events e JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE props <> ''")
def join_inner_chain(spark, sf_dir):
    dims = b.table(spark, sf_dir, "customer").join(b.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(b.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return b.table(spark, sf_dir, "events").where("props <> ''").join(dims, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "n_name", "r_name")


@book.query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").join(b.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@book.query("join_inner_multi", "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 10")
def join_inner_multi(spark, sf_dir):
    parts = b.table(spark, sf_dir, "part").where("p_size < 10")
    return b.table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(b.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name")


def two_key_sets(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    a = orders.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k"))
    z = orders.where("o_orderpriority like '2%'").select(F.col("o_custkey").alias("k"))
    return a, z


SETS_SQL = "a AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), z AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '2%')"


@book.query("join_outer_indicator", f"WITH {SETS_SQL} SELECT k, CASE WHEN z2.k2 IS NULL THEN 'left_only' WHEN a2.k1 IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT DISTINCT k, k AS k1 FROM a) a2 FULL JOIN (SELECT DISTINCT k, k AS k2 FROM z) z2 USING (k)")
def join_outer_indicator(spark, sf_dir):
    a, z = two_key_sets(spark, sf_dir)
    return j.outer_indicator(a.distinct(), z.distinct(), ["k"])


@book.query(
    "join_asof_grid",
    """WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders GROUP BY o_custkey), g AS (SELECT o_custkey, make_date(unnest(range(y, 1999)), 7, 1) AS due FROM f WHERE y <= 1998),
    r AS (SELECT g.o_custkey, g.due, o.o_orderkey, row_number() OVER (PARTITION BY g.o_custkey, g.due ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn FROM g JOIN orders o ON o.o_custkey = g.o_custkey AND o.o_orderdate <= g.due) SELECT o_custkey, due, o_orderkey FROM r WHERE rn = 1""",
)
def join_asof_grid(spark, sf_dir):
    return j.asof_grid(b.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 7, 1, 1998)


NAMES = [("licence", "licensed under"), ("licence", "license"), ("token", "token ="), ("rights", "rights reserved")]


@book.query("join_substring", "SELECT DISTINCT doc_id, n.name FROM documents, (VALUES " + ", ".join(f"('{a}', '{z}')" for a, z in NAMES) + ") n(name, alias) WHERE contains(lower(text), n.alias)")
def join_substring(spark, sf_dir):
    return j.match_names(b.table(spark, sf_dir, "documents").select("doc_id", "text"), NAMES).select("doc_id", "name")


@book.query("semi_join", f"WITH {SETS_SQL} SELECT k FROM a WHERE k IN (SELECT k FROM z)")
def semi_join(spark, sf_dir):
    return j.present(*two_key_sets(spark, sf_dir), ["k"])


@book.query("anti_join", f"WITH {SETS_SQL} SELECT k FROM a WHERE k NOT IN (SELECT k FROM z)")
def anti_join(spark, sf_dir):
    return j.missing(*two_key_sets(spark, sf_dir), ["k"])


@book.query("set_difference", f"WITH {SETS_SQL} SELECT k FROM a EXCEPT SELECT k FROM z")
def set_difference(spark, sf_dir):
    a, z = two_key_sets(spark, sf_dir)
    return a.subtract(z)


@book.query("set_intersect", f"WITH {SETS_SQL} SELECT k FROM a INTERSECT SELECT k FROM z")
def set_intersect(spark, sf_dir):
    a, z = two_key_sets(spark, sf_dir)
    return a.intersect(z)


@book.query(
    "set_equal",
    f"""WITH {SETS_SQL}, c AS (SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM z) AS rows_b, (SELECT count(DISTINCT k) FROM a) AS keys_a, (SELECT count(DISTINCT k) FROM z) AS keys_b, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM z)) AS in_both)
    SELECT *, keys_a - in_both AS only_a, keys_b - in_both AS only_b, keys_a = in_both AND keys_b = in_both AS equal FROM c""",
)
def set_equal(spark, sf_dir):
    return j.compare_keys(*two_key_sets(spark, sf_dir), ["k"])


@book.query("find_duplicates", f"WITH {SETS_SQL} SELECT k, count(*) AS n FROM a GROUP BY k HAVING count(*) > 1")
def find_duplicates(spark, sf_dir):
    return j.duplicates(two_key_sets(spark, sf_dir)[0], ["k"])


@book.query("union_distinct", f"WITH {SETS_SQL} SELECT k FROM a UNION SELECT k FROM z")
def union_distinct(spark, sf_dir):
    return j.union_distinct(*two_key_sets(spark, sf_dir))


@book.query("union_all_inner", "SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all_inner(spark, sf_dir):
    rename = lambda t, p: t.select(*(F.col(x).alias(x.removeprefix(p)) for x in t.columns))
    customers = rename(b.table(spark, sf_dir, "customer"), "c_").drop("name")
    return j.union_common(customers, rename(b.table(spark, sf_dir, "supplier"), "s_"))


@book.query("upsert_by_key", "SELECT o_orderkey, 'stored' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def upsert_by_key(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey")
    return j.upsert(orders.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("stored")), orders.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("new")), ["o_orderkey"])


MERGE_SQL = """named AS (SELECT p_name || '/' || p_brand || '/' || p_type AS name, min(p_partkey) AS p_partkey, max(p_size) AS size FROM part GROUP BY ALL),
a AS (SELECT p_partkey AS id, name FROM named WHERE size <= 30), z AS (SELECT p_partkey + 5 AS id, name FROM named WHERE size >= 20),
m AS (SELECT z.id AS old_id, a.id AS a_id, z.name FROM z LEFT JOIN a USING (name)),
fresh AS (SELECT old_id, name, (SELECT coalesce(max(id), 0) FROM a) + row_number() OVER (ORDER BY old_id) AS new_id FROM m WHERE a_id IS NULL)"""


def _stores(spark, sf_dir):
    """Parts of smaller sizes in one store, of larger ones in another, those between in both, under other ids."""
    name = F.concat_ws("/", "p_name", "p_brand", "p_type").alias("name")
    named = b.table(spark, sf_dir, "part").groupBy(name).agg(F.min("p_partkey").alias("p_partkey"), F.max("p_size").alias("size"))
    store = lambda rule, shift: named.where(rule).select((F.col("p_partkey") + shift).alias("id"), "name")
    return j.merge_stores(store("size <= 30", 0), store("size >= 20", 5), ["name"])


@book.query("merge_databases", f"WITH {MERGE_SQL} SELECT id, name FROM a UNION ALL SELECT new_id, name FROM fresh")
def merge_databases(spark, sf_dir):
    return _stores(spark, sf_dir)[0]


@book.query("merge_databases_keys", f"WITH {MERGE_SQL}, ids AS (SELECT old_id, a_id AS new_id FROM m WHERE a_id IS NOT NULL UNION ALL SELECT old_id, new_id FROM fresh) SELECT l_orderkey, l_linenumber, new_id AS l_partkey FROM lineitem JOIN ids ON l_partkey = old_id")
def merge_databases_keys(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return j.rewrite_key(lines, _stores(spark, sf_dir)[1], "l_partkey")


@book.query("combine_first", "SELECT coalesce(a.k, z.k) AS k, coalesce(a.v, z.v) AS v FROM (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) z ON a.k = z.k")
def combine_first(spark, sf_dir):
    of = lambda s: b.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return j.combine_first(of("F"), of("O"), ["k"], "v")


@book.query("corpus_sync", f"WITH {SETS_SQL} SELECT k, CASE WHEN k % 10 = 0 THEN 'ignore' WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM z) THEN 'keep' WHEN k IN (SELECT k FROM a) THEN 'add' ELSE 'delete' END AS action FROM (SELECT k FROM a UNION SELECT k FROM z)")
def corpus_sync(spark, sf_dir):
    return j.sync_plan(*two_key_sets(spark, sf_dir), ["k"], ignored=F.col("k") % 10 == 0)


@book.query("multi_model_bridge", "SELECT p_name AS label, s_name AS category, min(l_linenumber) = 1 AS is_main FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 5 GROUP BY p_partkey, p_name, s_suppkey, s_name")
def multi_model_bridge(spark, sf_dir):
    bridge = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("label_id"), F.col("l_suppkey").alias("category_id")).agg((F.min("l_linenumber") == 1).alias("is_main"))
    labels = b.table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("label"))
    return j.label_categories(labels, bridge, b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("category_id"), F.col("s_name").alias("category")))


QUERIES, ORACLE = book.queries, book.sql
