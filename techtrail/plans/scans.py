"""Queries over lines of files."""

from __future__ import annotations

from pyspark.sql import functions as F
from techtrail.operators import scan
from techtrail.plans import bindings as b
from techtrail.plans.book import Book

book = Book()
#: In the test tables a file's end is its language.
CODE, TEST, XML, BUILD = ".en", "/1", ".fr", ".es"


def _regex_sql(label, alternatives):
    return "'" + scan.label_regex(label, alternatives).replace("'", "''") + "'"


HITS_SQL = b.LINES_SQL + ", hits AS (" + " UNION ALL ".join(f"SELECT project, path, line_no, line, '{label}' AS label, '{kind}' AS type FROM lines WHERE regexp_matches(line, {_regex_sql(label, xs)})" for label, kind, xs in b.PATTERNS) + ")"
LABELS_SQL = "labels_ AS (SELECT * FROM (VALUES " + ", ".join(f"('{label}', '{kind}')" for label, kind, _ in b.PATTERNS) + ") l(label, type)), scanned AS (SELECT DISTINCT project, label, type FROM files, labels_)"
KIND_SQL = f"CASE WHEN path LIKE '%{CODE}' AND path LIKE '%{TEST}%' THEN 'test' WHEN path LIKE '%{CODE}' THEN 'code' ELSE 'other' END"
KIND4_SQL = KIND_SQL.replace("ELSE", f"WHEN path LIKE '%{XML}' THEN 'xml' ELSE")


def hits(spark, sf_dir):
    return scan.scan_texts(b.texts(spark, sf_dir), b.PATTERNS)


def labels(spark):
    return spark.createDataFrame([(x[0], x[1]) for x in b.PATTERNS], "label string, type string")


def scanned(spark, sf_dir):
    return b.files(spark, sf_dir).select("project").distinct().crossJoin(F.broadcast(labels(spark).select("label")))  # a short list of labels


@book.query("scan_hits", f"WITH {HITS_SQL} SELECT project, path, line_no, label, type FROM hits")
def scan_hits(spark, sf_dir):
    return hits(spark, sf_dir).select("project", "path", "line_no", "label", "type")


@book.query("scan_ignore_case", f"WITH {HITS_SQL} SELECT path, line_no FROM hits WHERE label LIKE '(IgnoreCase%'")
def scan_ignore_case(spark, sf_dir):
    return scan.scan_texts(b.texts(spark, sf_dir), [x for x in b.PATTERNS if x[0].startswith("(IgnoreCase")]).select("path", "line_no")


@book.query(
    "scan_context",
    f"""WITH {HITS_SQL}, near AS (SELECT l.path, h.label, l.line_no, bool_or(l.line_no = h.line_no) AS is_hit, any_value(md5(l.line)) AS line
        FROM hits h JOIN lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 5 AND h.line_no + 5 GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY path, label ORDER BY line_no) = 1 THEN 0 ELSE 1 END AS begins FROM near)
    SELECT path, label, sum(begins) OVER (PARTITION BY path, label ORDER BY line_no)::BIGINT AS block, line_no, is_hit, line FROM marked""",
)
def scan_context(spark, sf_dir):
    return scan.scan_context(b.texts(spark, sf_dir), b.PATTERNS).withColumn("line", F.md5("line"))


@book.query("scan_exists", f"WITH {HITS_SQL}, {LABELS_SQL} SELECT s.project, s.label, CASE WHEN h.label IS NULL THEN 0 ELSE 1 END AS found FROM scanned s LEFT JOIN (SELECT DISTINCT project, label FROM hits) h USING (project, label)")
def scan_exists(spark, sf_dir):
    return scan.scan_exists(scanned(spark, sf_dir), hits(spark, sf_dir), ["project", "label"])


@book.query("scan_count_files", f"WITH {HITS_SQL} SELECT project, label, count(DISTINCT path) AS files FROM hits GROUP BY ALL")
def scan_count_files(spark, sf_dir):
    return scan.count_files(hits(spark, sf_dir))


@book.query("scan_rate_files", f"WITH {HITS_SQL}, n AS (SELECT project, count(DISTINCT path) AS n FROM files GROUP BY project) SELECT project, label, count(DISTINCT path) AS files, count(DISTINCT path) / any_value(n) * 100 AS rate FROM hits JOIN n USING (project) GROUP BY ALL")
def scan_rate_files(spark, sf_dir):
    return scan.rate_files(hits(spark, sf_dir), b.files(spark, sf_dir))


@book.query(
    "scan_code_test",
    f"""WITH {HITS_SQL}, r AS (SELECT DISTINCT project, label, path, {KIND_SQL} AS kind FROM hits), c AS (SELECT project, count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind = 'test') AS test, count(*) FILTER (kind = 'other') AS other, count(DISTINCT label) AS n FROM r GROUP BY project)
    SELECT p.project, coalesce(code, 0) AS code, coalesce(test, 0) AS test, coalesce(other, 0) AS other, {len(b.PATTERNS)} - coalesce(n, 0) AS none FROM (SELECT DISTINCT project FROM files) p LEFT JOIN c USING (project)""",
)
def scan_code_test(spark, sf_dir):
    return scan.code_test(hits(spark, sf_dir), b.files(spark, sf_dir).select("project").distinct(), len(b.PATTERNS), CODE, TEST)


SCOPED_SQL = "stems AS (SELECT DISTINCT source AS project, lang AS stem FROM documents), scoped AS (SELECT DISTINCT l.project, l.path, l.line_no, s.stem FROM lines l JOIN stems s ON l.project = s.project AND regexp_matches(l.line, '(\\s|[.,(]|^)' || s.stem || '(\\s|[.,(]|$)'))"


def scoped(spark, sf_dir):
    """Lines of sources that have the name of a language of their own as a word."""
    stems = b.table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("stem"))
    return scan.scan_scoped(b.lines(spark, sf_dir), stems)


FAN_IN = [f"{side}_{kind}" for side in ("db", "dep") for kind in ("test", "code", "xml", "other")]
FAN_IN_RULES = {f"{side}_{kind}": f"kind = '{kind}' AND {'dependency' if side == 'dep' else 'NOT dependency'}" for side in ("db", "dep") for kind in ("test", "code", "xml", "other")}
#: As the scan's export has it: a file counts once for each label, labels that begin with the project's name are dependencies, percentages are of all files of the project, blanks stand for zeros.
FAN_IN_SQL = f"""WITH {HITS_SQL}, {SCOPED_SQL}, every AS (SELECT project, label, path FROM hits UNION ALL SELECT project, project || '.' || stem, path FROM scoped),
    r AS (SELECT DISTINCT project, label, path, starts_with(label, replace(project, '/', '.')) AS dependency, {KIND4_SQL} AS kind FROM every),
    c AS (SELECT p.project, {", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in FAN_IN_RULES.items())}, count(r.path) AS total_db
        FROM (SELECT DISTINCT project FROM files) p LEFT JOIN r USING (project) GROUP BY p.project),
    n AS (SELECT project, count(DISTINCT path) AS total_project FROM files GROUP BY project)
    SELECT project, {", ".join(f"nullif({x}, 0) AS {x}" for x in [*FAN_IN, "total_db", "total_project"])},
        {", ".join(f"nullif({x} / total_project * 100, 0) AS pct_{x}" for x in [*FAN_IN, "total_db"] if not x.endswith("_other"))} FROM c JOIN n USING (project)"""


@book.query("usage_fan_in", FAN_IN_SQL)
@book.query("scan_code_test_xml", FAN_IN_SQL)
def scan_code_test_xml(spark, sf_dir):
    """Hits of the scan, and those of each project's own words, which are its dependencies."""
    own = scoped(spark, sf_dir).select("project", F.concat("project", F.lit("."), "stem").alias("label"), "path")
    return scan.usage_fan_in(hits(spark, sf_dir).select("project", "label", "path").unionByName(own), b.files(spark, sf_dir), CODE, TEST, XML)


@book.query(
    "scan_build_file",
    f"""WITH {HITS_SQL}, {LABELS_SQL}, c AS (SELECT project, label, count(DISTINCT path) FILTER (path LIKE '%{BUILD}') AS n, max(path) FILTER (path LIKE '%{BUILD}') AS path FROM hits GROUP BY ALL)
    SELECT s.project, s.label, (CASE WHEN n IS NULL THEN 0 WHEN n = 0 THEN -1 ELSE n END)::BIGINT AS status, CASE WHEN n = 1 THEN path END AS path FROM scanned s LEFT JOIN c USING (project, label)""",
)
def scan_build_file(spark, sf_dir):
    return scan.build_file_hits(scanned(spark, sf_dir), hits(spark, sf_dir), BUILD, ["project", "label"])


@book.query("scan_incremental", f"WITH {HITS_SQL}, {LABELS_SQL} SELECT project, label FROM scanned s WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.project = s.project AND h.label = s.label)")
def scan_incremental(spark, sf_dir):
    done = hits(spark, sf_dir).select("label", "project").distinct()
    return scan.pending(done, labels(spark).select("label"), b.files(spark, sf_dir).select("project").distinct()).select("project", "label")


@book.query("scan_invalidate", f"WITH {HITS_SQL}, e AS (SELECT path || ':' || line_no || ':' || label AS id, label, line_no % 2 = 0 AS is_validated, line_no % 3 = 0 AS is_accepted FROM hits) SELECT id, label FROM e WHERE NOT (label IN ('the', 'number') AND NOT (is_validated AND is_accepted))")
def scan_invalidate(spark, sf_dir):
    executions = hits(spark, sf_dir).select(F.concat_ws(":", "path", F.col("line_no").cast("string"), "label").alias("id"), "label", (F.col("line_no") % 2 == 0).alias("is_validated"), (F.col("line_no") % 3 == 0).alias("is_accepted"))
    old = spark.createDataFrame([(x[0], "|".join(x[2])) for x in b.PATTERNS], "label string, pattern string")
    new = old.withColumn("pattern", F.when(F.col("label").isin("the", "number"), F.concat("pattern", F.lit("x"))).otherwise(F.col("pattern")))
    return scan.invalidate(executions, old, new).select("id", "label")


@book.query("scan_scoped", f"WITH {b.LINES_SQL}, {SCOPED_SQL} SELECT * FROM scoped")
def scan_scoped(spark, sf_dir):
    return scoped(spark, sf_dir)


PENDING_SQL = f"""WITH {HITS_SQL}, {LABELS_SQL}, had AS (SELECT DISTINCT project, label FROM hits WHERE label IN ('the', 'number', 'licence')),
run AS (SELECT s.project, s.label, count(h.path) AS hits, count(DISTINCT h.path) AS files FROM scanned s ANTI JOIN had USING (project, label) LEFT JOIN hits h USING (project, label) GROUP BY ALL)"""


def pending_run(spark, sf_dir):
    done = hits(spark, sf_dir).where("label in ('the', 'number', 'licence')").select("label", "project").distinct()
    return done, scan.run_pending(done, b.PATTERNS, b.texts(spark, sf_dir), "project")


@book.query("scan_run_pending", f"{PENDING_SQL} SELECT * FROM run")
def scan_run_pending(spark, sf_dir):
    """Executions of what a scan of three labels has left, those without hits too."""
    return pending_run(spark, sf_dir)[1].select("project", "label", "hits", "files")


@book.query("scan_status", f"{PENDING_SQL} SELECT 'Success' AS status, count(*) AS n FROM run UNION ALL SELECT 'Skipped', count(*) FROM had UNION ALL SELECT 'Total', count(*) FROM scanned")
def scan_status(spark, sf_dir):
    done, run = pending_run(spark, sf_dir)
    return scan.scan_status(run, done, len(b.PATTERNS), b.files(spark, sf_dir).select("project").distinct())


@book.query("scan_selected", f"WITH {HITS_SQL} SELECT project, path, line_no, label FROM hits WHERE (project || label) IN (SELECT DISTINCT source || CASE WHEN length(source) % 2 = 0 THEN 'the' ELSE 'number' END FROM documents)")
def scan_selected(spark, sf_dir):
    """Each project is scanned for the labels that are chosen for it."""
    chosen = b.files(spark, sf_dir).select("project", F.when(F.length("project") % 2 == 0, "the").otherwise("number").alias("label")).distinct()
    return scan.scan_selected(b.texts(spark, sf_dir), b.PATTERNS, chosen).select("project", "path", "line_no", "label")


@book.query("make_class_pattern", "SELECT DISTINCT lang || '/' || doc_id || '.' || lang AS path, '(\\s|[.,(]|^)' || doc_id || '(\\s|[.,(]|$)' AS pattern FROM documents WHERE text IS NOT NULL")
def make_class_pattern(spark, sf_dir):
    return b.files(spark, sf_dir).select("path", scan.class_pattern(F.col("path")).alias("pattern")).distinct()


FIRST_SQL = f"""WITH {HITS_SQL}, m AS (SELECT DISTINCT project, label, path FROM hits WHERE type IN ('implementation', 'query')),
f AS (SELECT *, '(\\s|[.,(]|^)' || regexp_extract(path, '([^/.]+)[^/]*$', 1) || '(\\s|[.,(]|$)' AS pattern,
    CASE WHEN path NOT LIKE '%{CODE}' THEN 'other extension' WHEN row_number() OVER (PARTITION BY project, path ORDER BY label) > 1 THEN 'duplicated' ELSE 'opened' END AS status FROM m),
r AS (SELECT f.*, CASE WHEN status = 'opened' THEN (SELECT max(line_no) FROM lines l WHERE l.project = f.project AND l.path = f.path)::BIGINT END AS lines FROM f)"""


def first_rows(spark, sf_dir):
    return scan.first_level(hits(spark, sf_dir).where("type in ('implementation', 'query')"), b.texts(spark, sf_dir), CODE)


@book.query("first_level", f"{FIRST_SQL} SELECT project, label, path, pattern, status, lines FROM r")
def first_level(spark, sf_dir):
    return first_rows(spark, sf_dir)


FIRST_FILES_SQL = f"""{FIRST_SQL}, u AS (SELECT project, pattern, min((label, path)) AS first FROM r WHERE status = 'opened' GROUP BY ALL), n AS (SELECT project, pattern, row_number() OVER (PARTITION BY project ORDER BY first) AS nth FROM u)"""


@book.query("first_level_files", f"{FIRST_FILES_SQL} SELECT replace(project, '/', '.') || '.txt' AS file, nth AS line_no, pattern FROM n")
def first_level_files(spark, sf_dir):
    return scan.first_level_files(first_rows(spark, sf_dir))


@book.query("first_level_many_files", f"{FIRST_FILES_SQL} SELECT replace(project, '/', '.') || '.' || nth || '.txt' AS file, 1::BIGINT AS line_no, pattern FROM n")
def first_level_many_files(spark, sf_dir):
    return scan.first_level_files(first_rows(spark, sf_dir), multiple=True)


@book.query(
    "first_level_status",
    f"""{FIRST_SQL}, p AS (SELECT (SELECT count(DISTINCT source) FROM documents WHERE text IS NOT NULL) * {sum(x[1] in ("implementation", "query") for x in b.PATTERNS)} - (SELECT count(DISTINCT (project, label)) FROM r) AS none)
    SELECT 'Total' AS status, count(*) AS n FROM r UNION ALL SELECT 'Opened', count(*) FILTER (status = 'opened') FROM r UNION ALL SELECT 'Duplicated', count(*) FILTER (status = 'duplicated') FROM r
    UNION ALL SELECT 'Not extension', count(*) FILTER (status = 'other extension') FROM r UNION ALL SELECT 'None', none FROM p""",
)
def first_level_status(spark, sf_dir):
    kinds = labels(spark).where("type in ('implementation', 'query')")
    return scan.first_level_status(first_rows(spark, sf_dir), b.files(spark, sf_dir), kinds)


@book.query(
    "second_level_split",
    f"""WITH {HITS_SQL}, a AS (SELECT DISTINCT project, path FROM hits WHERE type = 'implementation'), z AS (SELECT DISTINCT project, path FROM hits WHERE type = 'query'), m AS (SELECT z.project, count(a.path) AS db_code, count(*) - count(a.path) AS dependencies FROM z LEFT JOIN a USING (project, path) GROUP BY z.project),
    n AS (SELECT project, count(DISTINCT path) AS n_files FROM files GROUP BY project) SELECT project, coalesce(db_code, 0) AS db_code, coalesce(dependencies, 0) AS dependencies, n_files, coalesce(db_code, 0) * 100 / n_files AS db_code_pct, coalesce(dependencies, 0) * 100 / n_files AS dependencies_pct FROM n LEFT JOIN m USING (project)""",
)
def second_level_split(spark, sf_dir):
    found = hits(spark, sf_dir)
    return scan.second_level(found.where("type = 'implementation'"), found.where("type = 'query'"), b.files(spark, sf_dir))


@book.query("build_tool_count", f"WITH {b.LINES_SQL}, d AS (SELECT project, split_part(path, '/', 1) AS folder, bool_or(path LIKE '%7{CODE}') AS maven, bool_or(path LIKE '%{XML}' OR path LIKE '%3{CODE}') AS gradle FROM files GROUP BY ALL) SELECT project, count(*) FILTER (maven) AS maven, count(*) FILTER (gradle AND NOT maven) AS gradle FROM d GROUP BY project")
def build_tool_count(spark, sf_dir):
    return scan.build_tools(b.files(spark, sf_dir), r"7\.en$", r"\.fr$|3\.en$")


@book.query(
    "scan_changes_only",
    """WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 2)::VARCHAR END AS output FROM events),
    l AS (SELECT *, last_value(nullif(output, '') IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e) SELECT user_id, event_type, event_id, output FROM l WHERE output = '' OR last IS NULL OR output <> last""",
)
def scan_changes_only(spark, sf_dir):
    output = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 2).cast("string"))
    return scan.changes_only(b.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", output.alias("output")), ["user_id", "event_type"], "event_id")


@book.query(
    "merge_split_executions",
    """WITH g AS (SELECT l_orderkey, count(*) AS n, max(l_quantity)::BIGINT * 4 AS patterns, string_agg(l_linenumber::VARCHAR || l_returnflag, chr(10) || chr(10) ORDER BY l_linenumber, l_linenumber::VARCHAR || l_returnflag) AS output FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, output, n AS pieces FROM g WHERE n = 1 OR n = ceil(patterns / 50)""",
)
def merge_split_executions(spark, sf_dir):
    parts = b.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("output"), (F.col("l_quantity").cast("long") * 4).alias("n_patterns"))
    return scan.merge_parts(parts, ["l_orderkey"])


@book.query(
    "extract_presets",
    f"""WITH {LABELS_SQL.split(", scanned AS")[0]}, v AS (SELECT event_id AS version_id, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_last, event_id % 5 = 0 AS sliced FROM events),
    presets AS (SELECT * FROM (VALUES ('last', 'last', 'database'), ('implementation', 'last', 'implementation'), ('query', 'last', 'query'),
        ('historical', 'historical', 'database'), ('historical implementation', 'historical', 'implementation')) p(preset, mode, type))
    SELECT preset, version_id, label FROM v JOIN presets ON (mode = 'last' AND is_last) OR (mode = 'historical' AND sliced) JOIN labels_ USING (type)""",
)
def extract_presets(spark, sf_dir):
    events = b.table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("event_id").alias("last"))
    versions = events.join(last, "user_id").select(F.col("event_id").alias("version_id"), (F.col("event_id") == F.col("last")).alias("is_last"), F.when(F.col("event_id") % 5 == 0, F.expr("event_id div 5")).alias("part"))
    return scan.scan_plan(versions, labels(spark))


QUERIES, ORACLE = book.queries, book.sql
