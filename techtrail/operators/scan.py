"""Scanning lines of files for labels' patterns, and tables made of the hits."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from techtrail.operators.bloom import that_may_meet
from techtrail.operators.literals import asks_for_ends, holds_for_texts, required
from techtrail.operators.ordering import carry_last, number_within

#: Letters that mean something after a backslash in Java's expressions; before others the backslash is dropped.
ESCAPES = set("bBdDsSwWnrtfxupPAzZQE")


def translate(pattern: str, clean: bool = False) -> str:
    """A line pattern as a Java expression; clean also strips invisible characters and blanks at its ends."""
    if clean:
        pattern = pattern.strip().strip("​﻿").strip()
    return re.sub(r"\\([A-Za-z])", lambda m: m[0] if m[1] in ESCAPES else m[1], pattern)


def label_regex(label: str, alternatives: Iterable[str], clean: bool = False) -> str:
    """One expression for all alternatives; labels that begin with (IgnoreCase ignore it."""
    return ("(?i)" if label.startswith("(IgnoreCase") else "") + "|".join(f"(?:{translate(x, clean)})" for x in alternatives)


def _tests(heuristics: list[tuple[str, str, list[str]]], clean: bool) -> list[tuple[str, str, str]]:
    return [(label, kind, label_regex(label, alternatives, clean)) for label, kind, alternatives in heuristics]


def scan(lines: DataFrame, heuristics: list[tuple[str, str, list[str]]], clean: bool = False) -> DataFrame:
    """lines with label and type, one row for each label that a line matches. All labels are tested in one projection, so each line is read once."""
    found = F.array(*(F.when(F.col("line").rlike(regex), F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"))) for label, kind, regex in _tests(heuristics, clean)))
    return lines.withColumn("hit", F.explode(F.array_compact(found))).select(*lines.columns, "hit.label", "hit.type")


#: Ends of lines to Java's expressions that lines are not cut at.
OTHER_ENDS = "\r\u0085\u2028\u2029"


def may_match(text: Column, label: str, alternatives: Iterable[str], clean: bool = False) -> Column:
    """Whether a text can have a line that matches the label, by the literals that each alternative asks for; an alternative without any is tried on the whole text, or holds for all texts if that says nothing about lines."""
    fold = label.startswith("(IgnoreCase")
    low = F.lower(text) if fold else text
    made = F.lit(False)
    for regex in (translate(x, clean) for x in alternatives):
        literals = required(regex, fold)
        if literals:
            for x in literals:
                made = made | F.contains(low, F.lit(x))
        elif holds_for_texts(regex) and asks_for_ends(regex):
            # a last line that is empty begins for the expression only before another end of a line, and other ends of lines than \n mean other things in a text
            for end in OTHER_ENDS:
                made = made | F.contains(text, F.lit(end))
            made = made | F.concat(text, F.lit("\n")).rlike(("(?mi)" if fold else "(?m)") + f"(?:{regex})")
        elif holds_for_texts(regex):
            made = made | text.rlike(("(?i)" if fold else "") + f"(?:{regex})")
        else:
            return F.lit(True)
    return made


def _candidates(files: DataFrame, heuristics: list[tuple[str, str, list[str]]], clean: bool, asked: str | None) -> DataFrame:
    """Files (text) with "may match", a flag for each label.

    There is no filter on the flags here, as it would be done before them and test every text twice: texts without any give no lines (_lines).
    """
    flags = [may_match(F.col("text"), label, alternatives, clean) for label, _, alternatives in heuristics]
    if asked:
        flags = [F.array_contains(asked, label) & flag for (label, _, _), flag in zip(heuristics, flags, strict=True)]
    return files.where(F.col("text").isNotNull()).withColumn("may match", F.array(*flags))


def _lines() -> Column:
    """The lines of a candidate's text; none of a text that no label may match."""
    return F.when(F.array_contains("may match", True), F.split("text", "\n"))


def scan_texts(files: DataFrame, heuristics: list[tuple[str, str, list[str]]], clean: bool = False, asked: str | None = None) -> DataFrame:
    """files' other columns with line_no, line, label, type: one row for each label and matching line of files (text). asked: an array column of the labels to be tried in a file; others are not.

    Only texts that have what a label's expressions ask for are cut into lines, and only those labels are tried on them.
    """
    others = [c for c in files.columns if c not in ("text", asked)]
    lines = _candidates(files, heuristics, clean, asked).select(*others, "may match", F.posexplode(_lines()).alias("at", "line"))
    tests = enumerate(_tests(heuristics, clean))
    found = F.array(*(F.when(F.get("may match", F.lit(i)) & F.col("line").rlike(regex), F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"))) for i, (label, kind, regex) in tests))
    hits = lines.withColumn("hit", F.explode(F.array_compact(found)))
    return hits.select(*others, (F.col("at") + 1).alias("line_no"), "line", "hit.label", "hit.type")


def scan_context(files: DataFrame, heuristics: list[tuple[str, str, list[str]]], k: int = 5, clean: bool = False) -> DataFrame:
    """path, label, block, line_no, is_hit, line for files (path, text): k lines on either side of hits; ranges that overlap or touch are one block.

    A file's lines are one array, from which each hit takes its neighbours, so only these are moved.
    """
    cut = _candidates(files, heuristics, clean, None).select("path", "may match", _lines().alias("lines"))
    tested = F.array_compact(F.array(*(F.when(F.get("may match", F.lit(i)), F.struct(F.lit(label).alias("label"), F.lit(regex).alias("pattern"))) for i, (label, _, regex) in enumerate(_tests(heuristics, clean)))))
    hits = F.filter(F.transform("lines", lambda x, i: F.when(F.regexp_like(x, F.col("t.pattern")), i + 1)), lambda i: i.isNotNull())
    found = cut.select("path", "lines", F.explode(tested).alias("t")).select("path", "lines", "t.label", hits.alias("hits")).where(F.size("hits") > 0)
    near = lambda at: F.transform(F.sequence(F.greatest(at - k, F.lit(1)), F.least(at + k, F.size("lines"))), lambda i: F.struct(i.alias("line_no"), (i == at).alias("is_hit"), F.element_at("lines", i).alias("line")))
    rows = found.select("path", "label", F.explode(F.flatten(F.transform("hits", near))).alias("n")).select("path", "label", "n.*")
    once = rows.groupBy("path", "label", "line_no").agg(F.bool_or("is_hit").alias("is_hit"), F.any_value("line").alias("line"))
    order = Window.partitionBy("path", "label").orderBy("line_no")
    begins = F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > 1, F.lit(True)).cast("int")
    return once.withColumn("begins", begins).withColumn("block", F.sum("begins").over(order)).select("path", "label", "block", "line_no", "is_hit", "line")


def scan_exists(scanned: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """scanned (key) with found: 1 if there is a hit, 0 if scanned without one."""
    seen = hits.select(*key).distinct().withColumn("one", F.lit(1))
    return scanned.join(seen, key, "left").withColumn("found", F.coalesce("one", F.lit(0))).drop("one")


def count_files(hits: DataFrame, project: str = "project") -> DataFrame:
    return hits.groupBy(project, "label").agg(F.countDistinct("path").alias("files"))


def rate_files(hits: DataFrame, files: DataFrame, project: str = "project") -> DataFrame:
    """Files with a hit in percent of all files of the project; 0 where it has none."""
    total = files.groupBy(project).agg(F.countDistinct("path").alias("all_files"))
    rate = F.when(F.coalesce("all_files", F.lit(0)) > 0, F.col("files") / F.col("all_files") * 100).otherwise(0.0)
    return count_files(hits, project).join(total, project, "left").select(project, "label", "files", rate.alias("rate"))


def bucket_of(path: Column, code: str, test: str, xml: str | None = None) -> Column:
    """test, code, xml or other, by a path's end and by the mark of test folders."""
    kind = F.when(path.endswith(code) & path.contains(test), "test").when(path.endswith(code), "code")
    return (kind.when(path.endswith(xml), "xml") if xml else kind).otherwise("other")


def code_test(hits: DataFrame, projects: DataFrame, n_labels: int, code: str, test: str, project: str = "project") -> DataFrame:
    """project, code, test, other: distinct files and labels by kind; none: labels without any match."""
    rows = hits.select(project, "label", "path").distinct().withColumn("kind", bucket_of(F.col("path"), code, test))
    counted = rows.groupBy(project).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("code", "test", "other")), F.countDistinct("label").alias("labels"))
    return projects.join(counted, project, "left").select(project, *(F.coalesce(k, F.lit(0)).alias(k) for k in ("code", "test", "other")), (n_labels - F.coalesce("labels", F.lit(0))).alias("none"))


FAN_IN_KINDS = ("test", "code", "xml", "other")


def is_dependency(label: Column, project: Column) -> Column:
    """Labels of a project's own files are named owner.name.something: whether a label begins with its project's name, with dots for slashes."""
    return F.startswith(label, F.replace(project, F.lit("/"), F.lit(".")))


def usage_fan_in(hits: DataFrame, files: DataFrame, code: str, test: str, xml: str, project: str = "project") -> DataFrame:
    """Files with a match of each label, by kind (code, test, xml, other), for labels that are database code and for dependencies (is_dependency); a file counts for each label.

    total_db is their number, total_project that of all files; the percentages, of all files of the project, leave "other" out. Zeros are nulls.
    """
    rows = hits.select(project, "label", "path").distinct().withColumn("kind", bucket_of(F.col("path"), code, test, xml))
    depends = is_dependency(F.col("label"), F.col(project))
    sides = (("db", ~depends), ("dep", depends))
    counted = rows.groupBy(project).agg(*(F.count_if((F.col("kind") == k) & side).alias(f"{name}_{k}") for name, side in sides for k in FAN_IN_KINDS), F.count("*").alias("total_db"))
    total = files.groupBy(project).agg(F.countDistinct("path").alias("total_project"))
    joined = total.join(counted, project, "left")
    columns = [f"{name}_{k}" for name, _ in sides for k in FAN_IN_KINDS] + ["total_db"]
    known = lambda c: F.nullif(F.col(c), F.lit(0))
    shares = [(known(c) / F.col("total_project") * 100).alias(f"pct_{c}") for c in columns if not c.endswith("_other")]
    return joined.select(project, *(known(c).alias(c) for c in columns), known("total_project").alias("total_project"), *shares)


def build_file_hits(scanned: DataFrame, hits: DataFrame, name: str, key: list[str]) -> DataFrame:
    """status: 0 no match, -1 matches but none in a build file, else the number of build files; path: the build file's if there is one only."""
    build = F.col("path").endswith(name)
    counted = hits.groupBy(*key).agg(F.count_distinct(F.when(build, F.col("path"))).alias("n"), F.max(F.when(build, F.col("path"))).alias("path"))
    status = F.when(F.col("n").isNull(), 0).when(F.col("n") == 0, -1).otherwise(F.col("n"))
    return scanned.join(counted, key, "left").select(*key, status.cast("long").alias("status"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def pending(done: DataFrame, heuristics: DataFrame, versions: DataFrame) -> DataFrame:
    """Pairs of heuristic and version that have no execution yet: each version takes the heuristics, one row as an array, that are not among its own done ones."""
    asked = heuristics.select(F.struct(*heuristics.columns).alias("h")).distinct().agg(F.collect_list("h").alias("asked"))  # the pattern files of a scan
    had = done.groupBy(*versions.columns).agg(F.collect_set(F.struct(*heuristics.columns)).alias("had"))
    left = versions.join(had, versions.columns, "left").crossJoin(asked)  # one row
    missing = F.array_except("asked", F.coalesce("had", F.array().cast(left.schema["asked"].dataType)))
    return left.select(*versions.columns, F.explode(missing).alias("h")).select("h.*", *versions.columns)


def run_pending(done: DataFrame, heuristics: list[tuple[str, str, list[str]]], files: DataFrame, version: str, clean: bool = False) -> DataFrame:
    """version, label, hits, files of the executions that done (label, version) lacks over files (version, path, text): with 0 where a label has no hit.

    A version's files are tried with the labels that it lacks, and those of versions that lack none are not read further.
    """
    names = files.sparkSession.createDataFrame([(x[0],) for x in heuristics], "label string")
    left = pending(done.select("label", version), names, files.select(version).distinct())
    asked = left.groupBy(version).agg(F.collect_set("label").alias("labels asked"))  # the labels of a scan at most
    found = scan_texts(files.join(asked, version), heuristics, clean, "labels asked").groupBy(version, "label").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"))
    return left.join(found, [version, "label"], "left").select(version, "label", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("files", F.lit(0)).alias("files"))


def scan_status(run: DataFrame, done: DataFrame, n_labels: int, versions: DataFrame) -> DataFrame:
    """status, n: Success for executions that a run has added, Skipped for those that were there, Total for all pairs of label and version."""
    one = run.agg(F.count("*").alias("Success")).crossJoin(done.join(versions, versions.columns, "left_semi").select("label", *versions.columns).distinct().agg(F.count("*").alias("Skipped")))  # one row each
    one = one.crossJoin(versions.agg((F.count("*") * n_labels).alias("Total")))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("status"), F.col(x).alias("n")) for x in ("Success", "Skipped", "Total")))).alias("s")).select("s.*")


def scan_selected(files: DataFrame, heuristics: list[tuple[str, str, list[str]]], chosen: DataFrame, project: str = "project", clean: bool = False) -> DataFrame:
    """Hits of each project's own labels: chosen (project, label) says which labels are tried in which project."""
    asked = chosen.groupBy(project).agg(F.collect_set("label").alias("labels asked"))  # the labels of a scan at most
    return scan_texts(files.join(asked, project), heuristics, clean, "labels asked")


def invalidate(executions: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Executions that stay: those whose label's pattern is the same, and those validated and accepted."""
    changed = old.select("label", F.col("pattern").alias("was")).join(new.select("label", "pattern"), "label").where("was <> pattern").select("label")
    locked = F.coalesce(F.col("is_validated") & F.col("is_accepted"), F.lit(False))
    stale = executions.where(~locked).join(changed, "label", "left_semi").select("id")
    return executions.join(stale, "id", "left_anti")


def class_pattern(path: Column) -> Column:
    """The expression that finds uses of the class in a file: its stem between blanks, signs or ends."""
    stem = F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)
    return F.concat(F.lit(r"(\s|[.,(]|^)"), F.regexp_replace(stem, r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"(\s|[.,(]|$)"))


#: What sets words apart in class_pattern.
APART = r"[\s.,(]"


def scan_scoped(lines: DataFrame, stems: DataFrame, project: str = "project") -> DataFrame:
    """project, path, line_no, stem: lines of a project that have one of its own files' stems (project, stem), as class_pattern finds it; once each.

    A stem that has no sign or blank in it is found by class_pattern where it is a word between signs and blanks, so words and stems meet by (project, word), and a line's text is moved nowhere. A Bloom filter of the stems, of a
    size that is bounded, is tested before words are moved. Stems with signs or blanks in them meet the lines by their first word and are then matched. Stems are counted when this is called.
    """
    stems = stems.select(project, "stem").where(F.col("stem") != "").distinct()
    plain, odd = stems.where(~F.col("stem").rlike(APART)), stems.where(F.col("stem").rlike(APART))
    words = lines.select(project, "path", "line_no", F.explode(F.array_distinct(F.split("line", APART + "+"))).alias("stem"))
    near = that_may_meet(words, plain, [project, "stem"])
    found = near.join(plain, [project, "stem"]).select(project, "path", "line_no", "stem")  # no semi join, which the optimizer would do before the filter
    if odd.isEmpty():
        return found
    first = odd.select(project, F.split("stem", APART)[0].alias("word"), F.col("stem"), class_pattern(F.concat("stem", F.lit(".x"))).alias("pattern"))
    whole = lines.select(project, "path", "line_no", "line", F.explode(F.array_distinct(F.split("line", APART))).alias("word"))
    return found.unionByName(whole.join(first, [project, "word"]).where(F.expr("line rlike pattern")).select(project, "path", "line_no", "stem").distinct())


def first_level(hits: DataFrame, files: DataFrame, extension: str | None, duplicates: bool = False, project: str = "project") -> DataFrame:
    """project, label, path, pattern, status, lines: the files that labels match (hits: project, label, path), each with what becomes of it.

    status is "other extension" (none is given: no file's), "duplicated" for a file that a label before (by name) has already, unless duplicates are allowed, or "opened"; of opened files lines is the number of their lines (files: project, path, text).
    """
    rows = hits.select(project, "label", "path").distinct()
    fits = F.endswith(F.col("path"), F.lit(extension)) if extension else F.lit(True)
    first = rows.groupBy(project, "path").agg(F.min("label").alias("first label"))
    status = F.when(~fits, "other extension").when(F.lit(not duplicates) & (F.col("label") != F.col("first label")), "duplicated").otherwise("opened")
    named = rows.join(first, [project, "path"]).select(project, "label", "path", class_pattern(F.col("path")).alias("pattern"), status.alias("status"))
    counted = files.where("text is not null").select(project, "path", F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return named.join(counted, [project, "path"], "left").withColumn("lines", F.when(F.col("status") == "opened", F.col("lines")))


def first_level_files(rows: DataFrame, multiple: bool = False, duplicates: bool = False, project: str = "project") -> DataFrame:
    """file, line_no, pattern: the pattern files of opened rows (project, label, path, pattern, status), one for each project, or (multiple) one for each pattern, numbered.

    Patterns stand in order of label and path; unless duplicates are allowed, each stands once, where it comes first.
    """
    opened = rows.where("status = 'opened'").select(project, "label", "path", "pattern")
    if not duplicates:
        best = opened.groupBy(project, "pattern").agg(F.min(F.struct("label", "path")).alias("first"))
        opened = best.select(project, "first.label", "first.path", "pattern")
    placed = number_within(opened, [project], ["label", "path"], "nth", "patterns of project")
    base = F.replace(F.col(project), F.lit("/"), F.lit("."))
    name = F.concat(base, F.lit("."), F.col("nth").cast("string"), F.lit(".txt")) if multiple else F.concat(base, F.lit(".txt"))
    return placed.select(name.alias("file"), (F.lit(1).cast("long") if multiple else F.col("nth")).alias("line_no"), "pattern")


def first_level_status(rows: DataFrame, projects: DataFrame, labels: DataFrame, project: str = "project") -> DataFrame:
    """status, n: Total of matched files, of these Opened, Duplicated and Not of the extension, and None, the pairs of project and label without any."""
    of = lambda x: F.count_if(F.col("status") == x)
    counted = rows.agg(F.count("*").alias("Total"), of("opened").alias("Opened"), of("duplicated").alias("Duplicated"), of("other extension").alias("Not extension"), F.count_distinct(project, "label").alias("pairs"))
    pairs = projects.select(project).distinct().agg(F.count("*").alias("projects")).crossJoin(labels.select("label").distinct().agg(F.count("*").alias("labels")))  # one row each
    one = counted.crossJoin(pairs).withColumn("None", F.col("projects") * F.col("labels") - F.col("pairs"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("status"), F.col(x).alias("n")) for x in ("Total", "Opened", "Duplicated", "Not extension", "None")))).alias("s")).select("s.*")


def second_level(first: DataFrame, second: DataFrame, files: DataFrame, project: str = "project") -> DataFrame:
    """db_code: files of both levels; dependencies: of the second alone; each also in percent of all files."""
    key = [project, "path"]
    first, second = first.select(key).distinct(), second.select(key).distinct()
    marked = second.join(first.withColumn("known", F.lit(True)), key, "left").groupBy(project).agg(F.count_if("known").alias("db_code"), F.count_if(F.col("known").isNull()).alias("dependencies"))
    total = files.groupBy(project).agg(F.countDistinct("path").alias("n_files"))
    joined = total.join(marked, project, "left").na.fill(0, ["db_code", "dependencies"])
    return joined.select(project, "db_code", "dependencies", "n_files", *((F.col(c) * 100 / F.col("n_files")).alias(f"{c}_pct") for c in ("db_code", "dependencies")))


def build_tools(files: DataFrame, maven: str, gradle: str, project: str = "project") -> DataFrame:
    """Folders with a Maven file, and folders with a Gradle file but no Maven file. The two are expressions for file names."""
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    per = files.groupBy(project, folder.alias("folder")).agg(F.bool_or(name.rlike(maven)).alias("maven"), F.bool_or(name.rlike(gradle)).alias("gradle"))
    return per.groupBy(project).agg(F.count_if("maven").alias("maven"), F.count_if(F.col("gradle") & ~F.col("maven")).alias("gradle"))


def changes_only(executions: DataFrame, key: list[str], order: str) -> DataFrame:
    """Newest first, empty outputs and those that differ from the last non-empty one. A key with very many executions is several tasks' work."""
    carried = carry_last(executions, key, [F.desc(order)], F.nullif(F.col("output"), F.lit("")), "last", itself=False)
    return carried.where((F.col("output") == "") | F.col("last").isNull() | (F.col("output") != F.col("last"))).drop("last")


def merge_parts(executions: DataFrame, key: list[str], size: int = 50) -> DataFrame:
    """Outputs scanned in pieces of so many patterns, as one: a single piece is kept, a complete set is joined, others are dropped."""
    pieces = executions.groupBy(*key).agg(F.count("*").alias("n"), F.max("n_patterns").alias("patterns"), F.array_sort(F.collect_list(F.struct("id", "output"))).alias("parts"))
    complete = (F.col("n") == 1) | (F.col("n") == F.ceil(F.col("patterns") / size))
    return pieces.where(complete).select(*key, F.array_join(F.transform("parts", lambda x: x["output"]), "\n\n").alias("output"), F.col("n").alias("pieces"))


#: Presets of a scan: which versions, and labels of which type.
PRESETS = [("last", "last", "database"), ("implementation", "last", "implementation"), ("query", "last", "query"), ("historical", "historical", "database"), ("historical implementation", "historical", "implementation")]


def scan_plan(versions: DataFrame, labels: DataFrame, presets: list[tuple[str, str, str]] = PRESETS) -> DataFrame:
    """preset, version_id, label: what each preset has to scan. versions: version_id, is_last, part."""
    rows = versions.sparkSession.createDataFrame(presets, "preset string, mode string, type string")
    wanted = (F.col("mode") == "all") | ((F.col("mode") == "last") & F.col("is_last")) | ((F.col("mode") == "historical") & F.col("part").isNotNull())
    chosen = versions.crossJoin(F.broadcast(rows)).where(wanted)  # a handful of presets
    return chosen.join(labels, "type").select("preset", "version_id", "label")
