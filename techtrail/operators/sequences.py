"""Transitions of labels between the slices of a project, and sequences of itemsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from techtrail.operators.ordering import number_rows


def transitions(hist: DataFrame, project: str = "user_id") -> DataFrame:
    """project, part, label, n_parts, op for presence rows (project, part, label).

    INIT: present in the first slice; IN: present, absent in the slice before; KEEP: present in both; OUT: absent, present in the
    slice before. Parts count 1, 2, ... without gaps up to the project's last. Each presence row counts for its own slice and for the one after it, where it was there before; both meet by
    project, slice and label alone, so neither a grid of slices and labels nor a window over a project is made.
    """
    last = hist.groupBy(project).agg(F.max("part").alias("n_parts"))
    marks = F.array(F.struct(F.col("part"), F.lit(True).alias("now"), F.lit(False).alias("before")), F.struct((F.col("part") + 1).alias("part"), F.lit(False).alias("now"), F.lit(True).alias("before")))
    rows = hist.select(project, "label", F.explode(marks).alias("m")).select(project, "label", "m.*")
    seen = rows.groupBy(project, "part", "label").agg(F.bool_or("now").alias("now"), F.bool_or("before").alias("before"))
    op = F.when(F.col("now") & F.col("before"), "KEEP").when(~F.col("now"), "OUT").when(F.col("part") == 1, "INIT").otherwise("IN")
    return seen.join(last, project).where("part <= n_parts").select(project, "part", "label", "n_parts", op.alias("op"))


def itemsets(hist: DataFrame, project: str, item: Column | str = "label") -> DataFrame:
    """project, sequence: for each slice 1..n the sorted array of its items; slices without items are empty arrays."""
    last = hist.groupBy(project).agg(F.max("part").cast("int").alias("n_parts"))
    item = F.col(item) if isinstance(item, str) else item
    per_slice = hist.groupBy(project, "part").agg(F.sort_array(F.collect_set(item)).alias("items"))
    by_part = per_slice.groupBy(project).agg(F.map_from_entries(F.collect_list(F.struct(F.col("part").cast("int"), "items"))).alias("at"))
    filled = F.transform(F.sequence(F.lit(1), F.col("n_parts")), lambda k: F.coalesce(F.col("at")[k], F.array().cast("array<string>")))
    return by_part.join(last, project).select(project, filled.alias("sequence"))


def named_sequences(hist: DataFrame, project: str = "user_id") -> DataFrame:
    """Presence alone."""
    return itemsets(hist, project)


def tagged_sequences(trans: DataFrame, project: str = "user_id") -> DataFrame:
    """Items INITx, INx, OUTx, and x itself wherever it is present."""
    tagged = F.array_compact(F.array(F.when(F.col("op") != "KEEP", F.concat("op", "label")), F.when(F.col("op") != "OUT", F.col("label"))))
    return itemsets(trans.select(project, "part", F.explode(tagged).alias("label")), project)


def sequence_text(sequences: DataFrame, project: str = "user_id") -> DataFrame:
    """project, text: items and -1 for each itemset, -2 at the end."""
    parts = F.transform("sequence", lambda s: F.array_join(F.concat(s, F.array(F.lit("-1"))), " "))
    return sequences.select(project, F.concat(F.array_join(parts, " "), F.lit(" -2")).alias("text"))


def item_dictionary(labels: DataFrame) -> DataFrame:
    """code, item for each of the four forms of a label; codes are 10000, 1000, 1 and 100 times the label's number."""
    named = labels.select("label").distinct().withColumn("number", F.row_number().over(Window.orderBy("label")))  # one row for each name
    forms = F.array(*(F.struct((F.col("number") * f).alias("code"), F.concat(F.lit(tag), F.col("label")).alias("item")) for tag, f in (("INIT", 10000), ("IN", 1000), ("", 1), ("OUT", 100))))
    return named.select("label", F.explode(forms).alias("f")).select("label", "f.code", "f.item")


def sequence_index(projects: DataFrame, order: list[str]) -> DataFrame:
    """Adds line: 0, 1, ... in the given order of the projects (one row each)."""
    return number_rows(projects, order, "line")


def decode_lines(patterns: DataFrame, index: DataFrame, project: str) -> DataFrame:
    """pattern, projects: names, sorted and joined, of the array of line numbers in lines."""
    rows = patterns.select("pattern", F.explode("lines").alias("line")).join(index.select("line", project), "line")
    return rows.groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_list(F.col(project).cast("string"))), ",").alias("projects"))
