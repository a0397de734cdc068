"""Filters, flags and changes of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from techtrail.operators.ordering import number_rows


def filter_corpus(df: DataFrame, least: dict[str, float], equals: dict[str, object]) -> DataFrame:
    """Rows with at least so much of each measure and given values; one conjunction, so it reaches the scan."""
    rules = [F.col(c) >= v for c, v in least.items()] + [F.col(c) == v for c, v in equals.items()]
    return df.where(reduce(lambda a, b: a & b, rules, F.lit(True)))


def drop_discarded(df: DataFrame, reason: str) -> DataFrame:
    return df.where(F.col(reason).isNull())


def blank_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Blank texts as nulls."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in columns or df.columns if kinds[c] == "string"})


def matches_any(column: Column, patterns: list[str]) -> Column:
    """Whether any expression matches from the start of the text."""
    return column.rlike("|".join(f"^(?:{p})" for p in patterns))


def filter_position(df: DataFrame, order: list[str], low: int, high: int) -> DataFrame:
    """Rows number low to high, from 1, in a total order."""
    return number_rows(df, order, "position").where(F.col("position").between(low - 1, high - 1)).drop("position")


def filter_group_size(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """Rows of groups with n members or more. Sizes are aggregated first, so a large group is not gathered."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("members")).where(F.col("members") >= n).drop("members")
    return df.join(sizes, key, "left_semi")


def contains_ci(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def flag_keywords(df: DataFrame, columns: list[str], words: list[str], flag: str) -> DataFrame:
    """Adds a flag: whether any word (an expression) is in any column, case ignored."""
    pattern = "(?i)" + "|".join(f"(?:{w})" for w in words)
    return df.withColumn(flag, reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns]))


def flag_regex(df: DataFrame, column: str, pattern: str, flag: str) -> DataFrame:
    """Sets a flag where the pattern matches; it stays set where it was."""
    known = F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False)
    return df.withColumn(flag, known | F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def flatten_first_leaf(df: DataFrame) -> DataFrame:
    """Each nested object as the value of its first leaf."""

    def leaf(column: Column, kind) -> Column:
        return leaf(column[kind.fields[0].name], kind.fields[0].dataType) if isinstance(kind, StructType) and kind.fields else column

    return df.select(*(leaf(F.col(f"`{x.name}`"), x.dataType).alias(x.name) for x in df.schema.fields))


def canonical(column: Column, names: dict[str, str]) -> Column:
    """Names replaced through a table; others stay."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[column], column)


def replace_all(column: Column, replacements: dict[str, str]) -> Column:
    """Replacements by expression, one after the other."""
    return reduce(lambda c, pair: F.regexp_replace(c, *pair), replacements.items(), column)


def label_columns(df: DataFrame, header: list[str]) -> list[str]:
    """Columns that are labels: all but the header's, whatever their place."""
    return [c for c in df.columns if c not in header]


def combine(df: DataFrame, parts: list[str], out: str) -> DataFrame:
    """One column with the sum of the parts, in their place."""
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])).drop(*[p for p in parts if p != out])


def and_labels(df: DataFrame, key: list[str], generic: str, specific: str, out: str) -> DataFrame:
    """Long form: rows of a label for the keys that have both the generic and the specific label, in place of the two."""
    both = df.where(F.col("label").isin(generic, specific)).groupBy(*key).agg(F.count_distinct("label").alias("n")).where("n = 2").select(*key, F.lit(out).alias("label"))
    return df.where(~F.col("label").isin(generic, specific)).select(*key, "label").unionByName(both)


def binarise(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: (F.coalesce(c, F.lit(0)) > 0).cast("int") for c in columns})


def zero_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns})


def drop_unlabelled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide rows with some label."""
    return df.where(F.greatest(*(F.coalesce(c, F.lit(0)) for c in columns), F.lit(0)) > 0)


def pivot_labels(df: DataFrame, header: list[str], labels: list[str], value: Column, empty: object = 0) -> DataFrame:
    """Long to wide, with a column for each of the given labels."""
    wide = df.groupBy(*header).pivot("label", labels).agg(value)
    return wide.select(*header, *(F.coalesce(F.col(f"`{x}`"), F.lit(empty)).alias(x) for x in labels))


def unpivot_labels(df: DataFrame, header: list[str], labels: list[str]) -> DataFrame:
    return df.unpivot(header, labels, "label", "value")


def transpose(df: DataFrame, key: str, labels: list[str], keys: list) -> DataFrame:
    """Rows become columns: a row for each label, a column for each of the given keys."""
    long = unpivot_labels(df, [key], labels)
    return long.groupBy("label").pivot(key, keys).agg(F.max("value"))


def path_parts(path: Column, level: int = 5) -> dict[str, Column]:
    """project: the path's element at a level (from 1; null if there are fewer), extension, is_test."""
    return {
        "project": F.get(F.split(path, "/"), F.lit(level - 1)),
        "extension": F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit("")),
        "is_test": F.contains(path, F.lit("src/test")),
    }


def needs_refresh(df: DataFrame, reason: str, metric: str, owner: str, name: str) -> DataFrame:
    """repository: owner/name of rows that are not discarded and have no metric."""
    return df.where(F.col(reason).isNull() & F.col(metric).isNull()).select(F.concat_ws("/", owner, name).alias("repository"))


def bibtex(kind: Column, key: Column, authors: Column, title: Column, year: Column, url: Column) -> Column:
    """A bibliography record; the title's last full stop goes."""
    return F.format_string("@%s{%s,\n  author = {%s},\n  title = {%s},\n  year = {%s},\n  url = {%s}\n}", kind, key, authors, F.regexp_replace(title, r"\.$", ""), year, url)
