"""Functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def count_of(text: Column, part: str) -> Column:
    """How often part occurs, without overlaps."""
    return F.size(F.split(text, rf"\Q{part}\E")) - 1


def split_part(text: Column, separator: str, i: int) -> Column:
    """The i-th part, from 0; null beyond the last."""
    return F.get(F.split(text, rf"\Q{separator}\E"), F.lit(i))


def year_from_july(ts: Column) -> Column:
    """The year, the next one from July on."""
    return F.year(ts) + (F.month(ts) >= 7).cast("int")


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def pct(part: Column, total: Column, digits: int = 1) -> Column:
    """Percentage as text; null where the total is zero."""
    return F.when(total != 0, F.format_string(f"%.{digits}f%%", F.round(part * 100.0 / total, digits)))


def json_get(text: Column, path: str, kind: str = "string", default: object = None) -> Column:
    """A value by path in a JSON text, cast, or a default."""
    return F.coalesce(F.get_json_object(text, path).cast(kind), F.lit(default).cast(kind))


def first_number(text: Column) -> Column:
    """The first word, between blanks, that is a number as a whole; 0 if none is."""
    number = F.get(F.filter(F.split(text, " "), lambda t: t.try_cast("double").isNotNull()), F.lit(0))
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def id_year(ident: Column) -> Column:
    """The second part of an identifier such as CVE-2019-1234."""
    return F.get(F.split(ident, "-"), F.lit(1)).try_cast("int")


def split_rows(text: Column, separator: str) -> Column:
    """Parts of a text as an array to explode; blank texts have none."""
    return F.filter(F.split(text, rf"\s*\Q{separator}\E\s*"), lambda x: x != "")
