"""Month arithmetic on loosely written dates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import text as tx

OPEN_ENDS = ("", "present", "current", "now", "ongoing")
MON = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
# Fixed patterns: "Mon YYYY – Mon YYYY", "MM/YYYY to present"; education lines are left out.
RANGE = (
    rf"(?i)(?:(?:({MON})[a-z]*\.?\s+)?((?:19|20)\d{{2}})|(0?[1-9]|1[0-2])/((?:19|20)\d{{2}}))"
    r"\s*(?:-|–|—|to|until|through)\s*"
    rf"(present|current|now|(?:({MON})[a-z]*\.?\s+)?((?:19|20)\d{{2}})|(0?[1-9]|1[0-2])/((?:19|20)\d{{2}}))")
EDUCATION_LINE = (r"(?i)\b(?:university|college|institute|school|b\.?tech|bachelor|master|mba|ph\.?d|b\.?sc|m\.?sc"
                  r"|b\.?b\.?a|degree|gpa|cgpa)\b")


def month_number(name: Column) -> Column:
    return tx.lookup(V.MONTHS, F.lower(F.left(name, F.lit(3))))


def month_index(year: Column, month: Column) -> Column:
    """Months counted from year 0, January = 1."""
    return year * 12 + month


def parse_month(value: Column) -> Column:
    """Month index of 'YYYY-MM', 'YYYY/MM', 'Mon YYYY' or 'YYYY'; null for open or unreadable values."""
    s = F.lower(tx.strip(F.coalesce(value, F.lit(""))))
    number = lambda p, g: tx.first_match(s, p, g).cast("int")
    iso, named, year = r"^((?:19|20)\d{2})[-/](\d{1,2})$", r"^([a-z]{3,9})\.?\s+((?:19|20)\d{2})$", r"^((?:19|20)\d{2})$"
    return F.coalesce(
        month_index(number(iso, 1), F.greatest(F.lit(1), F.least(F.lit(12), number(iso, 2)))),
        month_index(number(named, 2), month_number(tx.first_match(s, named, 1))),
        month_index(number(year, 1), F.lit(1)))


def is_open(end: Column) -> Column:
    return F.lower(tx.strip(F.coalesce(end, F.lit("")))).isin(*OPEN_ENDS)


def year_of(index: Column) -> Column:
    return F.floor((index - 1) / 12).cast("int")


def month_of(index: Column) -> Column:
    return ((index - 1) % 12 + 1).cast("int")


def date_ranges(text: Column) -> Column:
    """array<struct<start_month, end_month>> of a document, null end for an open range.

    Few lines hold a year: the others are left before a pattern is tried.  A range is found once, its parts within it.
    """
    year = lambda ln: F.contains(ln, F.lit("19")) | F.contains(ln, F.lit("20"))
    lines = F.filter(tx.line_array(text), lambda ln: year(ln) & tx.matches(ln, RANGE) & ~tx.matches(ln, EDUCATION_LINE))

    def side(mon: Column, year: Column, mm: Column, year2: Column) -> Column:
        numeric = lambda c: F.nullif(c, F.lit("")).cast("int")
        return F.coalesce(month_index(numeric(year), F.coalesce(month_number(F.nullif(mon, F.lit(""))), F.lit(1))),
                          month_index(numeric(year2), numeric(mm)))

    def read(found: Column) -> Column:
        parts = F.struct(*[F.regexp_extract(found, RANGE, i).alias(f"g{i}") for i in range(1, 10)])
        return ar.let(parts, lambda m: F.struct(
            side(m["g1"], m["g2"], m["g3"], m["g4"]).alias("start_month"),
            F.when(~F.lower(m["g5"]).isin("present", "current", "now"), side(m["g6"], m["g7"], m["g8"], m["g9"])).alias("end_month")))

    return F.flatten(F.transform(lines, lambda ln: F.transform(tx.find_all(ln, RANGE), read)))
