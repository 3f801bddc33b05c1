"""Calendar quarters as one integer: qi = 4 * year + quarter - 1."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(date: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("long")


def quarter_label(qi: Column) -> Column:
    """2014Q3 and the like."""
    return F.format_string("%dQ%d", F.floor(qi / 4).cast("long"), (qi % 4 + 1).cast("long"))


def quarter_from_label(label: Column) -> Column:
    """The index of a label; null where it is none."""
    year, q = F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 1), F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 2)
    return year.try_cast("long") * 4 + q.try_cast("long") - 1


def quarter_start(qi: Column) -> Column:
    return F.make_date(F.floor(qi / 4).cast("int"), ((qi % 4) * 3 + 1).cast("int"), F.lit(1))


def quarter_end(qi: Column) -> Column:
    return F.last_day(F.add_months(quarter_start(qi), 2))
