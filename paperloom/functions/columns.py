"""Column functions with the document model's own semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import BLANKS

#: A number as text: blanks around it, a sign, digits with one point, an exponent.
NUMBER = r"^[ \t\n\r\u000b\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\u000b\f]*$"


def trimmed(c: Column) -> Column:
    """Without blanks at both ends, line ends and tabs included."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def number_or_null(c: Column) -> Column:
    """A decimal(20,4) where the whole text is a number; units, commas and per cent signs give null."""
    return F.when(is_number(c), trimmed(c).try_cast("double").cast("decimal(20,4)"))


def contains_ignoring_case(c: Column, q: str) -> Column:
    """Substring search in which no character of ``q`` is a wildcard."""
    return F.lower(c).contains(q.lower())


def natural_key(c: Column) -> Column:
    """Texts in the order of these keys are in natural order: runs of digits by value, whatever their number and length."""
    digits = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    part = lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))).otherwise(p)
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), 0), part)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null for a null or zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, u: s + u)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def strict_date(c: Column) -> Column:
    """A date from year-month-day text; days that a month doesn't have give null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(c, "yyyy-M-d"))
