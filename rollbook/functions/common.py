"""Small column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: ASCII white space, as a regular expression's \\s.
SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Whether one of the words is a part of c."""
    return c.rlike("|".join(words))


def when_first(*cases: tuple[Column, float | str], other: float | str | None = None) -> Column:
    """The value of the first case that holds."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for test, value in cases[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(other))


def messages(*texts: Column) -> Column:
    """An array of the texts that aren't null."""
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def fixed(c: Column | str, digits: int) -> Column:
    """Text of a double with so many digits after the point, rounded by its exact value, halves to even, as C's and Python's formats do.

    format_string rounds the shortest decimal that means the double, halves up: it makes 0.63 of 0.625.
    """
    return F.call_function("format_number", F.col(c) if isinstance(c, str) else c, F.lit("0." + "0" * digits))


#: A date's parts: a year of four digits first, or a day or month first and a year of four or two digits last.
DATE = r"^(\d{4}([/-])\d{1,2}\2\d{1,2}|\d{1,2}([/-])\d{1,2}\3(\d{4}|\d{2}))$"


def date_parts(s: Column) -> Column:
    """The three parts of a stripped date of one of the formats below, and its separator; null for other text."""
    return F.when(s.rlike(DATE), F.concat(F.split(s, "[/-]"), F.array(F.when(s.contains("/"), "/").otherwise("-"))))


def date_of_parts(p: Column) -> Column:
    """The date of parts: Y-m-d, d/m/Y, d-m-Y, d/m/y, d-m-y, Y/m/d, and m/d/Y where d/m/Y is none."""

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, m, d).try_cast("date")

    a, b, c = p[0], p[1], p[2]
    year = F.when(F.length(c) == 4, c).otherwise(F.concat(F.when(c.try_cast("int") < 69, "20").otherwise("19"), c))
    american = F.when((p[3] == "/") & (F.length(c) == 4), made(c, a, b))
    return F.when(F.length(a) == 4, made(a, b, c)).otherwise(F.coalesce(made(year, b, a), american))


def parse_date(c: Column) -> Column:
    return date_of_parts(date_parts(strip(c)))


def weighted_mean(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the scores that aren't null, by weight; 0 if there is none."""
    total = sum((F.coalesce(s, F.lit(0.0)) * weights[f] for f, s in scores.items()), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), weights[f]).otherwise(0.0) for f, s in scores.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))
