"""Sentences and tokens (X11), as column functions; the patterns mean the same to Java's, Python's and RE2-like engines where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import strip

#: Words after whose full stop no sentence ends.
ABBREVIATED = ("Mr", "Mrs", "Ms", "Dr", "St", "No", "Rd", "Ave", "Ref", "Ltd", "Co", "approx", "max", "min")
LETTER = "A-Za-zÀ-ÖØ-öø-ʯͰ-῿぀-퟿"
_BLANK = r"[ \t\x0b\f\r]"
_BEGINS = "[A-Z0-9\"'(\\[À-Þ]"
#: Between sentences: blanks after a closing mark, before what may begin one; or line feeds. In Java's and Python's syntax.
BREAK = "(?<=[.!?])" + "".join(rf"(?<!\b{w}\.)" for w in ABBREVIATED) + rf"{_BLANK}+(?={_BEGINS})|{_BLANK}*\n[ \t\x0b\f\r\n]*"
#: Words with inner apostrophes and hyphens, numbers with inner separators, single other characters. In any engine's syntax.
TOKEN = rf"[{LETTER}]+(?:['’-][{LETTER}]+)*|[0-9]+(?:[/.,:-][0-9]+)*|[^ \t\n\x0b\f\r{LETTER}0-9]"


def sentences(text: Column) -> Column:
    """The sentences of a text, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, BREAK), strip), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
