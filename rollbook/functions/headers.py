"""Whether a row of cells is a heading (T1), for one row in plain Python; functions.text.looks_like_header is the same rule as a column."""

from __future__ import annotations

import re

from rollbook.functions.text import HEADER_WORDS


def header_like(row: list[str]) -> bool:
    """Whether more than half of the cells look like headings."""

    def cell(x: str) -> bool:
        low = x.lower()
        return bool(x.strip()) and (any(w in low for w in HEADER_WORDS) or (x.isupper() and len(x) > 2) or bool(re.search("[:#]", x)) or (len(x.split()) <= 3 and x.replace(" ", "").isalpha()))

    return sum(map(cell, row)) * 2 > len(row)
