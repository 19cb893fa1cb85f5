"""Tables on PDF pages (S14): ruled ones by the lines drawn, others by gaps that go down a block of rows.

A table is `headers` and `rows`, its `method` (`ruled` or `spaced`) and its `accuracy`, 0 to 1: of a ruled table the share of text whose width lies in one
cell; of a spaced one the mean share of a cell's text that lies in its column.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from statistics import median
from typing import NamedTuple, TypeVar

from rollbook.functions.headers import header_like

T = TypeVar("T")
#: Points by which lines may miss each other; widths of a letter that part cells; of a line's height, what parts rows' baselines and blocks of rows.
SNAP, CELL_GAP, ROW_GAP, BLOCK_GAP = 3.0, 0.6, 0.5, 3.0
#: A block of two columns whose cells have more words than this in the median is prose in columns.
PROSE_WORDS = 6


class Piece(NamedTuple):
    """Text on one baseline without a wide gap."""

    text: str
    x: float
    end: float
    y: float
    size: float


def clusters(items: Iterable[T], key: Callable[[T], float], gap: float | Callable[[T, T], float]) -> list[list[T]]:
    """The items in order of the key, parted where two neighbours are more than a gap apart."""
    out: list[list[T]] = []
    for item in sorted(items, key=key):
        if out and key(item) - key(out[-1][-1]) <= (gap(out[-1][-1], item) if callable(gap) else gap):
            out[-1].append(item)
        else:
            out.append([item])
    return out


def lines_of(runs: list) -> list[list[Piece]]:
    """The page's lines, from the top, each its pieces from the left."""
    out = []
    for row in reversed(clusters([r for r in runs if r.text.strip()], lambda r: r.y, lambda a, b: ROW_GAP * min(a.size, b.size))):
        pieces: list[Piece] = []
        for r in sorted(row, key=lambda r: r.x):
            last = pieces[-1] if pieces else None
            if last is not None and r.x - last.end <= CELL_GAP * max(last.size, r.size):
                gap = " " if (r.x - last.end > 0.15 * r.size or last.end - r.x > 0.5 * r.size) and not last.text.endswith(" ") else ""
                pieces[-1] = Piece(last.text + gap + r.text, last.x, max(last.end, r.end), last.y, last.size)
            else:
                pieces.append(Piece(r.text, r.x, r.end, r.y, r.size))
        out.append([p._replace(text=" ".join(p.text.split())) for p in pieces])
    return out


class Grid(NamedTuple):
    """A ruled table's borders: xs from the left, ys from the top."""

    xs: list[float]
    ys: list[float]

    def holds(self, x: float, y: float) -> bool:
        return self.xs[0] - SNAP <= x <= self.xs[-1] + SNAP and self.ys[-1] - SNAP <= y <= self.ys[0] + SNAP


def grids(rules: list) -> list[Grid]:
    """The grids that lines which touch each other make, of two rows and two columns at least, from the top of the page."""
    across = [r for r in rules if r.y1 - r.y0 < 1]
    down = [r for r in rules if r.x1 - r.x0 < 1]
    root = list(range(len(across) + len(down)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_x = sorted(range(len(down)), key=lambda j: down[j].x0)
    xs = [down[j].x0 for j in by_x]
    for i, a in enumerate(across):
        for j in by_x[bisect_left(xs, a.x0 - SNAP) : bisect_right(xs, a.x1 + SNAP)]:
            if down[j].y0 - SNAP <= a.y0 <= down[j].y1 + SNAP:
                root[find(i)] = find(len(across) + j)
    groups: dict[int, tuple[list[float], list[float]]] = {}
    for i, r in enumerate(across + down):
        groups.setdefault(find(i), ([], []))[0 if i >= len(across) else 1].append(r.x0 if i >= len(across) else r.y0)
    middle = lambda v: [sum(c) / len(c) for c in clusters(v, float, SNAP)]
    found = [Grid(middle(x), middle(y)[::-1]) for x, y in groups.values()]
    return sorted((g for g in found if len(g.xs) > 2 and len(g.ys) > 2), key=lambda g: -g.ys[0])


def _cell(at: float, borders: list[float]) -> int:
    """The place of a coordinate between borders that rise."""
    return max(0, min(len(borders) - 2, sum(at >= b for b in borders) - 1))


def _table(rows: list[list[str]], accuracy: float, method: str) -> dict | None:
    rows = [r for r in rows if any(r)]
    if not rows:
        return None
    headed = header_like(rows[0]) and len(rows) > 1
    headers = rows[0] if headed else [f"Column_{i + 1}" for i in range(len(rows[0]))]
    return {"headers": headers, "rows": rows[1:] if headed else rows, "accuracy": round(accuracy, 4), "method": method}


def ruled(grid: Grid, runs: list) -> dict | None:
    """The table in a grid: text goes where its middle is; lines of a cell are joined by a space."""
    cells: dict[tuple[int, int], list] = {}
    inside = 0
    falling = [-y for y in grid.ys]
    for r in runs:
        column, row = _cell((r.x + r.end) / 2, grid.xs), _cell(-(r.y + 0.3 * r.size), falling)
        cells.setdefault((row, column), []).append(r)
        inside += grid.xs[column] - SNAP <= r.x and r.end <= grid.xs[column + 1] + SNAP
    text = lambda k: " ".join(p.text for line in lines_of(cells.get(k, [])) for p in line)
    rows = [[text((i, j)) for j in range(len(grid.xs) - 1)] for i in range(len(grid.ys) - 1)]
    return _table(rows, inside / len(runs), "ruled") if runs else None


def columns_of(block: list[list[Piece]]) -> list[tuple[float, float]]:
    """The columns of a block of lines: where the gaps lie that go down it. Of many lines a tenth may cross a gap."""
    allowed = len(block) // 10
    edges = sorted([(p.x, 1) for line in block for p in line] + [(p.end, -1) for line in block for p in line], key=lambda e: (e[0], -e[1]))
    width = CELL_GAP * median(p.size for line in block for p in line)
    out: list[tuple[float, float]] = []
    depth, begin = 0, None
    for x, step in edges:
        if depth <= allowed < depth + step:
            if out and x - out[-1][1] < width:
                begin = out.pop()[0]
            else:
                begin = x
        elif depth + step <= allowed < depth:
            out.append((begin, x))
        depth += step
    return out


def spaced(block: list[list[Piece]]) -> dict | None:
    """The table that a block of lines makes, if it has columns and isn't prose in columns."""
    columns = columns_of(block)
    if len(columns) < 2:
        return None
    if len(columns) == 2 and median(len(p.text.split()) for line in block for p in line) > PROSE_WORDS:
        return None
    rows, shares = [], []
    for line in block:
        cells: list[list[str]] = [[] for _ in columns]
        for p in line:
            within = [max(0.0, min(p.end, b) - max(p.x, a)) for a, b in columns]
            best = max(range(len(columns)), key=lambda k: within[k])
            cells[best].append(p.text)
            shares.append(min(1.0, within[best] / max(p.end - p.x, 1e-6)))
        rows.append([" ".join(c) for c in cells])
    return _table(rows, sum(shares) / len(shares), "spaced")


def blocks_of(lines: list[list[Piece]]) -> list[list[list[Piece]]]:
    """Runs of two lines or more with several pieces each, without a wide space between."""
    out: list[list[list[Piece]]] = [[]]
    for line in lines:
        last = out[-1][-1] if out[-1] else None
        if len(line) < 2:
            out.append([])
        elif last is not None and last[0].y - line[0].y > BLOCK_GAP * max(last[0].size, line[0].size):
            out.append([line])
        else:
            out[-1].append(line)
    return [b for b in out if len(b) > 1]


def tables_of(layout) -> list[dict]:
    """The tables of a page: ruled ones from the top, then those among the rest of its text."""
    out, rest = [], list(layout.runs)
    for grid in grids(layout.rules):
        middle = lambda r: ((r.x + r.end) / 2, r.y + 0.3 * r.size)
        inside = [r for r in rest if grid.holds(*middle(r))]
        rest = [r for r in rest if not grid.holds(*middle(r))]
        out.append(ruled(grid, inside))
    return [t for t in [*out, *map(spaced, blocks_of(lines_of(rest)))] if t]
