"""Tables of HTML pages as rows, with row and column spans filled in."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


#: Footnote marks and what is no text.
SKIPPED = {"sup", "style", "script"}
#: Elements without an end of their own.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Cells(HTMLParser):
    """Collects (table, row, [(text, rowspan, colspan, header)]).

    ``inside`` has the elements around the place at hand, outermost first. An end closes all up to its own start, and a new row or cell what is open within its table.
    """

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.ids: list[str | None] = []
        self.open: list[int] = []
        self.inside: list[str] = []
        self.cell: list[str] | None = None
        self.spans = (1, 1, False)

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        if tag in ("tr", "td", "th") and "table" in self.inside:
            self._leave("table", itself=False)
        if tag not in VOID:
            self.inside.append(tag)
        if tag == "br":
            self.handle_data(" ")
        elif tag == "table":
            self._end()
            self.tables.append([])
            self.ids.append(a.get("id"))
            self.open.append(len(self.tables) - 1)
        elif tag == "tr" and self.open:
            self._end()
            self.tables[self.open[-1]].append([])
        elif tag in ("td", "th") and self.open:
            self._end()
            number = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1
            self.spans, self.cell = (number("rowspan"), number("colspan"), tag == "th"), []

    def handle_endtag(self, tag: str) -> None:
        self._leave(tag)
        if tag in ("td", "th", "tr", "table"):
            self._end()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None and SKIPPED.isdisjoint(self.inside):
            self.cell.append(data)

    def _leave(self, tag: str, itself: bool = True) -> None:
        if tag in self.inside:
            last = len(self.inside) - 1 - self.inside[::-1].index(tag)
            del self.inside[last + (not itself) :]

    def _end(self) -> None:
        if self.cell is not None and self.open:
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            rows[-1].append((" ".join("".join(self.cell).split()), *self.spans))
        self.cell = None


def parsed(html: str) -> _Cells:
    p = _Cells()
    p.feed(html or "")
    p._end()
    return p


def grids(html: str) -> list[list[list[str]]]:
    """Each table's rows of texts; a spanning cell's text stands in every place it covers (of the table's own rows)."""
    out = []
    for rows in parsed(html).tables:
        grid: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            c = 0
            for text, down, across, _ in row:
                while (r, c) in grid:
                    c += 1
                for i in range(min(down, len(rows) - r)):
                    for j in range(across):
                        grid[r + i, c + j] = text
                c += across
        width = 1 + max((c for _, c in grid), default=-1)
        out.append([[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))])
    return out


ROWS = "key long, table_no int, row_no int, cells array<string>"


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells) of every table of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t, r, cells) for k, h in zip(b[key], b[html], strict=True) for t, grid in enumerate(grids(h)) for r, cells in enumerate(grid)]
            yield pd.DataFrame(rows, columns=["key", "table_no", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, ROWS)


NAMED = "key long, table_id string, columns array<string>, row_no int, cells array<string>"


def named_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_id, columns, row_no, cells) of the body rows of every table with an id; columns: the texts of a column's header cells, joined, in lower case.

    The header is the rows at the top whose cells are all header cells.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b[key], b[html], strict=True):
                page = parsed(text)
                for name, rows, grid in zip(page.ids, page.tables, grids(text), strict=True):
                    top = next((r for r, row in enumerate(rows) if not row or not all(c[3] for c in row)), len(rows))
                    names = [" ".join(dict.fromkeys(x.lower() for x in col if x)) for col in zip(*grid[:top], strict=True)]
                    out += [(k, name, names, r - top, grid[r]) for r in range(top, len(rows)) if name]
            yield pd.DataFrame(out, columns=["key", "table_id", "columns", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, NAMED)
