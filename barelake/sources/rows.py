"""Reading the rows of bare tables from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell in quotes (up to a quote that ends it before a comma), or without; and its comma.
_CELL = r"""[ ]*(?:"(?:.*?)"|'(?:.*?)'|[^,]*?)[ ]*,"""


def parse_cells(line: Column) -> Column:
    """The cells of a line: separated by commas, in single or double quotes if they hold any; spaces around are dropped."""
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_CELL), 0)

    def plain(cell: Column) -> Column:
        x = F.trim(F.substring(cell, F.lit(1), F.length(cell) - 1))
        quoted = (F.length(x) >= 2) & (x.startswith('"') & x.endswith('"') | x.startswith("'") & x.endswith("'"))
        return F.when(quoted, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(F.btrim(x, F.lit(" \"'")))

    return F.transform(found, plain)


def format_cells(cells: Column) -> Column:
    """A line that parse_cells reads back: each cell in double quotes, or in single ones if it holds a double one."""
    quote = lambda c: F.when(F.contains(c, F.lit('"')), F.concat(F.lit("'"), c, F.lit("'"))).otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    return F.array_join(F.transform(cells, quote), ", ")


def parse_literal(text: str) -> list[tuple[str, ...]]:
    """The rows of a table literal: ``((a, b), (c, d))`` or a single row ``(a, b)``; cells may be quoted."""
    rows, cells, cell, quote, depth, was_quoted, in_row = [], [], [], "", 0, False, False

    def close() -> None:
        nonlocal cell, was_quoted
        word = "".join(cell)
        cells.append(word if was_quoted else word.strip())
        cell, was_quoted = [], False

    for c in text.strip():
        if quote:
            if c == quote:
                quote = ""
            else:
                cell.append(c)
        elif c in "\"'" and not "".join(cell).strip():
            quote, cell, was_quoted = c, [], True
        elif c == "(":
            depth, in_row = depth + 1, True
            cell, cells = [], []
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise ValueError("a parenthesis is closed twice")
            if in_row:
                close()
                rows.append(tuple(cells))
            in_row = False
        elif c == ",":
            if in_row:
                close()
        elif not was_quoted:
            cell.append(c)
    if depth or quote:
        raise ValueError("the literal isn't closed")
    if not rows or any(not r[0] for r in rows):
        raise ValueError("a row's key can't be empty")
    return rows
