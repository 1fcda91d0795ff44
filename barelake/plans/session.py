"""An interactive session: named query tables over one lake, driven by commands."""

from __future__ import annotations

import time
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, dml, fill, search, transform_join
from ..operators.model import Lake, collect_rows, settled, width
from ..operators.related import extend_rows, related_table, related_tables
from ..sources import database, transformations
from ..sources.rows import parse_literal
from .language import CHANGES, Call, Command, CommandError, parse

HELP = """Tables:      R = ((key, value), …)   R = open("file"[, "y"])   S = R   R
Search:      R.related   R.related.2   keyword_search("words, more"[, n])[.i]   table_search(R, "x"|"n"|"u", "a-b"[, n])[.i]
Extension:   R.xr   R.xc   R.fill   and chains of these
Changes:     R.insert(…)  R.delete(…)  R.delrow(i[-j])  R.delcol(i[-j])  R.delcell(i, j)  R.updatecell(i, j, v)  R.swap(i, j)  R.sort(i[, true])
Joins:       joinable(A, "x-", B, "-x")[.export("file")]   join(A, "x-", B, "-x"[, "file"])
Database:    import("file")   export("file")   R.export("file")
Parameters:  params   set name value"""


@dataclass
class Parameters:
    """Thresholds and scoring; the bounds are checked when one is set."""

    related_threshold: float = 0.5
    grouping_threshold: float = 0.5
    overlap_threshold: float = 0.5
    editdist_threshold: float = 0.1
    ngram_size: int = 5
    b: float = 1.2
    k: float = 0.75
    group_scoring: str = "sum"
    xc_multiplier: float = 0.1
    xc_empty_threshold: float = 0.5
    fill_operation: str = "sum"
    fill_multiplier: float = 0.1
    num_results: int = 10
    num_tf_examples: int = 5
    verbose: str = "off"

    _CHOICES = {"group_scoring": ("sum", "product"), "fill_operation": ("sum", "product", "probabilistic"), "verbose": ("on", "off")}

    def set(self, name: str, value: str) -> None:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if name not in kinds:
            raise CommandError(f"no such parameter: {name}")
        if name in self._CHOICES:
            if value.lower() not in self._CHOICES[name]:
                raise CommandError(f"{name} is one of {', '.join(self._CHOICES[name])}")
            setattr(self, name, value.lower())
            return
        try:
            number = kinds[name](value)
        except ValueError:
            raise CommandError(f"{name} is a number") from None
        if kinds[name] is int and number < 1 or kinds[name] is float and (number < 0 or name not in ("b", "k") and number > 1):
            raise CommandError(f"{value} is out of bounds for {name}")
        setattr(self, name, number)


def shown(rows: DataFrame) -> str:
    """A query table as the session prints it."""
    listed = collect_rows(rows)
    return "\n".join([*map(str, listed), f"Number of rows: {len(listed)}", f"Number of cols: {width(rows)}"])


class Session:
    """Runs commands; each gives the text to print. ``tables`` holds the named query tables, ``result`` the last one."""

    def __init__(self, spark: SparkSession, lake: Lake | None = None) -> None:
        self.spark, self.lake, self.parameters = spark, lake, Parameters()
        self.tables: dict[str, DataFrame] = {}
        self.result: DataFrame | None = None
        self._searches: dict[tuple, list] = {}

    def run(self, line: str) -> str:
        began = time.time()
        out = self._run(parse(line))
        return f"{out}\nTime: {time.time() - began:.2f} s" if self.parameters.verbose == "on" else out

    def _lake(self) -> Lake:
        if self.lake is None:
            raise CommandError("no database is loaded")
        return self.lake

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise CommandError(f"no table is called {name}")
        return self.tables[name]

    def _run(self, c: Command) -> str:
        if c.literal is not None:
            return self._bind(c.target, database.query_table(self.spark, parse_literal(c.literal)))
        match c.source.name:
            case "help":
                return HELP
            case "quit" | "exit":
                raise EOFError
            case "params":
                return "\n".join(f"{f.name}: {getattr(self.parameters, f.name)}" for f in fields(self.parameters))
            case "set":
                if len(c.source.args) != 2:
                    return "set parameter value"
                self.parameters.set(*c.source.args)
                return f"{c.source.args[0]} set to {c.source.args[1]}"
            case "import":
                new = database.read_database(self.spark, c.source.args[0])
                self.lake = new if self.lake is None else self.lake.append(new)
                self._searches.clear()
                return f"{self.lake.stats['tables']} tables"
            case "export":
                database.export_database(self._lake(), c.source.args[0], single_file=True)
                return f"Exported to {c.source.args[0]}"
            case "keyword_search" | "table_search":
                return self._search(c)
            case "joinable":
                return self._joinable(c)
            case "join":
                return self._join(c)
            case "open":
                yes = len(c.source.args) > 1 and c.source.args[1].lower() == "y"
                return self._chain(c, database.read_query_table(self.spark, c.source.args[0], yes), None)
        return self._chain(c, self._table(c.source.args[0]), c.source.args[0])

    def _bind(self, name: str | None, rows: DataFrame) -> str:
        self.result = rows = settled(rows)
        if name:
            self.tables[name] = rows
        return shown(rows)

    def _chain(self, c: Command, rows: DataFrame, name: str | None) -> str:
        p, said = self.parameters, ""
        ops = list(c.operations)
        while ops:
            op = ops.pop(0)
            match op.name:
                case "related" if ops and ops[0].name.isdigit():
                    i = int(ops.pop(0).name)
                    found, score = related_table(rows, self._lake(), i, p.related_threshold, p.editdist_threshold)
                    said = f"Related table {i}\n{shown(found)}\nOverlap = {score:.3f}"
                    if not ops:
                        self.result = found
                        return said
                case "related":
                    found = related_tables(rows, self._lake(), p.related_threshold, p.editdist_threshold).select("rank", "table_id", "score").orderBy("rank").collect()
                    said = "\n".join([f"# of related tables: {len(found)}", *(f"{r['rank']}. table {r['table_id']} ({r['score']:.3f})" for r in found)])
                    if not ops:
                        return said
                case "xr":
                    rows = settled(extend_rows(rows, self._lake(), p.related_threshold, p.editdist_threshold))
                case "xc":
                    rows = columns.extend_columns(rows, self._lake(), p.related_threshold, p.editdist_threshold, p.grouping_threshold, p.group_scoring, p.xc_multiplier, p.xc_empty_threshold)
                case "fill":
                    rows = fill.fill(rows, self._lake(), p.related_threshold, p.editdist_threshold, p.fill_operation, p.fill_multiplier)
                case "export":
                    database.export_query_table(rows, op.args[0])
                    return f"Exported to {op.args[0]}"
                case "sort":
                    rows = dml.sort(rows, int(op.args[0]), len(op.args) > 1 and op.args[1].lower() == "true")
                    if name and not c.target:
                        return self._bind(name, rows)
                case x if x in CHANGES:
                    rows = self._change(rows, op)
                    if name and not c.target:
                        return self._bind(name, rows)
                case _:
                    raise CommandError(f"{op.name} has no place here")
        return self._bind(c.target, rows)

    def _change(self, rows: DataFrame, op: Call) -> DataFrame:
        a = op.args
        span = [int(x) for x in a[0].split("-")] if op.name in ("delrow", "delcol") else []
        match op.name:
            case "insert":
                return dml.insert(rows, list(a))
            case "delete":
                return dml.delete(rows, list(a))
            case "delrow":
                return dml.delete_rows(rows, *span)
            case "delcol":
                return dml.delete_columns(rows, *span)
            case "delcell":
                return dml.delete_cell(rows, int(a[0]), int(a[1]))
            case "updatecell":
                return dml.update_cell(rows, int(a[0]), int(a[1]), a[2])
        return dml.swap(rows, int(a[0]), int(a[1]))

    def _search(self, c: Command) -> str:
        """Runs a search, or takes it from those run before with the same parameters and database."""
        p, a = self.parameters, c.source.args
        key = (c.source, p.ngram_size, p.b, p.k, p.num_results, p.related_threshold, p.editdist_threshold, p.overlap_threshold)
        if c.source.name == "table_search":
            table = self._table(a[0])
            key = (*key, table)  # the frame itself: a table that was changed is another one
        if key not in self._searches:
            lake = self._lake()
            if c.source.name == "keyword_search":
                found = search.keyword_search(lake, a[0], int(a[1]) if len(a) > 1 else p.num_results, p.b, p.k)
            elif a[1] == "u":
                found = search.unionable_search(table, lake, a[2], p.related_threshold, p.editdist_threshold)
                if len(a) > 3:
                    found = found.where(F.col("rank") <= int(a[3]))
            else:
                found = search.column_search(table, lake, a[2], p.ngram_size if a[1] == "n" else None, int(a[3]) if len(a) > 3 else p.num_results, p.b, p.k)
            self._searches[key] = found.select("rank", "table_id", "score").orderBy("rank").collect()
        found = self._searches[key]
        if c.operations:
            i = int(c.operations[0].name)
            if not 1 <= i <= len(found):
                raise CommandError(f"results are numbered from 1 to {len(found)}")
            rows = self._lake().rows.where(F.col("table_id") == found[i - 1]["table_id"]).select("row_id", "cells")
            return self._bind(c.target, rows)
        return "\n".join([f"# of results: {len(found)}", *(f"{r['rank']}. table {r['table_id']} ({r['score']:.6f})" for r in found)])

    def _sections(self, args: tuple[str, ...]) -> tuple[dict, list[transformations.Section]]:
        a, ga, b, gb = args[:4]
        learned = transform_join.learn_columns(self._table(a), ga, self._table(b), gb)
        ga, gb = dml.column_groups(ga), dml.column_groups(gb)
        at = lambda g: "+".join(str(i + 1) for i in g)
        return learned, [transformations.Section(at(ga[m]), at(gb[m]), change, sum(s for _, s in ranked), ranked) for m, (ranked, change) in learned.items()]

    def _joinable(self, c: Command) -> str:
        _, sections = self._sections(c.source.args)
        text = "".join(map(transformations.format_section, sections))
        if c.operations and c.operations[0].name == "export":
            transformations.write_transformations(c.operations[0].args[0], sections)
        return text

    def _join(self, c: Command) -> str:
        a, ga, b, gb, *file = c.source.args
        learned = None
        if file:
            x, y = dml.column_groups(ga), dml.column_groups(gb)
            at = lambda g: "+".join(str(i + 1) for i in g)
            found = {m: transformations.read_transformations(file[0], at(x[m]), at(y[m])) for m in x}
            learned = {m: (s.ranked, s.swapped) for m, s in found.items()}
        return self._bind(c.target, transform_join.join(self._table(a), ga, self._table(b), gb, learned))


def main() -> None:  # pragma: no cover - the interactive loop
    import sys

    spark = SparkSession.builder.appName("bare tables").getOrCreate()
    session = Session(spark, database.read_database(spark, sys.argv[1]) if len(sys.argv) > 1 else None)
    while True:
        try:
            print(session.run(input("> ")))
        except EOFError:
            return
        except (CommandError, dml.TableError, IndexError, KeyError, ValueError) as e:
            print(f"Error: {e}")


if __name__ == "__main__":  # pragma: no cover
    main()
