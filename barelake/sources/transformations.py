"""Files of learned transformations, and reports about them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.learn import coverage
from ..operators.units import Transformation, parse

_LINE = "-" * 40


@dataclass
class Section:
    """Transformations of one column pair; ``swapped`` if they lead from target to source."""

    source: str
    target: str
    swapped: bool = False
    total: int = 0
    ranked: list[tuple[Transformation, int]] = field(default_factory=list)


def format_section(section: Section, pairs: list[tuple[str, str]] = (), examples: int = 5) -> str:
    """Header, total support, and for each transformation its support and some examples it covers."""
    a, b = f"SRC[{section.source}]", f"TGT[{section.target}]"
    lines = [f"# {b} --> {a}" if section.swapped else f"# {a} --> {b}", f"Total support: {section.total}", ""]
    for t, support in section.ranked:
        lines += [str(t), f"Support: {support}"]
        lines += [f"    {x!r} -> {y!r}" for x, y in [p for p in pairs if t.apply(p[0]) == p[1]][:examples]]
        lines.append("")
    return "\n".join([*lines, _LINE, ""])


def write_transformations(path: str, sections: list[Section], examples: dict[tuple[str, str], list[tuple[str, str]]] | None = None) -> None:
    Path(path).write_text("".join(format_section(s, (examples or {}).get((s.source, s.target), [])) for s in sections), encoding="utf-8")


def read_transformations(path: str, source: str, target: str) -> Section:
    """The first section of a file for the column pair, in either direction."""
    for s in parse_sections(Path(path).read_text(encoding="utf-8")):
        if (s.source, s.target) == (source, target):
            return s
    raise KeyError(f"no transformations between {source} and {target}")


def parse_sections(text: str) -> list[Section]:
    import re

    out: list[Section] = []
    waiting: Transformation | None = None
    for line in text.splitlines():
        if m := re.fullmatch(r"# (SRC|TGT)\[(.*)\] --> (?:SRC|TGT)\[(.*)\]", line):
            swapped = m[1] == "TGT"
            out.append(Section(m[3] if swapped else m[2], m[2] if swapped else m[3], swapped))
        elif not out or not line.strip() or line == _LINE or line.startswith("    "):
            continue
        elif m := re.fullmatch(r"Total support: (\d+)", line):
            out[-1].total = int(m[1])
        elif m := re.fullmatch(r"Support: (\d+)", line):
            if waiting is not None:
                out[-1].ranked.append((waiting, int(m[1])))
                waiting = None
        else:
            waiting = parse(line)
    return out


def ranked_from_report(text: str, total: int, min_support: float = 0.05) -> list[tuple[Transformation, int]]:
    """The transformations of a report whose support is at least a share of the pairs."""
    return [(t, s) for section in parse_sections(text) for t, s in section.ranked if total and s / total >= min_support]


def analyse(transformations: list[Transformation], pairs: DataFrame) -> DataFrame:
    """(rank, transformation, coverage, new, cumulative): what each adds to those before it, the largest addition first.

    A pair counts as new for the first transformation, by order, that covers it.
    """
    from pyspark.sql import Window

    x = F.col("inp")
    hits = pairs.select("inp", "out", F.posexplode(F.array(*[t.column(x) == F.col("out") for t in transformations])).alias("at", "yes")).where("yes")
    firsts = hits.groupBy("inp", "out").agg(F.min("at").alias("at")).groupBy("at").agg(F.count("*").alias("new"))
    sizes = hits.groupBy("at").agg(F.count("*").alias("coverage"))
    names = F.array(*[F.lit(str(t)) for t in transformations])
    order = Window.orderBy(F.desc("new"), "at")
    joined = sizes.join(firsts, "at", "left").select("at", "coverage", F.coalesce("new", F.lit(0)).alias("new"))
    return joined.select(F.row_number().over(order).cast("long").alias("rank"), F.element_at(names, F.col("at") + 1).alias("transformation"), "coverage", "new", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def report_line(name: str, ranked: list[tuple[Transformation, int]], pairs: list[tuple[str, str]], seconds: float) -> dict:
    """The figures of one column pair for a batch report."""
    sets = coverage([t for t, _ in ranked], pairs)
    covered = 0
    for s in sets:
        covered |= s
    n = max(1, len(pairs))
    return {"table": name, "pairs": len(pairs), "covered": covered.bit_count(), "transformations": len(ranked), "best_support": max((s for _, s in ranked), default=0), "mean_input": sum(len(x) for x, _ in pairs) / n, "mean_output": sum(len(y) for _, y in pairs) / n, "runtime": seconds}


def write_report(rows: DataFrame, path: str) -> None:
    """A batch report as CSV, appended to what is there."""
    rows.write.mode("append").option("header", True).csv(path)
