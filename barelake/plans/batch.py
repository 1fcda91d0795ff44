"""Learning and joining over many benchmark directories, with reports.

All column pairs are learned in one job, each a group; evaluation is a few
small aggregations for each directory. Directories that a report names already
are left out, so a run can be taken up again.
"""

from __future__ import annotations

import time
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learn, matching, metrics, transform_join
from ..operators.units import LEARNED, Transformation, parse
from ..sources import corpora, transformations

REPORT = "table string, method string, pairs long, covered long, transformations long, best_support long, mean_input double, mean_output double, tp long, fp long, fn long, precision double, recall double, f1 double, runtime double"


def _values(data: dict, side: str) -> DataFrame:
    column = data["src_col"] if side == "source" else data["tgt_col"]
    return data[side].select(F.col("row_id").alias("id"), F.col(column).alias("value"))


def pairs_of(data: dict, golden: bool = False, q_start: int = matching.Q_START, q_end: int = matching.Q_END) -> tuple[DataFrame, bool]:
    """(inp, out) of a benchmark, from its ground truth or by shared q-grams, and whether they lead from target to source."""
    a, b = _values(data, "source"), _values(data, "target")
    if golden:
        change = matching.swapped(a, b)
        truth = data["truth"]
        return (truth.select(F.col("tgt").alias("inp"), F.col("src").alias("out")) if change else truth.select(F.col("src").alias("inp"), F.col("tgt").alias("out"))).distinct(), change
    found, change = matching.match_columns_values(a, b, q_start, q_end, fast=True)
    return found.select(F.col("src").alias("inp"), F.col("tgt").alias("out")), change


def finished(spark: SparkSession, report: str) -> set[str]:
    """The directories that a report names."""
    try:
        return {r["table"] for r in spark.read.option("header", True).csv(report).select("table").distinct().collect()}
    except Exception as e:  # there is no report yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return set()


def run(spark: SparkSession, folders: list[str], report: str | None = None, method: str = "transformations", golden: bool = False, sample: int | str | None = None, units=LEARNED, min_support: float = 0.05, **options) -> DataFrame:
    """One row of figures for each directory; appended to a CSV report if a path is given.

    method: ``transformations``, or ``baseline``, which learns from small subsets.
    """
    done = finished(spark, report) if report else set()
    todo = {PurePosixPath(f).name: f for f in folders if PurePosixPath(f).name not in done}
    loaded, frames = {}, []
    for name, folder in todo.items():
        data = corpora.read_benchmark(spark, folder)
        pairs, change = pairs_of(data, golden)
        pairs = matching.sample_pairs(pairs, sample) if sample is not None else pairs
        loaded[name] = data, pairs, change
        frames.append(pairs.select(F.lit(name).alias("grp"), "inp", "out"))
    if not frames:
        return spark.createDataFrame([], REPORT)
    began = time.time()
    ranked: dict[str, list[tuple[Transformation, int]]] = {n: [] for n in todo}
    if method == "baseline":
        for name, (_, pairs, _) in loaded.items():
            ranked[name] = [(parse(r["transformation"]), r["support"]) for r in metrics.baseline_ranked(pairs).collect()]
    else:
        for r in learn.learn(reduce(DataFrame.union, frames), units, **options).orderBy("grp", "rank").collect():
            ranked[r["grp"]].append((parse(r["transformation"]), r["support"]))
    seconds = (time.time() - began) / len(todo)
    rows = []
    for name, (data, pairs, change) in loaded.items():
        listed = [(r["inp"], r["out"]) for r in pairs.collect()]
        line = transformations.report_line(name, ranked[name], listed, seconds)
        quality = join_quality(data, [t for t, s in ranked[name] if s >= min_support * max(1, len(listed))], change)
        rows.append((name, method, line["pairs"], line["covered"], line["transformations"], line["best_support"], line["mean_input"], line["mean_output"], *quality, line["runtime"]))
    out = spark.createDataFrame(rows, REPORT)
    if report:
        transformations.write_report(out, report)
    return out


def join_quality(data: dict, ts: list[Transformation], change: bool) -> tuple:
    """(tp, fp, fn, precision, recall, f1) of the join of a benchmark's columns through transformations; nulls without a ground truth."""
    if data["truth"] is None:
        return (None,) * 6
    a, b = (_values(data, s).select("value") for s in (("target", "source") if change else ("source", "target")))
    joined = transform_join.set_join(a, b, ts)
    r = metrics.join_quality(joined, data["truth"].select("src", "tgt")).first()
    return tuple(r[c] for c in ("tp", "fp", "fn", "precision", "recall", "f1"))


def join_from_report(spark: SparkSession, folder: str, report_text: str, min_support: float = 0.05) -> tuple:
    """join_quality() of a benchmark through the transformations that a text report lists for it with enough support."""
    data = corpora.read_benchmark(spark, folder)
    sections = transformations.parse_sections(report_text)
    total = max((s.total for s in sections), default=0)
    ranked = transformations.ranked_from_report(report_text, total, min_support)
    return join_quality(data, [t for t, _ in ranked], any(s.swapped for s in sections))
