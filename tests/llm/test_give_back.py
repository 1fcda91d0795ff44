"""Python workers give back the memory that a task freed."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest

from barelake.llm import common, quality, similar

MB = 1 << 20
linux = pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / MB


@linux
def test_freed_memory_goes_back():
    kept = []

    def run(batches):
        for batch in batches:
            held = [np.ones(8000) for _ in range(4000)]  # 256 MB in pieces that malloc keeps
            kept.append(held[-1])  # above them all, so that the heap's end can't shrink
            del held
            during.append(resident())
            yield batch

    batch, during = pa.RecordBatch.from_pydict({"x": [1, 2]}), []
    before = resident()
    assert list(common.giving_back(run)([batch, batch])) == [batch, batch]
    assert during[-1] - before > 200 and resident() - before < 100


def test_the_stages_give_back(spark, monkeypatch):
    """Each function that the quality and near-duplicate stages give to mapInArrow."""
    marked, seen = [], []

    def giving_back(run):
        marked.append(run)
        return run

    monkeypatch.setattr(quality, "giving_back", giving_back)
    monkeypatch.setattr(similar, "giving_back", giving_back)
    given = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, *a, **b: (seen.append(run), given(self, run, *a, **b))[1])
    docs = spark.createDataFrame([(k, f"some words of document {k} and {k * 7} more", "en") for k in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, quality int")
    assert quality.filter_quality(docs, labels).count() >= 10
    similar._candidates(similar._classes(similar.fingerprints(docs)), 0.8, 0.995)
    own = [run for run in seen if "map_batches" not in run.__qualname__]
    assert len(own) >= 7 and all(run in marked for run in own)
