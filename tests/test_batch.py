"""Benchmark directories learned, joined and evaluated together."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from barelake.operators.learn import learn_local
from barelake.operators.model import numbered
from barelake.operators.units import UNITS, Transformation, parse, register
from barelake.plans import batch
from barelake.sources.transformations import Section, format_section

PEOPLE = ["annabel leeson", "bobby raymond", "cydney foxworth", "daniel orrson", "eleanor quist"]


@pytest.fixture
def folders(tmp_path):
    out = []
    for name, make in (("short", lambda a, b: f"{a[0]}.{b}"), ("turned", lambda a, b: f"{b}; {a}")):
        d = tmp_path / name
        d.mkdir()
        made = [make(*p.split()) for p in PEOPLE]
        (d / "source.csv").write_text("name\n" + "\n".join(PEOPLE) + "\n")
        (d / "target.csv").write_text("code\n" + "\n".join(made) + "\n")
        (d / "rows.txt").write_text("name:code\nsource\n")
        (d / "ground truth.csv").write_text("source-name,target-code\n" + "\n".join(f"{p},{m}" for p, m in zip(PEOPLE, made)) + "\n")
        out.append(str(d))
    return out


@pytest.mark.parametrize("golden", [True, False])
def test_run(spark, folders, tmp_path, golden):
    report = str(tmp_path / "report")
    got = {r["table"]: r for r in batch.run(spark, folders, report, golden=golden).collect()}
    assert set(got) == {"short", "turned"} and all(r["recall"] == 1 and r["precision"] == 1 and r["covered"] == 5 for r in got.values())
    assert batch.run(spark, folders, report).collect() == []
    assert spark.read.option("header", True).csv(report).count() == 2


def test_baseline_and_samples(spark, folders):
    got = batch.run(spark, folders[:1], method="baseline", golden=True).first()
    assert got["method"] == "baseline" and got["transformations"] >= 1
    assert batch.run(spark, folders[:1], golden=True, sample="20%").first()["pairs"] == 2


def test_from_report(spark, folders):
    pairs = [(p, f"{p[0]}.{p.split()[1]}") for p in PEOPLE]
    text = format_section(Section("name", "code", False, 5, learn_local(pairs)))
    assert batch.join_from_report(spark, folders[0], text)[3:] == (1.0, 1.0, 1.0)


def test_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id").repartition(7)
    got = numbered(df, ["v"]).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(1000)) and [r["v"] for r in got] == list(range(1000))
    assert numbered(df.where("false"), ["v"]).collect() == []


def test_own_unit():
    @dataclass(frozen=True, order=True)
    class Reverse:
        mark: str

        def apply(self, x):
            return x[::-1]

        def column(self, x):
            return F.reverse(x)

        def __str__(self):
            return f"Reverse({self.mark!r})"

        @staticmethod
        def extract(x, piece):
            return {(Reverse(""),)} if x[::-1] == piece.text else set()

    try:
        register(Reverse)
        assert parse("Reverse('')") == Transformation((Reverse(""),))
        assert [s for _, s in learn_local([("abba", "abba"), ("noon", "noon")], units=("Reverse",))] == [2]
    finally:
        UNITS.pop("Reverse")
    with pytest.raises(TypeError):
        register(str)
