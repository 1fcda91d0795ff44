"""The documented session over three small tables, step by step."""

import pytest

from barelake.operators.columns import consolidate, extend_columns, group_columns
from barelake.operators.fill import fill
from barelake.operators.model import Lake, collect_rows, query_table, settled
from barelake.operators.related import extend_rows, related_table, related_tables
from barelake.plans.session import Session
from barelake.sources.database import tables_from_blocks

TABLES = [
    '"Joe", "Male", "19", "UofA"\n"John", "", "21", "UofA"\n"Mary", "Female", "22", "UofA"\n"Jeff", "Male", "20", "UofA"\n"Sarah", "Female", "24", "UofA"',
    "'John', 'Male', '21', 'UofA'\n'Mary', '', '22', 'UofA'\n'Jim', 'Male', '22', 'UofA'\n'Jeff', '', '20', 'UofA'",
    '"John", "Male", "21", "UofA"\n"Jeff", "Male", "20", "UofA"\n"Sarah", "Female", "24", "UofA"\n"Alexander", "Male", "21", "UofA"\n"Rachel", "Female", "26", "UofC"\n"Vera", "Female", "40", "Concordia"\n"Joe", "Male", "19", "UofC"',
]


@pytest.fixture(scope="module")
def lake(spark):
    blocks = spark.createDataFrame(list(enumerate(TABLES)), "table_id long, block string")
    return Lake(tables_from_blocks(blocks).cells.cache())


@pytest.fixture(scope="module")
def query(spark):
    return query_table(spark, [("John", "21"), ("Mary", "22"), ("Jeff", "20")]).cache()


def test_parsed(lake):
    assert [(r["num_rows"], r["num_cols"]) for r in lake.tables.orderBy("table_id").collect()] == [(5, 4), (4, 4), (7, 4)]


def test_related(lake, query):
    found = related_tables(query, lake).orderBy("rank").collect()
    assert [(r["table_id"], round(r["score"], 3), r["mapping"]) for r in found] == [(0, 1.0, [0, 2]), (1, 1.0, [0, 2]), (2, 0.667, [0, 2])]
    rows, score = related_table(query, lake, 2)
    assert score == 1 and collect_rows(rows)[2] == ("Jim", "Male", "22", "UofA")
    with pytest.raises(IndexError):
        related_table(query, lake, 0)


def test_extend_rows(lake, query):
    assert [r[0] for r in collect_rows(extend_rows(query, lake, 0.9))] == ["John", "Mary", "Jeff", "Joe", "Sarah", "Jim"]
    assert [r[0] for r in collect_rows(extend_rows(query, lake, 0.5))] == ["John", "Jeff", "Mary", "Joe", "Sarah", "Jim", "Alexander", "Rachel", "Vera"]


def test_extend_columns(lake, query):
    assert collect_rows(extend_columns(query, lake)) == [("John", "21", "Male", "UofA"), ("Mary", "22", "Female", "UofA"), ("Jeff", "20", "Male", "UofA")]
    wide = collect_rows(extend_columns(settled(extend_rows(query, lake)), lake))
    assert wide[3] == ("Joe", "19", "Male", "UofC") and wide[5] == ("Jim", "22", "", "") and wide[8] == ("Vera", "40", "Female", "Concordia") and len(wide) == 9


def test_rules(spark):
    columns = spark.createDataFrame([(0, 1.0), (1, 0.75), (2, 0.75), (3, 0.5)], "col long, score double")
    values = [("23", "22", "20", "21"), ("22", "22", "", "21"), ("22", "22", "20", ""), ("23", "", "20", "")]
    entries = spark.createDataFrame([(c, i, v) for c, col in enumerate(values) for i, v in enumerate(col) if v], "col long, row_id long, value string")
    grouped = columns.selectExpr("col", "0L AS `group`")
    got = {r["row_id"]: (r["value"], round(r["score"], 6)) for r in consolidate(grouped, columns, entries, "product").collect()}
    assert got == {0: ("22", 0.005625), 1: ("22", 0.05625), 2: ("20", 0.0375), 3: ("21", 0.0075)}
    got = {r["row_id"]: (r["value"], r["score"]) for r in consolidate(grouped, columns, entries, "sum").collect()}
    assert got == {0: ("23", 1.5), 1: ("22", 2.5), 2: ("20", 2.25), 3: ("21", 1.75)}
    assert {r["group"] for r in group_columns(columns, entries, 0.5).collect()} == {0}


@pytest.mark.parametrize("rule", ["sum", "product", "probabilistic"])
def test_fill(spark, lake, rule):
    got = collect_rows(fill(query_table(spark, [("John", ""), ("Mary", "22"), ("Jeff", "20"), ("Nobody", "")]), lake, rule=rule))
    assert got == [("John", "21"), ("Mary", "22"), ("Jeff", "20"), ("Nobody", "")]


def test_session(spark, lake):
    s = Session(spark, lake)
    s.run("R = ((John, 21), (Mary, 22), (Jeff, 20))")
    assert s.run("R.related").startswith("# of related tables: 3")
    assert s.run("R.related.2").endswith("Overlap = 1.000")
    s.run("set related_threshold 0.9")
    assert s.run("R.XR").endswith("Number of rows: 6\nNumber of cols: 2")
    s.run("set related_threshold 0.5")
    assert "('Jim', '22', '', '')" in s.run("X = R.xr.xc")
    assert s.run("X").endswith("Number of rows: 9\nNumber of cols: 4")
    s.run("R.insert(Sarah, 24)")
    assert s.run("R").endswith("Number of rows: 4\nNumber of cols: 2")
    assert s.run('keyword_search("concordia")').startswith("# of results: 1\n1. table 2")
    assert s.run('table_search(R, "x", "a-", 2)').startswith("# of results: 2")
    assert s.run('table_search(R, "n", "a-")').startswith("# of results: 3")
    assert s.run('table_search(R, "u", "ab")').startswith("# of results: 3")
    assert "Vera" in s.run('keyword_search("concordia").1')
