"""Operations on query tables, sources and sinks, the command language, cleaning and streaming."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from barelake.operators import cleaning, dml, matching, metrics, search, transform_join
from barelake.operators.model import Lake, collect_rows, lake_from_lines, query_table, width
from barelake.operators.units import parse
from barelake.plans.language import CommandError
from barelake.plans.language import parse as parse_command
from barelake.plans.session import Session
from barelake.sources import corpora, database, transformations
from barelake.streaming.ingest import ingest, stored_lake

ROWS = [("b", "2", "x"), ("a", "", "y"), ("c", "2")]


@pytest.fixture
def rows(spark):
    return query_table(spark, ROWS)


def test_insert_and_delete(rows):
    assert collect_rows(dml.insert(rows, ["d", "4"]))[-1] == ("d", "4")
    twice = dml.insert(rows, ["b", "2", "x"])
    assert collect_rows(dml.delete(twice, ["b", "2", "x"])) == [("a", "", "y"), ("c", "2"), ("b", "2", "x")]
    for bad in (lambda: dml.insert(rows, ["d", "1", "2", "3"]), lambda: dml.insert(rows, [""]), lambda: dml.delete(rows, ["z"])):
        with pytest.raises(dml.TableError):
            bad()


def test_delete_rows_and_columns(rows):
    assert collect_rows(dml.delete_rows(rows, 1, 2)) == [("c", "2")]
    assert collect_rows(dml.delete_columns(rows, 2, 3)) == [("b",), ("a",), ("c",)]
    with pytest.raises(dml.TableError):
        dml.delete_columns(rows, 1)  # no other column is full
    full = query_table(rows.sparkSession, [("b", "", "x"), ("a", "1", "y")])
    assert collect_rows(dml.delete_columns(full, 1)) == [("x", ""), ("y", "1")]
    assert collect_rows(dml.delete_columns(query_table(rows.sparkSession, [("a",)]), 1)) == []
    with pytest.raises(dml.TableError):
        dml.delete_rows(rows, 3, 4)


def test_cells(rows):
    assert collect_rows(dml.update_cell(rows, 3, 3, "z"))[2] == ("c", "2", "z")
    assert collect_rows(dml.delete_cell(rows, 1, 2))[0] == ("b", "", "x")
    for bad in ((1, 1, "k"), (9, 2, "k"), (1, 9, "k")):
        with pytest.raises(dml.TableError):
            dml.update_cell(rows, *bad)


def test_swap_and_sort(rows):
    assert collect_rows(dml.swap(rows, 2, 3))[0] == ("b", "x", "2")
    assert dml.swap(rows, 2, 2) is rows
    with pytest.raises(dml.TableError):
        dml.swap(rows, 1, 2)
    assert [r[0] for r in collect_rows(dml.sort(rows, 1))] == ["a", "b", "c"]
    assert [r[0] for r in collect_rows(dml.sort(rows, 2, True))] == ["b", "c", "a"]
    assert width(rows) == 3


def test_concatenate(rows):
    assert collect_rows(dml.concatenate(rows, "a-a"))[0] == ("b╍x", "2")
    assert dml.column_groups("a-b-a") == {"a": [0, 4], "b": [2]}


FILE = '2 2.0 2.0\n\n"k1", "v, 1"\n\'k2\', \'v2\'\n\n"x", ""\n\n\n"y", "z"'


def test_database_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text(FILE)
    lake = database.read_database(spark, str(tmp_path / "a.txt"))
    got = {(r["table_id"], r["row_id"]): r["cells"] for r in lake.rows.collect()}
    assert got == {(0, 0): ["k1", "v, 1"], (0, 1): ["k2", "v2"], (1, 0): ["x", ""], (2, 0): ["y", "z"]}
    (tmp_path / "b.txt").write_text('header "is", "eaten"\n"q", "r"\n')
    more = database.import_database(lake, str(tmp_path / "b.txt"))
    assert {(r["table_id"], tuple(r["cells"])) for r in more.rows.where("table_id >= 3").collect()} == {(3, ("q", "r"))}


@pytest.mark.parametrize("single", [True, False])
def test_database_round_trip(spark, tmp_path, single):
    (tmp_path / "a.txt").write_text(FILE)
    lake = database.read_database(spark, str(tmp_path / "a.txt"))
    database.export_database(lake, str(tmp_path / "out"), single)
    again = database.read_database(spark, str(tmp_path / "out"))
    tables = lambda x: sorted(sorted((r["row_id"], *r["cells"]) for r in x.rows.where(F.col("table_id") == t).collect()) for t in range(3))
    assert tables(lake) == tables(again) and again.stats["tables"] == 3


def test_parquet_and_key_index(spark, tmp_path):
    lake = lake_from_lines(spark.createDataFrame([(1, "Ab\ncd"), (2, "ab")], "i long, t string"), "i", "t")
    database.save_lake(lake, str(tmp_path / "lake"))
    assert database.load_lake(spark, str(tmp_path / "lake")).cells.count() == 3
    database.save_key_index(lake, str(tmp_path / "index"), 4)
    assert sorted(r["table_id"] for r in database.lookup_keys(spark, str(tmp_path / "index"), ["AB"], 4).collect()) == [1, 2]


def test_query_table_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text('title,year\n"It, again",1990\nx,y\n')
    rows = database.read_query_table(spark, str(tmp_path / "t.csv"), header=True)
    assert collect_rows(rows) == [("It, again", "1990"), ("x", "y")]
    database.export_query_table(rows, str(tmp_path / "o"))
    assert collect_rows(database.read_query_table(spark, str(tmp_path / "o"))) == collect_rows(rows)


def test_transformation_files(tmp_path):
    t = parse("Literal('a+b\\'') + Split(' ', 0)")
    sections = [transformations.Section("1", "2", False, 3, [(t, 3)]), transformations.Section("2", "1", True, 2, [(parse("Substring(0, 1)"), 2)])]
    path = str(tmp_path / "tf.txt")
    transformations.write_transformations(path, sections, {("1", "2"): [("x y", "a+b'x"), ("no", "zz")]})
    got = transformations.read_transformations(path, "1", "2")
    assert got.ranked == [(t, 3)] and not got.swapped and got.total == 3
    assert transformations.read_transformations(path, "2", "1").swapped
    with pytest.raises(KeyError):
        transformations.read_transformations(path, "9", "9")
    text = (tmp_path / "tf.txt").read_text()
    assert "'x y' -> \"a+b'x\"" in text and "zz" not in text
    assert transformations.ranked_from_report(text, 100, 0.03) == [(t, 3)]


def test_corpora(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"relation": [["k", "l"], ["1", None]]}))
    lake = corpora.from_column_json(spark, str(tmp_path / "c.json"))
    assert sorted(map(tuple, lake.rows.select("row_id", "cells").collect())) == [(0, ["k", "1"]), (1, ["l", ""])]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write(json.dumps({"numDataRows": 1, "tableData": [[{"text": "a"}, {"text": "b"}]]}) + "\n")
    assert corpora.from_row_json(spark, str(tmp_path / "r.json.gz")).rows.first()["cells"] == ["a", "b"]
    for name in "xy":
        (tmp_path / "csv" / name).mkdir(parents=True)
        (tmp_path / "csv" / name / "right.csv").write_text('h1,h2\n"a, b",2\nlong,3,4\n')
    lake = corpora.from_csv_files(spark, str(tmp_path / "csv"), name="right.csv")
    assert lake.stats["tables"] == 2 and lake.rows.where("table_id = 0 AND row_id = 0").first()["cells"] == ["a, b", "2"]
    (tmp_path / "d.xml").write_text("<r><e><t>1</t><n>a</n></e><e><t>2</t><n>b</n></e><e><t>1</t></e></r>")
    lake = corpora.from_xml(spark, str(tmp_path / "d.xml"), "e", "t", ["n", "t"])
    assert sorted((r["table_id"], r["row_id"], r["cells"]) for r in lake.rows.collect()) == [(0, 0, ["a", "1"]), (0, 1, ["", "1"]), (1, 0, ["b", "2"])]
    wiki = "{| class=x\n|-\n! Name !! Age\n|-\n| [[Link|Ann]] || '''3'''<ref>r</ref>\n|}"
    lake = corpora.from_wiki_text(spark.createDataFrame([(1, wiki)], "page_id long, text string"))
    assert [r["cells"] for r in lake.rows.orderBy("row_id").collect()] == [["Name", "Age"], ["Ann", "3"]]
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td><b>1</b></td><td> 2\n3</td></tr></table>"
    lake = corpora.from_html(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [r["cells"] for r in lake.rows.orderBy("row_id").collect()] == [["A", "B"], ["1", "2 3"]]


def test_benchmark(spark, tmp_path):
    (tmp_path / "source.csv").write_text("Full Name,Age\nAnn Lee,3\nBob Ray,4\n")
    (tmp_path / "target.csv").write_text("User\nalee\nbray\n")
    (tmp_path / "rows.txt").write_text("full name:user\nsource\n")
    data = corpora.read_benchmark(spark, str(tmp_path))
    assert data["truth"] is None and corpora.basic_values(data) == (["ann lee", "bob ray"], ["alee", "bray"], None)
    (tmp_path / "ground truth.csv").write_text("source-full name,source-age,target-user\nann lee,3,alee\nbob ray,4,bray\n")
    assert corpora.basic_values(corpora.read_benchmark(spark, str(tmp_path)))[2] == [("ann lee", "alee"), ("bob ray", "bray")]
    assert collect_rows(corpora.split_column(query_table(spark, [("a-b-c",), ("d",)]), 0, "-", 2)) == [("a", "b-c"), ("d", "")]


def test_joins_through_transformations(spark):
    names = ["davood rafiei", "arash nobari", "mary smith", "lee wong"]
    a = query_table(spark, [(str(i), n) for i, n in enumerate(names)])
    b = query_table(spark, [(n[0] + "." + n.split()[1], str(i * 10)) for i, n in enumerate(names)])
    joined = collect_rows(transform_join.join(a, "-x", b, "x-", q_start=3, q_end=8))
    assert [(r[1], r[3]) for r in joined] == [(n, str(i * 10)) for i, n in enumerate(names)]
    assert all(r[4] != "None" for r in joined)
    same = collect_rows(transform_join.join(a, "-x", a, "-x"))
    assert [(r[0], r[2]) for r in same] == [(str(i), str(i)) for i in range(4)]
    two = collect_rows(transform_join.join(a, "xy", query_table(spark, [("0", "DAVOOD RAFIEI"), ("1", "x")]), "xy", {"x": ([], False), "y": ([], False)}))
    assert [r[:4] for r in two] == [("0", "davood rafiei", "0", "DAVOOD RAFIEI")]


def test_matching_against_brute_force(spark):
    src, tgt = ["alpha one", "beta two", "gamma xx", "q"], ["one-alpha", "two beta", "two gamma", "zz"]
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "id long, value string")
    got = sorted((r["src_id"], r["tgt_id"]) for r in matching.match_values(frame(src), frame(tgt)).collect())
    want = []
    for i, s in enumerate(src):
        grams = {(q, s[k : k + q]) for q in range(4, 20) for k in range(len(s) - q + 1)}
        rated = [(sum(g in x for x in src) * sum(g in x for x in tgt), q, g) for q, g in grams if any(g in x for x in tgt)]
        if rated:
            want += [(i, j) for j, t in enumerate(tgt) if min(rated)[2] in t]
    assert got == sorted(want) and got


def test_metrics(spark):
    f = spark.createDataFrame([("t", "a", "1"), ("t", "b", "9")], "tbl string, src string, tgt string")
    g = spark.createDataFrame([("t", "a", "1"), ("t", "b", "2"), ("t", "c", "3")], "tbl string, src string, tgt string")
    r = metrics.row_matching(f, g, g).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 2) and metrics.macro(metrics.row_matching(f, g, g)).first()["precision"] == pytest.approx(1 / 3)
    empty = metrics.join_quality(f.where("false"), g).first()
    assert empty["precision"] == 1 and empty["recall"] == 0 and empty["f1"] == 0
    assert len(metrics.sweep(lambda q: f, g, range(2, 4))) == 2


def test_search_quirks(spark):
    lake = lake_from_lines(spark.createDataFrame([(0, "red car car\nblue"), (1, "car"), (2, "red\ncar")], "i long, t string"), "i", "t")
    assert [r["table_id"] for r in search.keyword_search(lake, "red car").collect()] == [0]
    last = search.keyword_search(lake, "red car").first()["score"]
    cells = search.keyword_search(lake, "red car", cell_frequency=True).first()["score"]
    assert last > cells  # "car" is there twice, in one cell that holds both
    assert search.keyword_search(lake, "nothing").collect() == []


def test_cleaning(spark):
    table = [[str(i + 1), n, "", "...", "k", "w" * 50, f'"{v}"'] for i, (n, v) in enumerate([("ann lee", "x"), ("bob ray", "y"), ("cyd fox", "x"), ("None", "z"), ("dan orr", "x")])]
    bad = [["1", "2"], ["3", "4"], ["5", "6"], ["7", "8"]]
    cells = [(t, r, c, v) for t, rows in enumerate([table, bad]) for r, row in enumerate(rows) for c, v in enumerate(row)]
    lake, stats = cleaning.clean(Lake(spark.createDataFrame(cells, "table_id long, row_id int, col_id int, value string")))
    assert sorted((r["table_id"], *r["cells"]) for r in lake.rows.collect()) == [(0, "ann lee", "'x'"), (0, "bob ray", "'y'"), (0, "cyd fox", "'x'"), (0, "dan orr", "'x'")]
    assert [(r["step"], r["tables"], r["columns"], r["rows"]) for r in stats.collect()] == [("raw", 2, 9, 9), ("columns", 2, 5, 9), ("keys", 1, 2, 5), ("rows", 1, 2, 4), ("columns again", 1, 2, 4), ("small tables", 1, 2, 4)]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "table_id long, block string"
    for i, block in enumerate(['"a", "1"\n"b", "2"', '"c", "3"']):
        spark.createDataFrame([(i, block)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "lake"), str(tmp_path / "check")).awaitTermination(60)
    lake = stored_lake(spark, str(tmp_path / "lake"))
    assert sorted((r["table_id"], *r["cells"]) for r in lake.rows.collect()) == [(0, "a", "1"), (0, "b", "2"), (1, "c", "3")]
    assert spark.read.parquet(str(tmp_path / "lake" / "tables")).count() == 2


def test_language():
    c = parse_command('T = table_search(R, "n", "a-b--", 5).2')
    assert (c.target, c.source.name, c.source.args, c.operations[0].name) == ("T", "table_search", ("R", "n", "a-b--", "5"), "2")
    c = parse_command("S = R.XR.xc.Related")
    assert c.source.args == ("R",) and [o.name for o in c.operations] == ["xr", "xc", "related"]
    assert parse_command('R.insert("Doe, J (x)", \'2\')').operations[0].args == ("Doe, J (x)", "2")
    assert parse_command('joinable(A, "x-", B, "-x").export("My File.txt")').operations[0].args == ("My File.txt",)
    assert parse_command("set b 1.2").source.args == ("b", "1.2")
    assert parse_command("R = ((a, b), (c, d))").literal == "((a, b), (c, d))"
    for bad in ("", "R.frobnicate", "R.insert(a).xr", "foo(1)", "R = ((a)", "R..xr", "1abc", 'R.insert("a)'):
        with pytest.raises(CommandError):
            parse_command(bad)


def test_session(spark, tmp_path):
    s = Session(spark)
    with pytest.raises(CommandError):
        s.run("R.xr")
    s.run("R = ((b, 2), (a, 1))")
    assert "('a', '1')\n('b', '2')" in s.run("R.sort(1)") and s.run("R").startswith("('a', '1')")
    s.run("S = R")
    s.run("R.delrow(1)")
    assert s.run("S").endswith("Number of rows: 2\nNumber of cols: 2") and s.run("R").endswith("Number of rows: 1\nNumber of cols: 2")
    s.run("S.swap(1, 2)")
    s.run("S.updatecell(1, 2, new)")
    s.run("S.delcell(2, 2)")
    assert s.run("S").startswith("('1', 'new')\n('2', '')")
    (tmp_path / "Db.txt").write_text(FILE)
    assert s.run(f'import("{tmp_path}/Db.txt")') == "3 tables" and s.run(f'import("{tmp_path}/Db.txt")') == "6 tables"
    s.run("set num_results 1")
    assert s.run('keyword_search("v2")').startswith("# of results: 1")
    for bad in ("set related_threshold 3", "set nothing 1", "set verbose maybe", "set num_results 0", 'keyword_search("v2").7'):
        with pytest.raises(CommandError):
            s.run(bad)
    assert "related_threshold: 0.5" in s.run("params") and "keyword_search" in s.run("help")
    s.run("set verbose on")
    assert "Time:" in s.run("R")
    s.run("set verbose off")
    s.run("A = ((annabel leeson, 1), (bobby raymond, 2), (cydney foxworth, 3))")
    s.run("B = ((leeson annabel, x), (raymond bobby, y), (foxworth cydney, z))")
    path = f"{tmp_path}/tf.txt"
    assert "SRC[1]" in s.run(f'joinable(A, "a-", B, "a-").export("{path}")')
    out = s.run(f'J = join(A, "a-", B, "a-", "{path}")')
    assert out.endswith("Number of rows: 3\nNumber of cols: 5")
    s.run(f'J.export("{tmp_path}/j")')
    assert s.run(f'K = open("{tmp_path}/j")').endswith("Number of rows: 3\nNumber of cols: 5")
    s.run(f'export("{tmp_path}/db")')
    with pytest.raises(EOFError):
        s.run("quit")
