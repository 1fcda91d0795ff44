"""Related tables with long keys and values that only match approximately, against the definition."""

import itertools
import random
from collections import Counter

import pytest

from barelake.operators.model import Lake, collect_rows, query_table
from barelake.operators.related import extend_rows, key_pairs, related_tables
from test_expressions import near

NAMES = ["massachusetts institute", "university of alberta", "stanford university", "eth zurich", "university of toronto", "kings college london"]


def typo(rng, s):
    s = list(s)
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        s[rng.randrange(len(s))] = rng.choice("xyz")
    return "".join(s)


def tables(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        rows = []
        for k in rng.sample(range(len(NAMES)), rng.randint(2, 6)):
            city = typo(rng, f"the city number {k} of them")
            rows.append([typo(rng, NAMES[k]).title(), *rng.sample([city, str(k), rng.choice(["", "other"])], 3)])
        out.append(rows)
    return out


def definition(query, lake, t, least):
    """Score and mapping of each table that is related, by the definition."""
    out = {}
    for i, rows in enumerate(lake):
        votes = Counter()
        for q in query:
            for d in rows:
                if not near(q[0].lower(), d[0].lower(), t):
                    continue
                choices = [[j for j in range(1, len(d)) if v == "" or near(v.lower(), d[j].lower(), t)] for v in q[1:]]
                if all(choices):
                    votes.update((0, *m[::-1]) for m in itertools.product(*choices[::-1]))
                    break
        if votes and len(rows) >= least * len(query) and max(votes.values()) / len(query) >= least:
            best = max(votes.values())
            out[i] = (best / len(query), next(m for m, n in votes.items() if n == best))
    return out


@pytest.mark.parametrize("t,least", [(0.1, 0.5), (0.05, 0.3), (0.2, 0.6), (1.0, 0.5)])
def test_against_definition(spark, t, least):
    data = tables(int(t * 100))
    cells = [(i, r, c, v) for i, rows in enumerate(data) for r, row in enumerate(rows) for c, v in enumerate(row)]
    lake = Lake(spark.createDataFrame(cells, "table_id long, row_id int, col_id int, value string"))
    query = [(NAMES[k], f"the city number {k} of them", str(k) if k % 2 else "") for k in (0, 1, 3, 4)]
    got = related_tables(query_table(spark, query), lake, least, t).orderBy("rank").collect()
    want = definition(query, data, t, least)
    assert {r["table_id"]: (round(r["score"], 6), tuple(r["mapping"])) for r in got} == {i: (round(s, 6), m) for i, (s, m) in want.items()}
    assert want
    assert [r["table_id"] for r in got] == sorted(want, key=lambda i: (-want[i][0], i))


def test_key_pairs(spark):
    keys = ["", "a", "short", "eth zurich", "eth zurick", "x" * 40, "x" * 38 + "yy", "x" * 30, "z" * 500]
    rows = spark.createDataFrame([([k],) for k in keys], "cells array<string>")
    for t in (0.0, 0.1, 0.3, 1.0):
        got = {(r["q_key"], r["d_key"]) for r in key_pairs(query_table(spark, [(k,) for k in keys if k]), rows, t).collect()}
        assert {p for p in got if p[0] in keys and p[1] in keys} == {(a, b) for a in keys if a for b in keys if near(a, b, t)}


def test_extended_rows_are_distinct(spark):
    lake = Lake(spark.createDataFrame([(t, r, c, v) for t in range(2) for r, row in enumerate([["k1", "v1"], ["k1", "v1"], ["k2", "v2"], ["", "v3"]]) for c, v in enumerate(row)], "table_id long, row_id int, col_id int, value string"))
    assert collect_rows(extend_rows(query_table(spark, [("k1", "v1"), ("k1", "v1")]), lake)) == [("k1", "v1"), ("k2", "v2")]
