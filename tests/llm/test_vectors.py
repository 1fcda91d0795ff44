import numpy as np
import pytest

from barelake.llm import vectors


def brute(rows):
    """links and components by all pairs, in double precision."""
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows if i is not None}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[a].add(b)
    root = {i: i for i in links}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
        if new == root:
            return {i: (len(links[i]), root[i], root[i] == i) for i in links}
        root = new


def clusters(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    rows = [(i, (centres[rng.integers(len(centres)) if rng.random() < 0.6 else 0] + rng.normal(0, 0.12, dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(30)]
    rows += [(n + 100, None), (n + 101, []), (n + 102, [0.0] * dim), (n + 103, [float("nan")] + [1.0] * (dim - 1)), (n + 104, [None] + [1.0] * (dim - 1)), (n + 105, [float("inf")] + [1.0] * (dim - 1)), (n + 106, [1.0, 2.0]), (n + 107, [2.0, 4.0])]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_against_brute_force(spark, monkeypatch, block):
    """A dense group, exact copies and invalid vectors; also with groups over many blocks."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = clusters(block)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows] + [(None, rows[0][1], 1, "x")], "vec_id long, embedding array<float>, label int, links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert got.pop(None) == (0, None, True)
    want = brute(rows)
    found, true = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert set(got) == set(want) and found >= 0.99 * true
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(df).collect() == []
    one = spark.createDataFrame([(5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.near_vectors(one).collect()] == [(5, 0, 5, True)]


def test_passes_grow_with_the_table():
    assert vectors.passes(100) <= vectors.passes(10**4) < vectors.passes(10**6) < vectors.passes(10**9)
