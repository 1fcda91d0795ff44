import itertools
import random

import numpy as np
import pytest

from barelake.llm import similar
from barelake.llm.common import Forest


def brute(rows, least=0.8, size=5):
    """The smallest id reachable from each (id, text) through pairs of sets of that similarity."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        sets.append({" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    forest = Forest()
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
            forest.join(a, b)
    roots = [forest.find(k) for k in range(len(rows))]
    return [min((i for (i, _), r in zip(rows, roots) if r == root and i is not None), default=None) for root in roots]


def found(df):
    return sorted((str(r["doc_id"]), str(r["component_id"])) for r in similar.near_components(df).collect())


def wanted(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    return sorted((str(i), str(c)) for (i, _), c in zip(rows, brute(rows)))


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == wanted(df)


def test_hard_rows(hard):
    assert found(hard) == wanted(hard)
    kept = similar.deduplicate(hard)
    assert kept.columns == hard.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "3", "5", "6", "7", "None", "None"])


def test_empty(none):
    assert similar.near_components(none).collect() == [] and similar.deduplicate(none).collect() == []


def test_id_on_several_texts(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(3)]
    df = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (7, texts[0]), (3, texts[1]), (9, texts[2])], "doc_id long, text string")
    assert found(df) == wanted(df)
    assert sorted(r["doc_id"] for r in similar.deduplicate(df).collect()) == [3, 5, 5, 9]


def family(rng, number, changed):
    """Texts of 120 words, each with a few words of the first one replaced."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    out = [" ".join(base)]
    for k in range(number - 1):
        words = list(base)
        for at in rng.sample(range(120), changed):
            words[at] = f"n{k}r{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bucket", [8])
def test_crowded_buckets(spark, monkeypatch, bucket):
    """Large groups are found whole whatever the size of a bucket: families of copies of one text, and many other texts."""
    monkeypatch.setattr(similar, "BUCKET", bucket)
    rng = random.Random(3)
    texts = family(rng, 60, 2) + family(rng, 40, 1) + [" ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(120)] + ["", None]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert found(df) == wanted(df)


def test_recall_at_the_similarity(spark):
    """Pairs between 0.8 and 0.85 are found."""
    rng, texts = random.Random(5), []
    while len(texts) < 400:
        words = [f"w{rng.randrange(10**7)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(0, 200, 10), 4):
            other[at] = f"x{rng.randrange(10**7)}"
        texts += [" ".join(words), " ".join(other)]
    sets = [similar.shingles(t) for t in texts]
    near = [similar.jaccard(sets[k], sets[k + 1]) for k in range(0, 400, 2)]
    assert min(near) >= 0.8 and max(near) < 0.86
    got = {r["doc_id"]: r["component_id"] for r in similar.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[k + 1] == k for k in range(0, 400, 2)) >= 197


def test_allot():
    rng = random.Random(2)
    for _ in range(30):
        costs = [[0.0] + sorted(rng.uniform(1, 9) for _ in range(2)) for _ in range(5)]
        gains = [[0.0] + sorted(rng.randint(1, 40) / 100 for _ in range(2)) for _ in range(5)]
        possible = [(sum(c[k] for c, k in zip(costs, ks)), ks) for ks in itertools.product(range(3), repeat=5) if sum(round(g[k] * 100) for g, k in zip(gains, ks)) >= 100]
        got = similar.allot(costs, [[g + 1e-9 for g in row] for row in gains], 1.0, 100)
        assert (got is None) == (not possible)
        if got:
            assert abs(got[0] - min(possible)[0]) < 1e-9 and sum(c[t + 1] for c, t in zip(costs, got[1])) == pytest.approx(got[0])


def test_plan_reaches_the_recall():
    bits = np.random.default_rng(1).integers(0, 2, (500, similar.BITS), dtype=np.uint8)
    p = similar.differing(0.8)
    for n in (500, 10**6, 10**8):
        parts = similar.plan(bits, n, p)
        used = np.concatenate([part for part, _ in parts])
        assert len(set(used.tolist())) == len(used)
        assert 1 - np.prod([1 - similar.hit(len(part), t, p) for part, t in parts]) >= similar.RECALL
        assert n < 10**6 or len(parts[0][0]) >= 10


def test_spanning():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, u = 30, rng.integers(0, 30, 80)
        v = (u + rng.integers(1, 30, 80)) % 30
        d = rng.integers(0, 9, 80)
        kept, forest, want = similar.spanning(u, v, d, n), Forest(), 0
        for k in np.lexsort((np.arange(80), d)):
            if forest.find(int(u[k])) != forest.find(int(v[k])):
                forest.join(int(u[k]), int(v[k]))
                want += d[k]
        assert d[kept].sum() == want and len(kept) == n - len({forest.find(k) for k in range(n)})
