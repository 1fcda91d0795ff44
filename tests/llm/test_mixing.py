import hashlib
import math
from collections import Counter

import pytest

from barelake.llm import mixing


def brute(rows, weights=None, default=1.0, size=1.0, seed=42):
    sources = Counter(r["source"] for r in rows)
    w = {s: (weights or {}).get(s, default) for s in sources}
    total = sum(w.values())
    out = Counter()
    for r in rows:
        rate = w[r["source"]] * size * len(rows) / total / sources[r["source"]] if total else 0
        ident = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5(r["text"].encode()).hexdigest() if r["text"] is not None else "null"
        u = int(hashlib.md5(f"{ident}:{seed}".encode()).hexdigest()[:13], 16) / 2**52
        n, term, total_p = 0, math.exp(-rate), math.exp(-rate)
        while total_p <= u:
            n += 1
            term *= rate / n
            total_p += term
        for c in range(n):
            out[(r["doc_id"], r["text"], c, hashlib.md5(f"{ident}:{c}:{seed}:shuffle".encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"weights": {"a": 3.0, "b": 0.0}, "size": 4.0}, {"weights": {"a": 1.0}, "default_weight": 0.0}, {"default_weight": 0.0}])
def test_against_brute_force(hard, options):
    want = brute(hard.collect(), options.get("weights"), options.get("default_weight", 1.0), options.get("size", 1.0))
    mixed = mixing.mix(hard, **options)
    assert mixed.columns == [c for c in hard.columns if c not in ("copy", "shuffle_key")] + ["copy", "shuffle_key"]
    assert Counter((r["doc_id"], r["text"], r["copy"], r["shuffle_key"]) for r in mixed.collect()) == want


def test_large_rate(spark):
    """Rates at which the first probabilities underflow."""
    docs = spark.createDataFrame([(i, "t", "big" if i else "small") for i in range(3000)], "doc_id long, text string, source string")
    got = Counter(r["source"] for r in mixing.mix(docs).select("source").collect())
    assert abs(got["small"] - 1500) < 6 * math.sqrt(1500) and abs(got["big"] - 1500) < 6 * math.sqrt(1500)
    assert mixing.mix(docs).where("source = 'small'").count() == got["small"]


def test_salted_lookup(hard, monkeypatch):
    """Beyond the broadcast limit the same rows come out of the salted join."""
    from barelake.llm import common

    want = sorted(map(str, mixing.mix(hard, size=3.0).collect()))
    plain = common.lookup
    monkeypatch.setattr(mixing, "lookup", lambda df, key, small: plain(df, key, small, limit=1))
    assert sorted(map(str, mixing.mix(hard, size=3.0).collect())) == want


def test_empty(none):
    assert mixing.mix(none).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(none, {"a": -1.0})


def test_native(hard):
    """No Python on the main path."""
    plan = mixing.mix(hard)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
