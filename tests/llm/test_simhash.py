import random

import pytest
import xxhash
from pyspark.sql import functions as F

from barelake.llm import simhash
from barelake.llm.components import connected_components


def brute(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            words, word = [*words, word] if word else words, ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words = [*words, word] if word else words
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, codes, distance=2):
    """The smallest id reachable from each row."""
    label = list(range(len(codes)))
    while True:
        new = [min(label[j] for j in range(len(codes)) if (codes[i] ^ codes[j]).bit_count() <= distance) for i in range(len(codes))]
        if new == label:
            break
        label = new
    return [min((ids[j] for j in range(len(codes)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(codes))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "A b c", "ÀÉ Straße x\x0by z\x1cw q", "a a a a a a"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute(text)


def test_long_text():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(70_000))
    assert simhash.fingerprint(text) == simhash.fingerprint(text.upper())
    old = simhash._BLOCK
    try:
        simhash._BLOCK = 1000
        assert simhash.fingerprint(text) == brute(text)
    finally:
        simhash._BLOCK = old


def test_hard_rows(hard):
    got = simhash.simhash_components(hard).collect()
    rows = hard.select("doc_id", "text").collect()
    codes = [brute(r["text"]) for r in rows]
    want = sorted(zip([str(r["doc_id"]) for r in rows], [f"{c:016x}" for c in codes], map(str, components([r["doc_id"] for r in rows], codes))))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_empty(none):
    assert simhash.simhash_components(none).collect() == []


def near_codes(seed):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(160):
        codes.append(rng.choice(codes) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    return codes


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links(spark, monkeypatch, bucket):
    """Also where buckets overflow and are probed as whole codes."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    codes = near_codes(bucket)
    fps = spark.createDataFrame([(i, simhash._signed(c)) for i, c in enumerate(codes)], "doc_id long, fp long")
    got = fps.join(simhash.link_fingerprints(fps), "fp").orderBy("doc_id").collect()
    assert [r["component"] for r in got] == components(list(range(len(codes))), codes)


def test_plan_is_complete():
    """The thresholds make up what the pigeonhole principle needs, and each bit is in one part."""
    import numpy as np

    codes = np.array(near_codes(5), np.uint64)
    parts = simhash.plan(codes, 10**6)
    assert sorted(b for bits, _ in parts for b in bits) == list(range(64))
    assert sum(t for _, t in parts) == 2 - len(parts) + 1
    assert simhash.allot([[0, 5, 9], [0, 1, 2], [0, 7, 8]], 0)[1] == [0, 1, -1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 90), (None, 3), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {100: 90, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
