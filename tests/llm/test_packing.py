import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from barelake.llm import packing


def test_ids_equal_those_of_tokenizers():
    """The fast path gives the ids of the library and file that are asked for."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    rng = random.Random(0)
    texts = ["", " ", "Hello  world\n\n\tx", "<|endoftext|> a <|endoftext|>", "naïve 😀 漢字 ﬁ​", "a" * 5000, " " * 3000 + "x", "\r\n" * 50, "don't I'LL 12345 $%&"]
    texts += ["".join(chr(rng.choice([32, 10, rng.randint(33, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for text in texts:
        assert list(packing.token_ids(text)) == [*t.encode(text, add_special_tokens=False).ids, 1], text


def first_fit(sizes, capacity):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, used in enumerate(bins) if used + sizes[i] <= capacity), None)
        if k is None:
            bins.append(0)
            k = len(bins) - 1
        out[i] = (k, bins[k])
        bins[k] += sizes[i]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 300])
def test_tree(n):
    rng = random.Random(n)
    sizes = [rng.randint(1, 100) for _ in range(n)]
    assert packing.first_fit_decreasing(sizes, 100) == first_fit(sizes, 100)


def check(rows, texts, length):
    """Each id lies in exactly one piece; sequences are gapless, not too long; checksums are right."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length
    total = sum(len(packing.token_ids(t)) for _, t in texts)
    assert sum(r["length"] for r in rows) == total
    for doc, text in texts:
        ids = packing.token_ids(text)
        pieces = sorted({(r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc, len(ids)]})
        whole = [(s, n, c) for s, n, c in pieces if zlib.crc32(ids[s : s + n].tobytes()) == c]
        assert sorted({i for s, n, _ in whole for i in range(s, s + n)}) == list(range(len(ids)))
    return by_sequence


@pytest.mark.parametrize("options", [{}, {"length": 64, "group": 3}])
def test_round_trip(hard, options):
    rows = packing.pack(hard, **options).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in hard.collect()], options.get("length", 2048))


def test_little_padding(spark):
    rng = np.random.default_rng(1)
    texts = [(i, "word " * int(n)) for i, n in enumerate(rng.lognormal(5, 1, 1500))]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    by_sequence = check(rows, texts, 2048)
    used = [sum(r["length"] for r in p) for p in by_sequence.values()]
    assert sum(used) / (2048 * len(used)) > 0.98


def test_same_when_run_again(hard):
    key = lambda rows: sorted(map(str, rows))
    assert key(packing.pack(hard).collect()) == key(packing.pack(hard.repartition(3)).collect())


def test_empty(none):
    assert packing.pack(none).collect() == []
