import hashlib
import random

import numpy as np
import pytest

from barelake.llm import spotsigs


def order(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))


def mark(c):
    return any(a <= ord(c) <= b for a, b in [(0x2000, 0x206F), (0x3000, 0x3003), (0x3008, 0x301F), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])


def unspaced(c):
    return any(a <= ord(c) <= b for a, b in [(0xE01, 0xE4E), (0xE81, 0xECE), (0x1000, 0x109F), (0x1780, 0x17D3), (0x3041, 0x309F), (0x30A1, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)])


def brute_signatures(text):
    """The definition, word by word, as sets of text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c.isascii() and not c.isalnum() or mark(c) else f" {c} " if unspaced(c) else c for c in low).split(" ")
    words = [w for w in words if w]
    common = set(spotsigs.COMMON.split())
    anchor = lambda w: w in common or len(w.encode()) <= 2
    out = set()
    for i, w in enumerate(words):
        rest = [x for x in words[i + 1 :] if not anchor(x)][: spotsigs.CHAIN]
        if anchor(w) and len(rest) == spotsigs.CHAIN:
            out.add((w, *rest))
    if out:
        return out
    return {" ".join(words) or text} if text else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "in", "stone", "river", "green", "walks", "house", "small", "Größe", "tree7", "it's", "x"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


def test_signatures():
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(200)] + [None, "", " ", "!!", "stone river", "the"]
    texts += ["“stone” river — the small green house", "今日は川のほとりの小さな家を見に行きました。とても静かな町でした。", "我们在河边的小房子里看见了一个老人和他的狗，这是很安静的地方。", "น้ำในแม่น้ำไหลผ่านเมืองเก่า", "the 家 of 川"]
    sets = [brute_signatures(t) for t in texts]
    assert [len(spotsigs.signatures(t)) for t in texts] == [len(s) for s in sets]
    for _ in range(1000):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert spotsigs.likeness(spotsigs.signatures(texts[i]), spotsigs.signatures(texts[j])) == pytest.approx(jaccard(sets[i], sets[j]))


@pytest.mark.parametrize("rows", [4096, 2])
def test_next(hard, rows):
    """Against the definition; with small ranges as well, where the next document lies in another range."""
    docs = order(hard.collect())
    want = []
    for i, r in enumerate(docs):
        text, after = r["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        a, b, c = map(brute_signatures, (text, new, after))
        want.append((str(r["doc_id"]), len(text), hashlib.sha256(new.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    got = spotsigs.compare_next(hard, rows=rows).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(want)


def test_many_ranges(spark):
    rng = random.Random(9)
    docs = [(rng.randrange(10**9) if i % 3 else i, prose(rng, rng.randint(0, 30))) for i in range(700)]
    docs = list(dict(docs).items())
    got = spotsigs.compare_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), rows=64).collect()
    docs.sort()
    want = {}
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        want[d] = hashlib.sha256(spotsigs.edited(text, after).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want and len(got) == len(docs)


def test_single_and_empty(spark, none):
    assert spotsigs.compare_next(none).collect() == []
    one = spotsigs.compare_next(spark.createDataFrame([(4, "the stone river ran")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["doc_id"] == 4


def test_equal_texts_have_equal_fingerprints():
    a = spotsigs.fingerprint(spotsigs.signatures("The stone river and the green house"))
    assert a == spotsigs.fingerprint(spotsigs.signatures("The stone river and the green house"))
    assert a != spotsigs.fingerprint(spotsigs.signatures("The stone river and the small house"))


@pytest.mark.parametrize("block", [256, 4])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rng = random.Random(block)
    base = [prose(rng, 80).split() for _ in range(12)]
    docs = []
    for i in range(90):
        words = list(base[min(11, int(rng.expovariate(0.4)))])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = rng.choice(["cloud", "amber", "the"])
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "lonely")]
    sets = {d: brute_signatures(t) for d, t in docs}
    root = {d: d for d in sets}
    while True:
        new = {a: min(root[b] for b in sets if jaccard(sets[a], sets[b]) >= 0.8 and (sets[a] or not sets[b])) for a in sets}
        if new == root:
            break
        root = new
    got = spotsigs.spot_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_likeness_prunes():
    a, b = np.arange(10, dtype=np.uint64), np.arange(2, dtype=np.uint64)
    assert spotsigs.likeness(a, b, 0.5) == 0.0 and spotsigs.likeness(a, b) == 0.2


def test_scripts_without_spaces():
    """An edit leaves most signatures of a text without spaces."""
    text = "我们在河边的小房子里看见了一个老人和他的狗，这是很安静的地方。他们不是有钱的人，也就在这里过了一生。"
    a, b = spotsigs.signatures(text), spotsigs.signatures(text.replace("老人", "青年"))
    assert len(a) > 10 and 0.5 < spotsigs.likeness(a, b) < 1
