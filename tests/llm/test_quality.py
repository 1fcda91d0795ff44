import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barelake.llm import quality

N = quality.ORDER


def prose(rng, n):
    return " ".join(rng.choice(["stone", "river", "green", "walks", "house", "small", "and", "the"]) for _ in range(n)).capitalize() + "."


def units(text):
    """The units by plain loops."""
    raw = (text or "").encode("utf-16-le", "surrogatepass")
    out = [raw[k] + 256 * raw[k + 1] for k in range(0, len(raw), 2)]
    space = [chr(c).isspace() for c in out]
    again, before, i = [], None, 0
    while i < len(out):
        if space[i]:
            i += 1
            continue
        j = i
        while j < len(out) and not space[j]:
            j += 1
        if out[i:j] == before:
            again.append(i - 1)
        before, i = out[i:j], j
    for k in again:
        out[k] = quality.AGAIN
    return [10] * (N - 1) + out + [10]


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its definition, as a function of an n-gram."""
    counts = [None, *[Counter() for _ in range(N)]]
    for t in texts:
        s = units(t)
        counts[N].update(tuple(s[i : i + N]) for i in range(len(s) - N + 1))
    for k in range(N - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k * 0.5 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d)]

    tables = []
    for k in range(1, N + 1):
        d, total, spare = discounts(counts[k]), defaultdict(int), defaultdict(float)
        for g, v in counts[k].items():
            total[g[:-1]] += v
            spare[g[:-1]] += d[min(v, 3) - 1]
        tables.append((counts[k], d, total, spare))

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        c, d, total, spare = tables[len(g) - 1]
        if not total[g[:-1]]:
            return p(g[1:])
        v = c[g]
        return (v - (d[min(v, 3) - 1] if v else 0)) / total[g[:-1]] + spare[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def nll(p, text):
    s = units(text)
    return -sum(math.log(p(tuple(s[i : i + N]))) for i in range(len(s) - N + 1)), len(s) - N + 1


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        lang = rng.choice(["en", "xx", None])
        junk = i % 6 == 0
        text = prose(rng, rng.randint(1, 60))
        if junk:
            text = rng.choice([" ".join(w + "$$$ ***" for w in text.split()), text.upper() + "!! " * 20, " | ".join(text.split()), " ".join([text.split()[0]] * 40)])
        rows.append((i, text, lang, "s", len(text), "clash"))
        if i % 2:
            labels.append((i, 1, 0))
    rows += [(1000, None, "en", None, None, "clash"), (1001, "", "zz", "s", 0, "clash"), (None, prose(rng, 30), "en", "s", 1, "clash"), (3, rows[3][1], "en", "s", 1, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep string").cache()
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (1000, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("text", ["", "a", "the the  the\nthe", "Ab ab ab", "x x y y x", " lead lead ", "é é ê 漢 漢 \U0001f600 \U0001f600", "a\u2003a b\u00a0b"])
def test_units(text):
    s = units(text)
    want = [sum(c << 16 * (N - 1 - k) for k, c in enumerate(s[i : i + N])) for i in range(len(s) - N + 1)]
    assert quality.grams(text).view(np.uint64).tolist() == want


TEXTS = ["the stone and the small house.", "река и малый дом у реки", "Déjà vu, déjà vu vu vu", "", "漢字 と かな \U0001f600"] * 3 + ["ten 10 Ten TEN"]


@pytest.mark.parametrize("small", [False, True])
def test_model(spark, monkeypatch, small):
    """Probabilities and sums against the definition, for texts of all models, whatever the size of blocks and shards."""
    if small:
        monkeypatch.setattr(quality, "BLOCK", 40)
        monkeypatch.setattr(quality, "CHUNK", 30)
        monkeypatch.setattr(quality, "HELD", 20)
        monkeypatch.setattr(quality, "SHARDS", 3)
    rng = random.Random(5)
    parts = [[t for t in [*TEXTS, prose(rng, 20)] if rng.random() < 0.6] for _ in range(2)]
    model = quality.fit(spark.createDataFrame([(k, t) for k in (0, 1) for t in parts[k]], "part int, text string"))
    asked = [*TEXTS, None, "unseen Ж and ж; 漢 \U0001f601", "the the the"]
    for fold, texts in enumerate([parts[0] + parts[1], parts[1], parts[0]]):
        p = brute_model(texts)
        got = model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), F.lit(fold), keep_text=not small).collect()
        assert len(got) == len(asked)
        for r in got:
            s, n = nll(p, asked[r["doc_id"]])
            assert r["__score"]["n"] == n and r["__score"]["s"] == pytest.approx(s, rel=1e-5)
            assert small or r["text"] == asked[r["doc_id"]]


def test_classify(corpus):
    docs, labels = corpus
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    long = {r["doc_id"] for r in docs.collect() if r["text"] and len(r["text"]) > 150}
    junk = [r for r in got if r["doc_id"] in long and r["doc_id"] is not None and r["doc_id"] % 6 == 0]
    good = [r for r in got if r["doc_id"] in long and r["doc_id"] is not None and r["doc_id"] % 6]
    assert junk
    assert [r["doc_id"] for r in junk if r["keep"]] == []
    assert [r["doc_id"] for r in good if not r["keep"]] == []
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["keep"] and by[1001]["keep"] and by[None]["keep"]


def test_against_brute_force(corpus):
    docs, labels = corpus
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1} - {None}
    rows = docs.collect()
    trusted = [r for r in rows if r["doc_id"] in good and r["text"] is not None]
    p = brute_model([r["text"] for r in trusted])
    half = {r["text"]: r["half"] for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()}
    others = [brute_model([r["text"] for r in trusted if half[r["text"]] != k]) for k in (0, 1)]
    sums = defaultdict(lambda: [0.0, 0])
    for r in trusted:
        s, n = nll(others[half[r["text"]]], r["text"])
        for k in (r["lang"], "*"):
            sums[k][0] += s
            sums[k][1] += n
    mean = {k: s / n for k, (s, n) in sums.items()}
    got = quality.classify(docs, labels).collect()
    found = sorted((str(r["doc_id"]), str(r["lang"]), round(math.log(r["perplexity"]), 3)) for r in got)
    want = []
    for r in rows:
        s, n = nll(p, r["text"])
        m = mean[r["lang"]] if r["lang"] in mean else mean["*"]
        want.append((str(r["doc_id"]), str(r["lang"]), round((s + quality.PRIOR * m) / (n + quality.PRIOR), 3)))
    for f, w in zip(found, sorted(want)):
        assert f[:2] == w[:2] and f[2] == pytest.approx(w[2], abs=2e-3)


def test_filter(corpus):
    docs, labels = corpus
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns and set(r["keep"] for r in kept.collect()) == {"clash"}
    assert 0 < kept.count() < docs.count()


def test_without_trusted_documents(corpus):
    docs, labels = corpus
    assert quality.classify(docs, labels.where("false")).where("keep").count() == docs.count()
    assert quality.classify(docs.where("false"), labels).collect() == []
    assert quality.filter_quality(docs.where("false"), labels).collect() == []


def test_one_trusted_text(spark):
    """All trusted texts may fall into one half."""
    docs = spark.createDataFrame([(k, "the small house by the river and the green stone " * 8, "en") for k in range(3)] + [(9, "Zq%% x## Zq%% " * 30, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")).collect()}
    assert got == {0: True, 1: True, 2: True, 9: False}


def test_other_scripts(spark):
    """Letters count in every script."""
    rng = np.random.default_rng(4)
    words = ["река", "дом", "поле", "лес", "камень", "город"]
    good = [" ".join(rng.choice(words, 40)) for _ in range(40)]
    junk = "".join(" " if c == " " else chr(0x430 + int(rng.integers(32))) for c in good[0])
    docs = spark.createDataFrame([*((i, t, "ru") for i, t in enumerate(good)), (99, junk, "ru")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).collect()}
    assert not got[99] and all(got[i] for i in range(40))
