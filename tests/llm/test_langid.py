import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barelake.llm import langid

SYLLABLES = {"xx": "ba be bi bo bu da de".split(), "yy": "sta stu pro pre kla klo".split(), "ру": "да не на по ко ми".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=240))]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !!", "xx"), (1003, "bada dede", None), (None, "bada dede bobu", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs.where("doc_id < 1000"))


def test_held_out(docs):
    got = langid.identify_held_out(docs.withColumn("score", F.lit("clash"))).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert len(out) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "xx" and not by[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got)


def test_spans_of_mixed_text(model):
    rng = random.Random(5)
    text = sentence(rng, "xx", 40) + " " + sentence(rng, "yy", 30) + " " + sentence(rng, "xx", 25)
    lang, score, spans = langid.predict(model, text)
    assert lang == "xx" and 0.4 < score < 0.9
    assert [s[0] for s in spans] == ["xx", "yy", "xx"] and abs(spans[1][1] - 40) < 5 and abs(spans[1][2] - 70) < 5


def test_scripts_narrow(model):
    """A word in a script that only one language uses is that language's, whatever its letters."""
    assert langid.predict(model, "жук")[0] == "ру"
    assert langid.predict(model, "漢字")[2]  # no language uses the script: any label, but a label


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(0, 3, (rng.integers(1, 7), 3)).astype(np.float32)
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(3), repeat=len(s)))
        assert value(langid.viterbi(s, 4.0)) == pytest.approx(best, abs=1e-4)


def test_grams_of_words_stand_alone():
    tokens = ["a", "über", "the", "a" * 300]
    buckets, starts = langid.grams(tokens)
    ends = [*starts[1:], len(buckets)]
    for w, a, b in zip(tokens, starts, ends):
        alone, _ = langid.grams([w])
        assert list(buckets[a:b]) == list(alone)


def test_cache_bound(model, monkeypatch):
    text = " ".join(sentence(random.Random(i), "yy", 5) for i in range(50))
    want = langid.predict(model, text)
    monkeypatch.setattr(langid, "_CACHE", 3)
    assert [langid.predict(model, text) for _ in range(3)] == [want] * 3


def test_empty(docs):
    empty = docs.where("false")
    assert langid.identify_held_out(empty).collect() == []
    unknown = langid.train(empty)
    assert langid.predict(unknown, "anything") == ("und", 0.0, [])


def test_sample_bound(docs):
    few = langid.train(docs, most_docs=20)
    assert few.langs == sorted(SYLLABLES)
