"""Language of texts, with spans for mixed ones (operator 5).

A model holds, for each language, the log-probabilities of the character
n-grams of words, hashed to a fixed number of buckets, and the scripts that its
training texts use. A word's script narrows the languages it is scored for.
Viterbi decoding over the words' scores, with a penalty for each change of
language, labels every word. Where no stretch of words gains enough by
another language to pay the penalties, the best path is constant and isn't
searched for; the answer is the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
PENALTY = 12.0
#: Training documents for each language; those with the smallest hash of their text are taken.
TRAIN_DOCS = 20_000
#: A script belongs to a language that uses it in at least this share of its words.
SCRIPT_SHARE = 0.01
SEED = 42
_CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")

#: First code points of scripts and the name each range has.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFDD, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_CODE = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def script(word: str) -> int:
    """The number of the script of a word's first letter."""
    c = ord(word[0])
    return int(_CODE[0]) if c < 0x370 else int(_CODE[np.searchsorted(_STARTS, c, "right") - 1])


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall((text or "").lower())


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the buckets of the n-grams of each word, with marks at its ends, word after word, and where each word's begin."""
    flat = np.frombuffer(("^" + "$^".join(tokens) + "$").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(flat))
    first = np.repeat(np.concatenate([[0], np.cumsum(sum(np.maximum(sizes - n + 1, 0) for n in ORDERS))[:-1]]), sizes)
    out = np.empty(int(sum(np.maximum(sizes - n + 1, 0).sum() for n in ORDERS)), np.int64)
    done, h = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.uint64)
    inside = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    for n in ORDERS:
        m = len(flat) - n + 1
        h[:m] += (flat[n - 1 :] + np.uint64(n)) * _MIX[n - 1]
        ok = np.nonzero(room[:m] >= n)[0]
        g = h[ok]
        g = (g ^ (g >> np.uint64(31))) * _MIX[0]
        out[first[ok] + done[ok] + inside[ok]] = (g >> np.uint64(40)).astype(np.int64) % BUCKETS
        done += np.repeat(np.maximum(sizes - n + 1, 0), sizes)
    return out, np.unique(first)


@dataclass
class Model:
    """scores[bucket, language]: log-probabilities; scripts[script, language]: whether the language uses it."""

    langs: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    def __post_init__(self) -> None:
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1024, len(self.langs)), np.float32)

    def __getstate__(self):
        return self.langs, self.scores, self.scripts

    def __setstate__(self, state) -> None:
        self.langs, self.scores, self.scripts = state
        self.__post_init__()

    def score(self, tokens: list[str]) -> np.ndarray:
        """Of each word, for each language: the summed log-probabilities of its n-grams over the root of their number, against the best."""
        buckets, starts = grams(tokens)
        number = np.diff(np.append(starts, len(buckets)))[:, None]
        s = np.add.reduceat(self.scores[buckets], starts, axis=0) / np.sqrt(number)
        use = self.scripts[[script(w) for w in tokens]]
        unknown = ~use.any(axis=1)
        use[unknown] = True
        worst = np.where(use, s, np.inf).min(axis=1, keepdims=True) - PENALTY
        s = np.where(use, s, worst)
        s -= s.max(axis=1, keepdims=True)
        s[unknown] = 0
        return s.astype(np.float32)

    def matrix(self, tokens: list[str]) -> np.ndarray:
        """The scores of words, a row for each. Keeps those of words seen before, up to a bound."""
        rows = self._rows
        if len(rows) > _CACHE:
            rows.clear()
        new = [w for w in dict.fromkeys(tokens) if w not in rows]
        if new:
            first = len(rows)
            rows.update(zip(new, range(first, first + len(new))))
            while len(rows) > len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            for k in range(0, len(new), 8192):
                some = new[k : k + 8192]
                self._table[first + k : first + k + len(some)] = self.score(some)
        return self._table[np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))]


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each row of scores on the best path, where each change costs the penalty. Ties: the first language, then staying."""
    n, k = s.shape
    s = s.astype(np.float64)
    total = s.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(s - s[:, best : best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(np.concatenate([np.zeros((1, k)), gain[:-1]]), axis=0), 0)
    first, last = max(gain.max(), 0), max((gain[-1] - gain).max(), 0)
    # A stretch in other languages pays for each of its pieces, or for one less if it is all of the text.
    if (gain - low).max() <= penalty and first + last <= penalty:
        return np.full(n, best)
    back, v = [], s[0].tolist()
    for row in s[1:].tolist():
        top = max(v)
        moved = top - penalty
        back.append((v.index(top), [x < moved for x in v]))
        v = [(x if x >= moved else moved) + r for x, r in zip(v, row)]
    out = np.empty(n, np.int64)
    at = out[-1] = v.index(max(v))
    for t in range(n - 2, -1, -1):
        top, leave = back[t]
        if leave[at]:
            at = top
        out[t] = at
    return out


Prediction = tuple[str, float, list[tuple[str, int, int]]]


def predict_all(model: Model, texts: list[str | None]) -> list[Prediction]:
    """predict() of each text; their words are scored together."""
    if not model.langs:
        return [("und", 0.0, [])] * len(texts)
    tokens = [words(t) for t in texts]
    scores = model.matrix([w for ws in tokens for w in ws])
    ends = np.cumsum([len(ws) for ws in tokens])
    return [_decide(model, ws, scores[e - len(ws) : e]) for ws, e in zip(tokens, ends.tolist())]


def predict(model: Model, text: str | None) -> Prediction:
    """(language, score, spans): the language of most letters, its share, and (language, first word, end) along the text."""
    return predict_all(model, [text])[0]


def _decide(model: Model, tokens: list[str], scores: np.ndarray) -> Prediction:
    if not tokens:
        return "und", 0.0, []
    path = viterbi(scores)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    share = np.bincount(path, weights=sizes, minlength=len(model.langs))
    k = int(share.argmax())
    cuts = np.concatenate([[0], np.nonzero(path[1:] != path[:-1])[0] + 1, [len(path)]])
    return model.langs[k], float(share[k] / share.sum()), [(model.langs[path[a]], int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_docs: int = TRAIN_DOCS) -> Model:
    """Fit a model on labelled documents; rows without text or label are left out.

    For each language the ``most_docs`` documents with the smallest hash of
    their text are used: the hash below which they lie is the quantile of the
    language's hashes. Counts are made in the cluster; the driver gets BUCKETS
    sums for each language, and one row for each script of it.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    chance = known.withColumn("h", F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 30)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(1 << 30)
    for lang, n in sizes.items():
        if n > most_docs:
            rate = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * most_docs / n))).otherwise(rate)
    taken = chance.where(F.col("h") < rate).select("lang", "text")
    arrow = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("key", pa.int32()), ("n", pa.int64())])

    def count(batches):
        by: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = by.setdefault(lang, {})
                for w in words(text):
                    seen[w] = seen.get(w, 0) + 1
            if sum(map(len, by.values())) > _CACHE:
                yield from told(by)
                by = {}
        yield from told(by)

    def told(by):
        for lang, seen in by.items():
            tokens, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
            scripts = np.bincount([script(w) for w in tokens], weights=n, minlength=len(_NAMES)).astype(np.int64)
            sums = np.zeros(BUCKETS)
            for k in range(0, len(tokens), 8192):
                buckets, starts = grams(tokens[k : k + 8192])
                sums += np.bincount(buckets, weights=np.repeat(n[k : k + 8192], np.diff(np.append(starts, len(buckets)))), minlength=BUCKETS)
            sums = sums.astype(np.int64)
            for kind, values in ((0, sums), (1, scripts)):
                keys = np.nonzero(values)[0]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "kind": [kind] * len(keys), "key": keys.astype(np.int32), "n": values[keys]}, schema=arrow)

    counts = taken.mapInArrow(count, "lang string, kind int, key int, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    sums, scripts = np.full((BUCKETS, len(langs)), 0.1), np.zeros((len(_NAMES), len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    for kind, table in ((0, sums), (1, scripts)):
        rows = found[found["kind"] == kind]
        np.add.at(table, (rows["key"].to_numpy(), rows["lang"].map(at).to_numpy(np.int64)), rows["n"].to_numpy())
    scores = np.log(sums / sums.sum(axis=0)).astype(np.float32) if langs else sums.astype(np.float32)
    return Model(langs, scores, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, spans), one for each row of docs.

    lang_pred is ``und`` and score 0 if the text is null or has no letter, or
    the model knows no language. spans lists language:first word:end. Rows with
    null ids and repeated rows are kept; other columns are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.string())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = predict_all(sent.value, batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": [",".join(f"{x}:{a}:{b}" for x, a, b in f[2]) for f in found]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, spans string", arrow, rows=256)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Train on the documents whose crc32(doc_id as text) mod 4 isn't 2; predict for all of ``documents``.

    Adds ``held_out``: whether that remainder is 2; false for a null id, which
    is trained on if it has a label.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~fold))
    out = identify(docs, model)
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "spans")

