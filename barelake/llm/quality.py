"""Quality by the perplexity of a language model (operator 10).

An interpolated modified Kneser-Ney model of fourth order over UTF-16 units is
trained on trusted texts; the white space before a word that repeats the one
before it is a unit of its own. Four units are one long, so n-grams are told
apart exactly and every script counts. Alphabet and n-grams come from the
trusted texts and grow with them: counts are made in the cluster, sharded by
n-gram, and joined with the counts of their contexts and suffixes into tables
of probabilities and backoff weights, which stay sharded.

Texts are scored by joins with these tables. The different n-grams of all texts
are looked up once. Texts are then dealt into blocks; a block asks each shard
for its different n-grams, as one row of packed numbers, a shard answers the
rows as they pass, and a block's answers meet its texts, which gives each
document's sum of log-probabilities.

Documents whose perplexity is above a quantile of the trusted documents of
their language are rejected. Trusted documents are measured for this by a model
of the half that they aren't in, as a model that grows with its texts knows
them too well.
"""

from __future__ import annotations

import itertools
import math
import operator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .common import MAX_BROADCAST_ROWS, give_back, giving_back, lookup_side, reliable, shuffles_removed, union_all

ORDER = 4
#: Bits of a unit; an n-gram of ORDER of them is a long.
UNIT = 16
#: Stands for the white space between a word and the same word again; no character has this code.
AGAIN = 0xFFFF
_END = 10
#: Units of a block of texts that asks for its n-grams at once.
BLOCK = 1 << 22
#: Units whose n-grams are held before they are put together.
CHUNK = 1 << 20
#: Different n-grams that a task holds before it hands them on.
HELD = 1 << 22
#: N-grams of a shard of the answers, and shards at least.
SHARD = 1 << 16
SHARDS = 31
#: The threshold is this quantile of the log-perplexities of a language's trusted documents, plus MARGIN.
QUANTILE = 0.995
MARGIN = 0.05
#: A document's mean is taken as if so many units of the language's typical text were added, which steadies short ones.
PRIOR = 100
_SPACE = np.array([chr(c).isspace() for c in range(1 << UNIT)])


def _repeats(text: str, units: np.ndarray) -> np.ndarray | list:
    """Places of the white space between a word and the same word again."""
    words = text.split()
    again = [k for k, same in enumerate(map(operator.eq, words, itertools.islice(words, 1, None)), 1) if same]
    if not again:
        return again
    space = _SPACE[units]
    starts = np.nonzero(space[:-1] & ~space[1:])[0]
    return starts[np.array(again) - (0 if space[0] else 1)]


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each unit, and at the end, as longs; before a text there are line ends."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    s = np.full(len(units) + ORDER, _END, np.uint64)
    s[ORDER - 1 : -1] = units
    if len(again := _repeats(text, units)):
        s[again + ORDER - 1] = AGAIN
    n = len(units) + 1
    g = s[:n]
    for k in range(1, ORDER):
        g = g << np.uint64(UNIT) | s[k : k + n]
    return g.view(np.int64)


def _counted(held: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    at, keys = pd.factorize(np.concatenate(held))
    n = np.bincount(at, None if weights is None else np.concatenate(weights), len(keys))
    return keys, n.astype(np.int64)


class _Tally:
    """Counts of n-grams, with a bound on what is held."""

    def __init__(self) -> None:
        self.texts: list[np.ndarray] = []
        self.size = 0
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: str) -> bool:
        """Whether the tally should be handed on."""
        self.texts.append(grams(text))
        self.size += len(self.texts[-1])
        if self.size < CHUNK:
            return False
        self.settle()
        return len(self.sums[0][0]) >= HELD

    def settle(self) -> None:
        if self.texts:
            self.sums.append(_counted(self.texts))
            self.texts, self.size = [], 0
        if len(self.sums) > 1:
            self.sums = [_counted([k for k, _ in self.sums], [n for _, n in self.sums])]

    def hand_on(self, part: int):
        """Record batches (part, gram, n); the tally is empty then."""
        self.settle()
        for keys, n in self.sums:
            for k in range(0, len(keys), 65_536):
                some = slice(k, k + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[some]), part, np.int32)), pa.array(keys[some]), pa.array(n[some])], names=["part", "gram", "n"])
        self.sums = []


def count(texts: DataFrame) -> DataFrame:
    """Rows (part, gram, n) of (part, text): the n-grams of each part's texts, several rows for one. Null texts count as empty."""

    def run(batches):
        tallies: dict[int, _Tally] = {}
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (tally := tallies.setdefault(part, _Tally())).add(text or ""):
                    yield from tally.hand_on(part)
        for part, tally in tallies.items():
            yield from tally.hand_on(part)

    return texts.mapInArrow(giving_back(run), "part int, gram long, n long")


def _discounts(ns: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = ns
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [k - (k + 1) * y * b / a if a and b else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out))


def _by(key: str, values: dict, otherwise: float) -> Column:
    """A number for each value of a column."""
    out = F.lit(float(otherwise))
    for k, v in values.items():
        out = F.when(F.col(key).eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(out)
    return out


def _last(order: int) -> Column:
    """The last ``order`` units of the column gram."""
    return F.col("gram") if order == ORDER else F.col("gram").bitwiseAND(F.lit((1 << UNIT * order) - 1))


def _context(order: int) -> Column:
    """The last ``order`` units without the last."""
    return F.shiftrightunsigned(_last(order), UNIT)


def _pack(x: np.ndarray) -> bytes:
    """Sorted longs as what they differ by, compressed."""
    return zstandard.compress(np.diff(x, prepend=np.int64(0)).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


@F.pandas_udf(BinaryType())
def _packed_texts(texts: pd.Series) -> pd.Series:
    """Texts as they are moved; null stays null."""
    box = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: None if t is None else box.compress(t.encode("utf-8", "surrogatepass")))


def _unpacked_text(data: bytes | None) -> str | None:
    return None if data is None else zstandard.decompress(data).decode("utf-8", "surrogatepass")


class Model:
    """Interpolated modified Kneser-Ney models, one for each fold: for each order a table of probabilities and one of backoff weights."""

    def __init__(self, counts: DataFrame) -> None:
        """counts: rows (fold, gram, n), one for each n-gram of a fold."""
        tables = [reliable(counts)]
        for order in range(ORDER - 1, 0, -1):
            tables.append(reliable(tables[-1].groupBy("fold", _last(order).alias("gram")).agg(F.count("*").alias("n"))))
        tables.reverse()
        numbers = [F.count("*").alias("rows"), F.sum("n").alias("total"), *[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]]
        stats = union_all([t.groupBy("fold").agg(*numbers).withColumn("order", F.lit(k)) for k, t in enumerate(tables, 1)]).collect()
        discounts = {(r["order"], r["fold"]): _discounts([r[f"n{k}"] for k in (1, 2, 3, 4)]) for r in stats}
        self.folds = sorted({r["fold"] for r in stats})
        first = {r["fold"]: r for r in stats if r["order"] == 1}
        #: N-grams of each order, which also bound the contexts of the next.
        self.sizes = [sum(r["rows"] for r in stats if r["order"] == k) for k in range(1, ORDER + 1)]
        #: An unseen unit has the share of one more of the alphabet.
        alphabet = {f: 1.0 / (r["rows"] + 1) for f, r in first.items()}
        weights = {f: (d[0] * r["n1"] + d[1] * r["n2"] + d[2] * (r["rows"] - r["n1"] - r["n2"])) / r["total"] for f, r in first.items() for d in [discounts[1, f]]}
        self.floor = {f: weights[f] * alphabet[f] for f in self.folds}
        self.probabilities, self.weights = [], []
        for order, table in enumerate(tables, 1):
            d = [_by("fold", {f: discounts[order, f][k] for f in self.folds}, 0.5) for k in range(3)]
            discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            if order == 1:
                total = _by("fold", {f: r["total"] for f, r in first.items()}, 1)
                found = table.select("fold", "gram", ((F.col("n") - discount) / total + _by("fold", self.floor, 1)).alias("p"))
            else:
                contexts = reliable(table.groupBy("fold", _context(order).alias("context")).agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight")))
                self.weights.append(contexts.select("fold", "context", "weight"))
                keyed = table.withColumn("context", _context(order)).join(contexts, ["fold", "context"])
                below = self.probabilities[-1].select(F.col("fold").alias("__fold"), F.col("gram").alias("__gram"), F.col("p").alias("__p"))
                found = keyed.join(below, (F.col("fold") == F.col("__fold")) & (_last(order - 1) == F.col("__gram"))).select("fold", "gram", ((F.col("n") - discount) / F.col("total") + F.col("weight") * F.col("__p")).alias("p"))
            self.probabilities.append(reliable(found))

    def look_up(self, asked: DataFrame) -> DataFrame:
        """asked (fold, gram) with ``lp``: the log-probability by the longest known n-gram and the weights of the contexts above it."""
        chain = F.log(_by("fold", self.floor, 1))
        for order in range(1, ORDER + 1):
            p = self.probabilities[order - 1].select(F.col("fold").alias(f"__f{order}"), F.col("gram").alias(f"__g{order}"), F.col("p").alias(f"__p{order}"))
            asked = asked.join(lookup_side(p, self.sizes[order - 1]), (F.col("fold") == F.col(f"__f{order}")) & (_last(order) == F.col(f"__g{order}")), "left")
            if order > 1:
                w = self.weights[order - 2].select(F.col("fold").alias(f"__h{order}"), F.col("context").alias(f"__c{order}"), F.col("weight").alias(f"__w{order}"))
                asked = asked.join(lookup_side(w, self.sizes[order - 2]), (F.col("fold") == F.col(f"__h{order}")) & (_context(order) == F.col(f"__c{order}")), "left")
                chain = chain + F.log(F.coalesce(F.col(f"__w{order}"), F.lit(1.0)))
            chain = F.coalesce(F.log(f"__p{order}"), chain)
        return asked.select("fold", "gram", chain.alias("lp"))

    def score(self, docs: DataFrame, fold: Column | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
        """docs with ``__score``: ``s`` (minus log-probability) and ``n`` (units and the end). Null texts count as empty.

        fold: the model that scores a document; 0 where there is no such one.
        keep_text: whether the text is handed on.

        One plan: the exchange of texts serves asking and summing, that of
        requests finding the different n-grams and answering.
        """
        text = F.col(text_col).cast("string")
        docs = docs.withColumn(text_col, text).withColumn("__fold", (F.lit(0) if fold is None else F.when(fold.isin(self.folds), fold).otherwise(0)).cast("int"))
        columns = [c for c in docs.columns if c != "__fold" and (keep_text or c != text_col)]
        shards = max(SHARDS, self.sizes[-1] // SHARD) | 1
        blocks = 1 + (docs.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0) // BLOCK
        hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        block = F.col("__fold") * F.lit(blocks) + F.pmod(F.xxhash64(*hashed), F.lit(blocks))
        dealt = docs.withColumn("__block", block.cast("long")).withColumn("__text", _packed_texts(text_col)).drop(text_col, "__fold").repartition("__block")
        asked = dealt.sortWithinPartitions("__block").mapInArrow(giving_back(_ask(shards, blocks)), "shard long, fold int, block long, packed binary").repartition("shard", "fold")
        different = asked.sortWithinPartitions("shard", "fold").mapInArrow(giving_back(_different_grams), "fold int, gram long")
        known = self.look_up(different).select(F.pmod("gram", F.lit(shards)).alias("shard"), "fold", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("packed"), "gram", F.col("lp").cast("float").alias("lp"))
        wanted = asked.withColumn("gram", F.lit(None).cast("long")).withColumn("lp", F.lit(None).cast("float"))
        met = known.union(wanted).repartition("shard", "fold").sortWithinPartitions("shard", "fold", "block")
        found = met.mapInArrow(giving_back(_answer), "block long, packed binary, lps binary")

        def judged(left: pa.Table, right: pa.Table) -> pa.Table:
            keys = np.concatenate([_unpack(x) for x in right["packed"].to_pylist()])
            lps = np.concatenate([np.frombuffer(x, np.float32) for x in right["lps"].to_pylist()]).astype(np.float64)
            keys, at = np.unique(keys, return_index=True)
            index, lps = pd.Index(keys), lps[at]
            texts, sums, sizes, held, open_ = [], [], [], [], 0

            def settle() -> None:
                scores = lps[index.get_indexer(np.concatenate(held))]
                starts = np.concatenate([[0], np.cumsum([len(g) for g in held])[:-1]])
                sums.extend((-np.add.reduceat(scores, starts)).tolist())

            for data in left["__text"].to_pylist():
                text = _unpacked_text(data)
                held.append(grams(text or ""))
                sizes.append(len(held[-1]))
                open_ += sizes[-1]
                if keep_text:
                    texts.append(text)
                if open_ >= CHUNK:
                    settle()
                    held, open_ = [], 0
            if held:
                settle()
            scores = pa.StructArray.from_arrays([pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], ["s", "n"])
            if keep_text:
                left = left.append_column(text_col, pa.array(texts, pa.string()))
            return left.select(columns).append_column("__score", scores)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = judged(left, right)
            give_back()
            return out

        fields = [f for f in docs.schema.fields if f.name in columns]
        schema = StructType([*fields, StructField("__score", StructType([StructField("s", DoubleType()), StructField("n", LongType())]))])
        return dealt.groupBy("__block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def _ask(shards: int, blocks: int):
    """mapInArrow function over rows with __block and __text in order of blocks: rows (shard, fold, block, packed) of a block's different n-grams."""

    def requests(block: int, held: list[np.ndarray]):
        keys = np.sort(pd.unique(np.concatenate(held)))
        shard = np.mod(keys, shards)
        rows = [(int(k), _pack(keys[shard == k])) for k in np.unique(shard)]
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([block // blocks] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "fold", "block", "packed"])

    def run(batches):
        now, sets, held, size, known = None, [], [], 0, 0
        for batch in batches:
            for block, data in zip(batch.column("__block").to_pylist(), batch.column("__text").to_pylist()):
                if held and (block != now or size >= CHUNK):
                    sets.append(pd.unique(np.concatenate(held)))
                    known += len(sets[-1])
                    held, size = [], 0
                if sets and (block != now or known >= HELD):
                    yield requests(now, sets)
                    sets, known = [], 0
                now = block
                held.append(grams(_unpacked_text(data) or ""))
                size += len(held[-1])
        if held or sets:
            yield requests(now, sets + held)

    return run


def _different_grams(batches):
    """Over rows (shard, fold, block, packed) in order of the first two: rows (fold, gram), each n-gram of a shard once."""
    now, held, size = None, [], 0

    def settle():
        keys = pd.unique(np.concatenate(held))
        for k in range(0, len(keys), 65_536):
            some = keys[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now[1], np.int32)), pa.array(some)], names=["fold", "gram"])

    for batch in batches:
        for shard, fold, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if held and (shard, fold) != now:
                yield from settle()
                held, size = [], 0
            now = shard, fold
            held.append(_unpack(data))
            size += len(held[-1])
            if size >= CHUNK:
                held = [pd.unique(np.concatenate(held))]
                size = 0
    if held:
        yield from settle()


def _answer(batches):
    """Over rows (shard, fold, block, packed, gram, lp) in order of the first three, looked-up n-grams of block -1 first: rows (block, packed, lps)."""
    now, held, keys, lps = None, [], None, None
    for batch in batches:
        shard, fold, block = (batch.column(k).to_numpy() for k in range(3))
        if not len(shard):
            continue
        cuts = np.nonzero((shard[1:] != shard[:-1]) | (fold[1:] != fold[:-1]) | ((block[1:] < 0) != (block[:-1] < 0)))[0] + 1
        for a, b in zip([0, *cuts], [*cuts, len(shard)]):
            if (shard[a], fold[a]) != now:
                now, held, keys = (shard[a], fold[a]), [], None
            part = batch.slice(a, b - a)
            if block[a] < 0:
                held.append((part.column(4).to_numpy(), part.column(5).to_numpy()))
                continue
            if keys is None:
                keys, lps = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(keys)
                keys, lps, held = keys[order], lps[order], []
            found = []
            for data in part.column(3).to_pylist():
                wanted = _unpack(data)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                if (keys[at] != wanted).any():
                    raise RuntimeError("a block asks for n-grams that weren't looked up")
                found.append(lps[at].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(found, pa.binary())], names=["block", "packed", "lps"])


def trusted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that some label calls good. Ids of labels are broadcast if they are few, else both sides are shuffled."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__good")).distinct()
    few = good.limit(MAX_BROADCAST_ROWS + 1).count()
    return docs.join(lookup_side(good, few), docs[id_col] == F.col("__good"), "left_semi")


class Classifier:
    """A fitted model with the mean and the threshold of each language."""

    def __init__(self, model: Model, means: dict, thresholds: dict, mean: float, threshold: float) -> None:
        self.model, self.means, self.thresholds, self.mean, self.threshold = model, means, thresholds, mean, threshold

    def judge(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep_text: bool = True) -> DataFrame:
        """docs with ``perplexity``, ``threshold`` and ``keep``; such columns of docs are replaced.

        Null texts count as empty; empty ones are kept. Languages
        without trusted documents, and null, have the threshold of all trusted
        documents.
        """
        scored = self.model.score(docs.drop("perplexity", "threshold", "keep").withColumn("__lang", F.col(lang_col).cast("string")), None, text_col, keep_text)
        mean = (F.col("__score.s") + PRIOR * _by("__lang", self.means, self.mean)) / (F.col("__score.n") + PRIOR)
        limit = _by("__lang", self.thresholds, self.threshold)
        keep = (F.col("__score.n") == 1) | (mean <= limit)
        return scored.withColumn("perplexity", F.exp(mean)).withColumn("threshold", F.exp(limit)).withColumn("keep", keep).drop("__score", "__lang")


#: Languages with a threshold of their own; rarer ones share that of all.
MOST_LANGUAGES = 500


def fit(texts: DataFrame) -> Model:
    """The models of (part, text), parts 0 and 1: fold 0 of all texts, fold 1 + k of those not in part k."""
    folds = F.explode(F.array(F.lit(0), F.lit(2) - F.col("part"))).alias("fold")
    return Model(count(texts).groupBy("part", "gram").agg(F.sum("n").alias("n")).select(folds, "gram", "n").groupBy("fold", "gram").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Fit the model and the thresholds on all trusted documents.

    Texts that are null aren't trained on. Without trusted documents the model
    is uniform and every document is kept. Where all trusted texts fall into
    one half, they are measured by the model of all. What is learnt is settled,
    so no shuffle of the training is on the disks when texts are judged.
    """
    with shuffles_removed(docs.sparkSession):
        return _train(docs, labels, id_col, text_col, lang_col)


def _train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> Classifier:
    good = trusted(docs, labels, id_col).where(F.col(text_col).isNotNull())
    plain = good.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    model = fit(plain.select(half.alias("part"), "text"))
    if not model.folds:
        return Classifier(model, {}, {}, 0.0, float("inf"))
    scored = reliable(model.score(plain, 1 + half, keep_text=False).select("lang", F.col("__score.s").alias("s"), F.col("__score.n").alias("n")))
    mean = F.sum("s") / F.sum("n")
    all_mean = scored.agg(mean.alias("m")).first()["m"]
    by = scored.groupBy("lang").agg(mean.alias("m"), F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(MOST_LANGUAGES).collect()
    means = {r["lang"]: r["m"] for r in by}
    shrunk = scored.withColumn("x", (F.col("s") + PRIOR * _by("lang", means, all_mean)) / (F.col("n") + PRIOR))
    limit = F.percentile_approx("x", QUANTILE, 100_000).alias("t")
    thresholds = {r["lang"]: r["t"] + MARGIN for r in shrunk.groupBy("lang").agg(limit, F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(MOST_LANGUAGES).collect()}
    return Classifier(model, means, thresholds, all_mean, shrunk.agg(limit).first()["t"] + MARGIN)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, lang, perplexity, threshold, keep), one for each row of docs, null ids and repeated rows included."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return train(plain, labels).judge(plain, keep_text=False)


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their columns."""
    judged = train(docs, labels).judge(docs.withColumns({f"__was_{c}": docs[c] for c in docs.columns if c in ("perplexity", "threshold", "keep")}))
    return judged.where("keep").select(*[F.col(f"__was_{c}").alias(c) if c in ("perplexity", "threshold", "keep") else c for c in docs.columns])
