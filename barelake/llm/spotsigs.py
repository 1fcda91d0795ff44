"""Document fingerprints by spot signatures (operator 9).

A common word is an anchor; the anchor with the next content words after it is
a spot signature. A document's fingerprint stands for its set of signatures;
likeness is the Jaccard similarity of two sets. Sets of sizes a <= b can't
reach similarity t unless a >= t * b, so near duplicates are looked for among
neighbouring ranges of set sizes only.
"""

from __future__ import annotations

import hashlib
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, lookup_side, map_batches, reliable
from .components import connected_components

#: Content words in a chain after its anchor.
CHAIN = 2
#: Common words of four languages.
COMMON = """
a an and are as at be but by for from had has have he in is it its not of on or she that the their they this to was were what which will with you
aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sein sich sie sind über um und von vor war wie wird zu zum zur
al con como de del el ella en entre es esta este fue ha hay la las le lo los más me muy no nos o para pero por que se sin sobre son su sus también un una y ya
au aux avec ce ces cette dans des du elle est et il ils je la les leur mais nous on ou par pas plus pour qui sa ses son sont sur une vous
的 了 是 在 不 一 有 和 人 这 我 他 也 就 與 為 の は を に が と で も た し て か な น ร ก อ า เ ນ ກ ອ န က အ ន រ ក
"""
#: Letters of scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han): each is a word.
_UNSPACED = "\u0e01-\u0e4e\u0e81-\u0ece\u1000-\u109f\u1780-\u17d3\u3041-\u309f\u30a1-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
#: Punctuation beyond ASCII, which separates words.
_MARKS = "\u2000-\u206f\u3000-\u3003\u3008-\u301f\u30fb\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_WIDE = re.compile(f"[{_UNSPACED}{_MARKS}]")
_LETTER = re.compile(f"([{_UNSPACED}])")
_MARK = re.compile(f"[{_MARKS}]+")
_ANCHORS = np.array(sorted({crc32(w.encode()) for w in COMMON.split()}), np.uint32)
_SPACES = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words of at most this many bytes are anchors too, which covers languages without a list.
_SHORT = 2
_NONE = np.empty(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(text: str | None) -> np.ndarray:
    """The sorted distinct signatures of a text, as unsigned 64-bit hashes.

    Letters of scripts that are written without spaces are words of their own.
    A text with words but no signature has one for the whole sequence of its
    words, a text with characters but no words one for its characters; an empty
    or null text has none.
    """
    if not text:
        return _NONE
    if not text.isascii() and _WIDE.search(text):
        text = _LETTER.sub(r" \1 ", _MARK.sub(" ", text)) if _LETTER.search(text) else _MARK.sub(" ", text)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_SPACES).split()
    n = len(words)
    if n > CHAIN:
        ids = np.fromiter(map(crc32, words), np.uint32, n)
        sizes = np.fromiter(map(len, words), np.int32, n)
        place = np.minimum(np.searchsorted(_ANCHORS, ids), len(_ANCHORS) - 1)
        anchor = (_ANCHORS[place] == ids) | (sizes <= _SHORT)
        content = ids[~anchor].astype(np.uint64)
        first = np.cumsum(~anchor)[anchor]
        ok = first + CHAIN <= len(content)
        if ok.any():
            first, h = first[ok], ids[anchor][ok].astype(np.uint64)
            for k in range(CHAIN):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + content[first + k])
            return np.unique(h)
    whole = b" ".join(words) or raw
    return np.array([int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")], np.uint64)


def fingerprint(sigs: np.ndarray) -> str:
    """The number of signatures and a 128-bit hash of the sorted set, in hex; equal sets have equal fingerprints."""
    return f"{len(sigs):x}-{hashlib.blake2b(sigs.astype('<u8').tobytes(), digest_size=16).hexdigest()}"


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without comparing them if their sizes rule out ``least``. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many of the next one's first (or all of them)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _walk(batches):
    """Over rows (guest, doc_id, text) of one range in order: each document against the one after it; the first guest ends the range."""
    before: tuple[int | None, str, np.ndarray] | None = None
    ended = False
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            out: dict[str, list] = {f.name: [] for f in _ARROW}
            for guest, doc, text in zip(*(c.to_pylist() for c in part.columns)):
                if ended:
                    break
                ended = guest
                sigs = signatures(text)
                if before is not None:
                    own, body, mine = before
                    changed = edited(body, text)
                    theirs = signatures(changed)
                    row = (own, len(body), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(mine), fingerprint(theirs), likeness(mine, theirs), likeness(mine, sigs))
                    for column, v in zip(out.values(), row):
                        column.append(v)
                before = (doc, text, sigs)
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW)


#: Ids looked at, in the mean, to set one edge between ranges.
_SAMPLED = 64
#: Ranges at most, which bounds what the driver holds; beyond it ranges hold more documents each.
MOST_RANGES = 100_000
_LOWEST = -(1 << 63)


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 4096) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of docs.

    The next document is the one with the next higher id, after the last the
    first. Null texts count as empty. Rows with a null id come before all
    others; rows of equal id follow each other by their texts. Other columns are
    ignored. An empty table gives an empty one; a single document follows
    itself.

    Texts are shuffled once, into ranges of ids of about ``rows`` documents,
    one range to a task. The first row of each range goes to the end of the
    range before it as well. The driver holds one id for each range, and about
    64 ids for each to set the edges by; there are at most MOST_RANGES.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("o"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = plain.count()
    parts = max(1, min(-(-n // rows), MOST_RANGES))
    share = max(1, n // (_SAMPLED * parts))
    sample = np.sort(plain.select("o").where(F.pmod(F.xxhash64("o"), F.lit(share)) == 0).toPandas()["o"].to_numpy(np.int64)) if parts > 1 else np.empty(0, np.int64)
    edges = np.unique(sample[[len(sample) * k // parts for k in range(1, parts)]]) if len(sample) else sample
    sent = spark.sparkContext.broadcast(edges)

    @F.pandas_udf("int")
    def place(ids):
        return ids.map(lambda x: 0) if not len(sent.value) else type(ids)(np.searchsorted(sent.value, ids.to_numpy(np.int64), "right").astype(np.int32))

    ids = plain.select("o").groupBy(place("o").alias("r")).agg(F.min("o").alias("o")).orderBy("r").collect()
    ranges = [x["r"] for x in ids]
    ahead = [(x["o"], ranges[k - 1]) for k, x in enumerate(ids)]
    guests = plain.join(lookup_side(spark.createDataFrame(ahead, "o long, r int"), len(ahead)), "o").select("r", F.lit(True).alias("guest"), "o", "text")
    hosts = plain.select(place("o").alias("r"), F.lit(False).alias("guest"), "o", "text")
    both = hosts.unionByName(guests).repartitionById(len(edges) + 1, F.col("r")).sortWithinPartitions("guest", "o", "text")
    return both.select("guest", F.when(F.col("o") != _LOWEST, F.col("o")).alias("doc_id"), "text").mapInArrow(_walk, _SCHEMA)


THRESHOLD = 0.8
#: Sets compared with each other in one task; larger buckets are dealt out by pairs of blocks.
BLOCK = 256


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, sigs), one for each row of docs."""
    arrow = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("sigs", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> dict:
        sets = [signatures(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fingerprint": [fingerprint(s) for s in sets], "sigs": [s.view(np.int64) for s in sets]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fingerprint string, sigs array<long>", arrow, rows=256)


def _alike(threshold: float):
    """mapInArrow function over rows (sig, part, i, j, block, own, rep, sigs) in order of the first four: links of a forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        forest, now, rows = Forest(), None, []

        def settle() -> None:
            _, _, i, j = now
            first, second = [r for r in rows if r[0] == i], [r for r in rows if r[0] == j]
            for x, (_, own, rep, sigs) in enumerate(first):
                for _, other_own, other, theirs in second[x + 1 :] if i == j else second:
                    if (own or other_own) and rep != other and forest.find(rep) != forest.find(other) and likeness(sigs, theirs, threshold) >= threshold:
                        forest.join(rep, other)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:7]]
            for k, row in enumerate(zip(*columns)):
                if row[:4] != now:
                    if len(rows) > 1:
                        settle()
                    now, rows = row[:4], []
                rows.append((*row[4:7], np.sort(batch.column(7)[k].values.to_numpy().view(np.uint64))))
        if len(rows) > 1:
            settle()
        links = forest.links()
        for k in range(0, len(links), 65_536):
            some = links[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.int64()), pa.array([b for _, b in some], pa.int64())], schema=schema)

    return run


def spot_components(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): near duplicates by the likeness of their signatures; all links of at least ``threshold`` count.

    Equal sets are one class. A set's rarest signatures, as many as a set that
    is alike can't all lack, are its keys. Sets meet under a key within one
    range of sizes or in neighbouring ones, a range reaching from s to
    s / threshold. A key that many sets share is dealt out by pairs of blocks
    of its sets, and a block gives no more links than it has sets.

    Null texts count as empty; empty ones are one class. Rows with a null id
    get the smallest id of their component, null if all its rows have none.
    """
    sets = reliable(signature_sets(docs, id_col, text_col))
    no_id = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("fingerprint"), 2)
    named = sets.groupBy("fingerprint").agg(F.coalesce(F.min("doc_id"), no_id).alias("rep"), F.first("sigs").alias("sigs"))
    classes = reliable(named.withColumn("n", F.size("sigs")))
    rarity = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    keyed = classes.select("rep", "n", F.explode("sigs").alias("sig")).join(rarity, "sig")
    ordered = keyed.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    needed = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int")
    prefix = ordered.select("rep", "n", F.explode(F.slice("s", F.lit(1), needed)).alias("k")).where("k.df > 1").select("rep", "n", "k.sig")
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(threshold)))).cast("int")
    spots = prefix.withColumn("p", F.explode(F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct((part + 1).alias("part"), F.lit(False).alias("own"))))).select("rep", "sig", "p.part", "p.own")
    sizes = spots.groupBy("sig", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1")
    placed = spots.join(sizes, ["sig", "part"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = placed.join(classes.select("rep", "sigs"), "rep").select("sig", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "rep", "sigs")
    dealt = full.repartition("sig", "part", "i", "j").sortWithinPartitions("sig", "part", "i", "j", "rep")
    tied = connected_components(dealt.mapInArrow(_alike(threshold), "a long, b long"))
    found = classes.join(tied, classes["rep"] == tied["node"], "left").select("fingerprint", F.coalesce("root", "rep").alias("c"))
    return sets.join(found, "fingerprint").select("doc_id", "fingerprint", F.when(F.col("c") < (1 << 62), F.col("c")).alias("component_id"))
