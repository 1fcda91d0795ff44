"""Near-duplicate texts at a Jaccard similarity, by wide SimHash fingerprints (operator 1 in its general form).

A text is the set of its shingles of words. Its fingerprint has 512 bits; texts
of similarity s differ in about ``acos(2 s / (1 + s)) / pi`` of them. Correlated
bits are grouped into parts, and each part gets a threshold of its own (or is
left out) by dynamic programming: the rows and candidate pairs, estimated from
a sample of fingerprints and grown to all, are as few as the wished recall of a
pair just at the similarity allows. All texts are probed for values within the
thresholds; candidates are verified over all 512 bits. Pairs far within the
radius are linked; the rest are compared by their texts' whole sets of shingles.

The sample steers widths and thresholds, so the cost and not what is compared:
every text is probed, and every pair of a bucket is verified whose sizes allow
the similarity. A bucket's links leave it as a spanning forest of the nearest
pairs, never as all pairs. A bucket of more than ``BUCKET`` texts is dealt into
blocks; what the blocks and other buckets unite needs no more comparing, and
only texts outside the bucket's largest component are compared with all of it.
The same holds for groups of candidates once the forest's pairs are verified, so
that a link isn't lost where the forest held a pair that proved to be none.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, Forest, giving_back, lookup_side, map_batches, reliable
from .components import connected_components
from .simhash import NO_ID, SEED

SHINGLE = 5
SIMILARITY = 0.8
#: Wished probability that a pair just at the similarity shares a probed value.
RECALL = 0.995
BITS = 512
#: Pairs are candidates up to so many standard deviations above the distance that the similarity makes likely, and linked without comparing sets up to so many below it.
SLACK = 2.5
SURE = 4.5
BUCKET = 2048
#: Links whose components are found without exchanges.
FEW_LINKS = 100_000
#: Texts of a block where sets are compared.
BLOCK = 2048
#: Rows of buckets that are compared at once.
CHUNK = 1 << 16
PLAN_ROWS = 4096
WIDTHS = (6, 8, 9, 10, 11, 12, 13, 14, 16, 18, 20, 24, 28, 32)
#: Comparing so many pairs costs as much as one more row to probe.
PAIRS_A_ROW = 100.0
_LANES = np.random.default_rng(SEED).integers(1, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSTING = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("fp", pa.binary())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])


def shingles(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles: words split at ASCII white space, A-Z in lower case; fewer words than size are one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    joined = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, itertools.repeat(seed)), np.uint64, len(words) - size + 1))


def fingerprint(hashes: np.ndarray) -> bytes:
    """64 bytes: a bit is set if it is set in over half of the mixed hashes."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 4080):
        x = hashes[start : start + 4080, None] * _LANES
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def differing(similarity: float) -> float:
    """Expected share of differing bits of two sets of one size at a Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def radii(similarity: float) -> tuple[int, int]:
    """The distance up to which a pair is linked as it is, and that up to which it is a candidate."""
    p = differing(similarity)
    spread = math.sqrt(BITS * p * (1 - p))
    return max(0, math.floor(BITS * p - SURE * spread)), math.ceil(BITS * p + SLACK * spread)


def hit(width: int, threshold: int, p: float) -> float:
    """Probability that a part's values differ in at most ``threshold`` bits."""
    return sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(threshold + 1))


def _bits(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), "<u8").reshape(-1, BITS // 64)


def correlations(bits: np.ndarray) -> np.ndarray:
    if len(bits) < 2:
        return np.zeros((BITS, BITS))
    centred = bits - bits.mean(axis=0, dtype=np.float64)
    spread = np.sqrt((centred**2).mean(axis=0))
    scale = np.where(spread > 0, spread, 1)
    return np.abs(centred.T @ centred / len(bits)) / np.outer(scale, scale)


def group_bits(near: np.ndarray, width: int) -> list[np.ndarray]:
    """As many parts of ``width`` bits as there are, most correlated bits together."""
    left, out = np.ones(BITS, bool), []
    for _ in range(BITS // width):
        part = [int(np.argmax(np.where(left, near[:, left].sum(axis=1), -1)))]
        left[part[0]] = False
        pull = near[part[0]].copy()
        while len(part) < width:
            best = int(np.argmax(np.where(left, pull, -1)))
            part.append(best)
            left[best] = False
            pull += near[best]
        out.append(np.sort(np.array(part)))
    return out


def allot(costs: list[list[float]], gains: list[list[float]], need: float, units: int = 400) -> tuple[float, list[int]] | None:
    """Thresholds (from -1, the part is left out) whose gains add up to ``need`` at least cost, by dynamic programming; None if they can't.

    ``costs[i][t + 1]`` and ``gains[i][t + 1]`` belong to threshold t in part i; gains are rounded down to units of need.
    """
    best = np.full(units + 1, np.inf)
    best[0] = 0
    chosen = []
    for cost, gain in zip(costs, gains):
        new, pick = np.full(units + 1, np.inf), np.zeros((units + 1, 2), np.int64)
        for k, (c, g) in enumerate(zip(cost, gain)):
            at = np.minimum(units, np.arange(units + 1) + int(g / need * units))
            for i in np.nonzero(best + c < np.inf)[0]:
                if best[i] + c < new[at[i]]:
                    new[at[i]], pick[at[i]] = best[i] + c, (i, k)
        best = new
        chosen.append(pick)
    if best[units] == np.inf:
        return None
    out, at = [], units
    for pick in reversed(chosen):
        at, k = pick[at]
        out.append(int(k) - 1)
    return float(best[units]), out[::-1]


def plan(bits: np.ndarray, n: int, p: float, recall: float = RECALL) -> list[tuple[np.ndarray, int]]:
    """Parts of bits with their thresholds, from a sample of fingerprints that stands for n.

    The cost of a threshold is the rows it makes plus the candidate pairs that
    are expected to share a value.
    """
    near, grown, need = correlations(bits), (n / max(1, len(bits))) ** 2, -math.log(1 - recall)
    best: tuple[float, list[tuple[np.ndarray, int]]] | None = None

    def pairs(v: np.ndarray, width: int) -> float:
        c = np.unique(v, return_counts=True)[1].astype(np.float64)
        return max(float((c * (c - 1)).sum() / 2) * grown, n * n / 2 / 2.0**width)

    for width in WIDTHS:
        groups, costs = group_bits(near, width), []
        for part in groups:
            v = bits[:, part].astype(np.int64) @ (1 << np.arange(width))
            same = pairs(v, width)
            by_bit = [pairs(v & ~(1 << b), width - 1) for b in range(width)] if n > 1 << 20 else [2 * same] * width  # small tables never pay for flips
            one = same + sum(x - same for x in by_bit)
            two = one + math.comb(width, 2) * same
            costs.append([0.0, n + same / PAIRS_A_ROW, (1 + width) * n + one / PAIRS_A_ROW, (1 + width + math.comb(width, 2)) * n + two / PAIRS_A_ROW])
        gains = [[0.0] + [-math.log(1 - hit(width, t, p)) for t in (0, 1, 2)]] * len(groups)
        found = allot(costs, gains, need)
        if found and (best is None or found[0] < best[0]):
            best = found[0], [(part, t) for part, t in zip(groups, found[1]) if t >= 0]
    if best is None:
        raise ValueError("no allocation of thresholds reaches the recall")
    return best[1]


def _postings(parts: list[tuple[np.ndarray, int]]):
    """mapInArrow function from (rep, n, fp) to a row (key, rep, n, fp) for each value within the thresholds."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = _bits(batch.column(2).to_pylist())
            for k, (part, threshold) in enumerate(parts):
                width = len(part)
                v = bits[:, part].astype(np.int64) @ (1 << np.arange(width))
                for t in range(threshold + 1):
                    for flipped in itertools.combinations(range(width), t):
                        key = v ^ sum(1 << b for b in flipped) | k << 40
                        yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1), batch.column(2)], schema=_POSTING)

    return run


def spanning(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a minimum spanning forest over n nodes; ties go to the earlier edge."""
    order = np.lexsort((np.arange(len(d)), d))
    u, v, label, out = u[order], v[order], np.arange(n), []
    forest = Forest()
    left = np.arange(len(u))
    while len(left):
        lu, lv = label[u[left]], label[v[left]]
        left = left[lu != lv]
        if not len(left):
            break
        best = np.full(n, len(u), np.int64)
        np.minimum.at(best, label[u[left]], left)
        np.minimum.at(best, label[v[left]], left)
        picked = np.unique(best[best < len(u)])
        out.append(picked)
        for a, b in zip(label[u[picked]].tolist(), label[v[picked]].tolist()):
            forest.join(a, b)
        moved = np.array([forest.find(x) for x in forest.up], np.int64)
        to = np.arange(n)
        to[np.fromiter(forest.up, np.int64, len(forest.up))] = moved
        label = to[label]
    return order[np.concatenate(out)] if out else np.empty(0, np.int64)


def _compare(radius: int, similarity: float):
    """mapInArrow function over rows (key, block, n, rep, root, fp) in order of the first three: edges (a, b, d) of a forest over the candidates of each (key, block) whose roots differ."""

    def settle(group: np.ndarray, n: np.ndarray, rep: np.ndarray, root: np.ndarray, fp: np.ndarray):
        us, vs, ds, k = [], [], [], 1
        active = np.arange(len(n) - 1)
        while len(active):
            active = active[active + k < len(n)]
            active = active[(group[active] == group[active + k]) & (n[active] >= similarity * n[active + k])]
            for s in range(0, len(active), 1 << 16):
                at = active[s : s + (1 << 16)]
                at = at[root[at] != root[at + k]]
                d = np.bitwise_count(fp[at] ^ fp[at + k]).sum(axis=1, dtype=np.int32)
                near = d <= radius
                if near.any():
                    us.append(at[near])
                    vs.append(at[near] + k)
                    ds.append(d[near])
            k += 1
        if us:
            u, v, d = np.concatenate(us), np.concatenate(vs), np.concatenate(ds)
            kept = spanning(u, v, d, len(n))
            a, b = rep[u[kept]], rep[v[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[kept])], schema=_EDGE)

    def run(batches):
        held: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append((*(batch.column(k).to_numpy() for k in range(5)), _words(batch.column(5).to_pylist())))
            if held and (batch is None or sum(len(x[0]) for x in held) >= CHUNK):
                key, block, n, rep, root, fp = (np.concatenate(c) for c in zip(*held))
                starts = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
                group = np.cumsum(starts)
                end = len(key) if batch is None else int(np.nonzero(starts)[0][-1])
                held = [tuple(c[end:] for c in (key, block, n, rep, root, fp))] if end < len(key) else []
                if end:
                    yield from settle(group[:end], n[:end], rep[:end], root[:end], fp[:end])

    return run


def _compared(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    rows = rows.select("key", F.col("block").cast("long").alias("block"), "n", "rep", "root", "fp")
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "n")
    return dealt.mapInArrow(giving_back(_compare(radius, similarity)), "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def _rooted(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of a node."""
    known = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(known, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", node)).drop("__node", "__root")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, rep, root, ..., low, inner) of keys with several roots in pairs of blocks, such that every row outside a key's largest root (low) meets every row of the key (not low; inner in the largest root)."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    giants = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("giant"), F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most")
    rows = rows.join(giants, "key").withColumn("wide", F.ceil(F.col("all") / size)).withColumn("high", F.ceil((F.col("all") - F.col("most")) / size))
    low = rows.where("root <> giant").withColumn("i", F.pmod(F.xxhash64("rep"), "high")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)))
    whole = rows.withColumn("j", F.pmod(F.xxhash64("rep"), "wide")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)))
    both = low.withColumn("low", F.lit(True)).unionByName(whole.withColumn("low", F.lit(False)))
    return both.withColumn("inner", F.col("root") == F.col("giant")).withColumn("block", F.col("i") * F.col("wide") + F.col("j")).drop("i", "j", "wide", "high", "giant", "most")


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, fp): the number of distinct shingles and the fingerprint. Null texts count as empty."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n long, fp binary", arrow)


def _classes(fps: DataFrame) -> DataFrame:
    """Rows (n, fp, least, rep) of the different sets: the smallest id, null if there is none, and a number that is no other's, the id where it can be."""
    classes = reliable(fps.groupBy("n", "fp").agg(F.min("doc_id").alias("least")))
    own = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("n", "fp"), 2)
    shared = classes.groupBy("least").agg(F.count("*").alias("c")).where("c > 1 AND least IS NOT NULL").select(F.col("least").alias("__shared"))
    several = reliable(shared)
    if not several.limit(1).count():
        return classes.withColumn("rep", F.coalesce("least", own))
    marked = classes.join(several, F.col("least") == F.col("__shared"), "left")
    return reliable(marked.withColumn("rep", F.when(F.col("__shared").isNull(), F.coalesce("least", own)).otherwise(own)).drop("__shared"))


def _candidates(classes: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (a, b, d) between classes (rep, n, fp) up to the radius, and the components (node, root) of those that need no more comparing."""
    sure, radius = radii(similarity)
    n = classes.count()
    share = max(1, -(-n // PLAN_ROWS))
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").toPandas()["fp"]
    parts = plan(_bits([bytes(x) for x in sample]), n, differing(similarity), recall)
    keys = classes.where("n > 0").select("rep", "n", "fp").mapInArrow(giving_back(_postings(parts)), "key long, rep long, n long, fp binary").withColumn("root", F.col("rep"))
    crowded = reliable(keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET))
    many = crowded.limit(MAX_BROADCAST_ROWS + 1).count()
    rows = keys.withColumn("block", F.lit(0).cast("long"))
    if many:
        side = lookup_side(crowded, many)
        hot = keys.join(side, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BUCKET))).drop("size")
        rows = rows.join(side, "key", "left_anti").unionByName(hot)
    edges = reliable(_compared(rows, radius, similarity))
    roots = reliable(connected_components(edges.where(F.col("d") <= sure), few=FEW_LINKS))
    if many:
        edges = reliable(edges.unionByName(_compared(_dealt(_rooted(hot.drop("block", "root"), roots, "rep", "root"), BUCKET), radius, similarity)).groupBy("a", "b").agg(F.min("d").alias("d")))
        roots = reliable(connected_components(edges.where(F.col("d") <= sure), few=FEW_LINKS))
    return edges, roots


def _packed(text: str | None) -> bytes:
    return zstandard.compress((text or "").encode("utf-8", "surrogatepass"), 3)


def _texts(wanted: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (rep, n, fp, packed) of the wanted classes (n, fp, least, rep) with a text of each."""
    few = wanted.limit(MAX_BROADCAST_ROWS + 1).count()
    ids = lookup_side(wanted.select(F.col("least").alias("__id")).distinct(), few)
    found = docs.join(ids, F.col(id_col).cast("long") == F.col("__id"), "left_semi")
    if wanted.where("least IS NULL").limit(1).count():
        found = found.union(docs.where(F.col(id_col).isNull()))
    arrow = pa.schema([("n", pa.int64()), ("fp", pa.binary()), ("packed", pa.binary())])

    def pack(batch: pa.RecordBatch) -> dict:
        texts = batch.column(0).to_pylist()
        sets = [shingles(t, size) for t in texts]
        return {"n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "packed": [_packed(t) for t in texts]}

    packed = map_batches(found.select(F.col(text_col).cast("string").alias("text")), pack, "n long, fp binary, packed binary", arrow, rows=256)
    return reliable(wanted.join(packed.groupBy("n", "fp").agg(F.min("packed").alias("packed")), ["n", "fp"]).select("rep", "n", "fp", "packed"))


def _opened(size: int):
    @functools.lru_cache(1024)
    def opened(data: bytes) -> np.ndarray:
        return shingles(zstandard.decompress(data).decode("utf-8", "surrogatepass"), size)

    return opened


def _verified(edges: DataFrame, known: DataFrame, similarity: float, size: int) -> DataFrame:
    """The edges (a, b) whose texts' sets have the similarity."""
    first = edges.join(known.select(F.col("rep").alias("a"), F.col("packed").alias("one")), "a")
    both = first.join(known.select(F.col("rep").alias("b"), F.col("packed").alias("two")), "b").select("a", "b", "one", "two")

    def run(batches):
        opened = _opened(size)
        for batch in batches:
            good = [jaccard(opened(x.as_py()), opened(y.as_py())) >= similarity for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(giving_back(run), "a long, b long")


def _settled(known: DataFrame, groups: DataFrame, roots: DataFrame, radius: int, similarity: float, size: int) -> DataFrame:
    """Links (a, b) between components of a group of candidates: the spanning forest may have held a pair that is none where another is one.

    All texts outside a group's largest component are compared with the whole
    group, in pairs of blocks, by their fingerprints and then by their sets.
    """
    placed = _rooted(groups.select(F.col("node").alias("rep"), F.col("root").alias("key")), roots, "rep", "root")
    rows = _dealt(placed, BLOCK).where("all > 2").join(known, "rep")
    dealt = rows.select("key", "block", "n", "rep", "root", "fp", "packed", "low", "inner").repartition("key", "block").sortWithinPartitions("key", "block", "n")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(rows: list[tuple]):
        opened, forest = _opened(size), Forest()
        n, rep, root, low, inner = (np.array([r[k] for r in rows]) for k in (2, 3, 4, 7, 8))
        fp = _words([r[5] for r in rows])
        for k in range(len(rows) - 1):
            last = int(np.searchsorted(n, n[k] / similarity + 1e-9, "right"))
            near = np.arange(k + 1, last)
            # A pair of two low rows is compared once, where the smaller one is low.
            once = ~low[near] & (inner[near] | (rep[k] < rep[near])) if low[k] else low[near] & (inner[k] | (rep[near] < rep[k]))
            near = near[once & (root[near] != root[k])]
            for m in near[np.bitwise_count(fp[near] ^ fp[k]).sum(axis=1, dtype=np.int32) <= radius].tolist():
                if forest.find(int(root[k])) != forest.find(int(root[m])) and jaccard(opened(rows[k][6]), opened(rows[m][6])) >= similarity:
                    forest.join(int(root[k]), int(root[m]))
                    yield min(int(rep[k]), int(rep[m])), max(int(rep[k]), int(rep[m]))

    def run(batches):
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in itertools.groupby(every, key=lambda r: r[:2]):
            links = list(settle(list(group)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=schema)

    return dealt.mapInArrow(giving_back(run), "a long, b long")


def near_components(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, component_id), one for each row of docs.

    component_id: the smallest doc_id reachable through pairs of texts whose
    sets of ``size``-word shingles have at least the similarity.

    Null texts count as empty; texts without words are one class and link with
    no others. Rows with a null doc_id take part and get the smallest non-null
    id of their component, null if it has none. Repeated rows are kept. Other
    columns of docs are ignored. An empty table gives an empty one.
    """
    fps = reliable(fingerprints(docs, size, id_col, text_col))
    classes = _classes(fps)
    edges, roots = _candidates(classes, similarity, recall)
    sure, radius = radii(similarity)
    tied = edges.where(F.col("d") <= sure).select("a", "b")
    apart = _rooted(_rooted(edges.where(F.col("d") > sure), roots, "a", "ra"), roots, "b", "rb").where("ra <> rb")
    apart = reliable(apart.select("a", "b"))
    if apart.limit(1).count():
        groups = connected_components(edges, few=FEW_LINKS)
        groups = reliable(groups.union(groups.select("root", "root").distinct()))
        doubtful = apart.join(groups, F.col("a") == F.col("node")).select("root").distinct()
        groups = groups.join(doubtful, "root", "left_semi")
        known = _texts(reliable(classes.join(groups, F.col("rep") == F.col("node"), "left_semi")), docs, size, id_col, text_col)
        tied = reliable(tied.union(_verified(apart, known, similarity, size)))
        roots = reliable(connected_components(tied, few=FEW_LINKS))
        more = reliable(_settled(known, groups, roots, radius, similarity, size))
        if more.limit(1).count():
            roots = connected_components(tied.union(more), few=FEW_LINKS)
    rooted = _rooted(classes, roots, "rep", "c")
    ids = rooted.groupBy("c").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(ids, "c").select("n", "fp", "component_id"), ["n", "fp"]).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that aren't the smallest id of their component.

    Rows with a null id stay. All rows of an id that is the smallest of some component stay.
    """
    found = near_components(docs, similarity, size, id_col=id_col, text_col=text_col).where("doc_id IS NOT NULL")
    gone = reliable(found.groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("kept")).where("NOT kept").select(F.col("doc_id").alias("__gone")))
    return docs.join(lookup_side(gone, gone.limit(MAX_BROADCAST_ROWS + 1).count()), docs[id_col] == F.col("__gone"), "left_anti")
