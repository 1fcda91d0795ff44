"""SimHash near-duplicates by generalised pigeonhole search (operator 1).

A fingerprint has 64 bits. Correlated bits are grouped into parts; each part
gets a threshold of its own, chosen by dynamic programming on the estimated
number of candidates, such that the thresholds add up to ``distance - parts +
1``: two fingerprints within ``distance`` then agree to within the threshold in
at least one part. The parts are probed for shared values and every candidate
is verified over all 64 bits.

A value shared by more than ``bucket`` fingerprints is not compared in pairs.
The fingerprints under such values are probed as one part of 64 bits instead:
two codes differ in at most 2 bits exactly if they share a code within one bit
of each, and at most 65 codes lie within one bit of a code. That takes 65 rows
for each fingerprint, whatever the size of the group, and loses no link.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, Forest, map_batches, reliable, union_all
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 2
BUCKET = 1024
#: Fingerprints (at most about so many) by which parts and thresholds are chosen; they steer the cost, never the result.
PLAN_ROWS = 65_536
#: Ids of fingerprints all of whose documents have a null id begin here.
NO_ID = 1 << 62
_BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        size = len(words)
    n, ones = len(words) - size + 1, np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        end = min(n, start + _BLOCK)
        shingles = map(b" ".join, zip(*(words[start + k : end + k] for k in range(size))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.dtype("<u8"), end - start)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed long. Null texts count as empty."""
    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long", arrow)


def group_bits(codes: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits over parts of equal width, most correlated bits together."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    if len(bits) < 2:
        return [list(map(int, x)) for x in np.array_split(np.arange(64), parts)]
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).mean(axis=0))
    scale = np.where(spread > 0, spread, 1)
    near = np.abs(centred.T @ centred / len(bits)) / np.outer(scale, scale)
    left, out = set(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        rest = sorted(left)
        first = max(rest, key=lambda i: (near[i, rest].sum(), -i))
        part = [first]
        left.remove(first)
        while len(part) < width:
            best = max(sorted(left), key=lambda i: (near[i, part].sum(), -i))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (each from -1 up) adding up to ``total`` at least cost, by dynamic programming.

    ``costs[i][t + 1]`` is the cost of threshold t in part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for k, c in enumerate(part):
                t = k - 1
                if (done + t) not in new or cost + c < new[done + t][0]:
                    new[done + t] = (cost + c, [*chosen, t])
        best = new
    if total not in best:
        raise ValueError("no allocation of thresholds")
    return best[total]


def _values(codes: np.ndarray, bits: list[int]) -> np.ndarray:
    mask = np.uint64(sum(1 << b for b in bits))
    return codes & mask


def plan(codes: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts of bits with their thresholds, from a sample of codes that stands for n.

    The cost of a threshold is the rows it makes plus the candidate pairs that
    are expected to share a row's value.
    """
    grown = (n / max(1, len(codes))) ** 2
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in (2, 3, 4):
        groups = group_bits(codes, parts)
        costs = []
        for bits in groups:
            values = _values(codes, bits)

            def pairs(v: np.ndarray) -> float:
                c = np.unique(v, return_counts=True)[1].astype(np.float64)
                return float((np.minimum(c, BUCKET) * (c - 1)).sum() / 2)

            same = pairs(values)
            near = same + sum(pairs(values & ~np.uint64(1 << b)) - same for b in bits)
            costs.append([0.0, n + grown * same / 50, (1.0 + len(bits)) * n + grown * near / 50])
        cost, chosen = allot(costs, distance - parts + 1)
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, chosen)))
    assert best
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _probes(code: Column, parts: list[tuple[list[int], int]]) -> Column:
    """All (part, value) keys of a code: its values, and for a threshold of 1 those a bit away."""
    keys = []
    for k, (bits, threshold) in enumerate(parts):
        if threshold < 0:
            continue
        value = code.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        flips = [0] + ([1 << b for b in bits] if threshold else [])
        keys += [F.struct(F.lit(k).alias("part"), value.bitwiseXOR(F.lit(_signed(f)).cast("long")).alias("value")) for f in flips]
    return F.array(*keys)


def _compare(batches):
    """Over rows sorted by (part, value): links (a, b) from each node to the smallest it is tied to in its bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    kept: list[pa.RecordBatch] = []
    out = Forest()

    def settle(fps: np.ndarray, reps: np.ndarray) -> None:
        n = len(fps)
        if n < 2:
            return
        if n > 8 * BUCKET:
            raise RuntimeError("a bucket is larger than was counted")
        label = np.arange(n)
        for i in range(n - 1):
            near = np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= DISTANCE)[0]
            if len(near) and (label[near + i + 1] != label[i]).any():
                met = np.unique(np.append(label[near + i + 1], label[i]))
                label[np.isin(label, met)] = met[0]
        for i in np.nonzero(label != np.arange(n))[0]:
            out.join(int(reps[i]), int(reps[label[i]]))

    carry: tuple | None = None
    for batch in batches:
        part, value = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        fp, rep = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        if carry is not None:
            part, value, fp, rep = (np.concatenate(x) for x in zip(carry, (part, value, fp, rep)))
        if not len(part):
            continue
        cuts = np.nonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1]))[0] + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(part)]]))
        for k in np.nonzero(sizes[:-1] > 1)[0]:
            s = slice(starts[k], starts[k] + sizes[k])
            settle(fp[s].view(np.uint64), rep[s])
        last = starts[-1]
        carry = (part[last:], value[last:], fp[last:], rep[last:])
    if carry is not None:
        settle(carry[2].view(np.uint64), carry[3])
    links = out.links()
    for k in range(0, len(links), 65_536):
        some = links[k : k + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([y for _, y in some], pa.int64())], schema=schema)


def _balls(codes: DataFrame) -> DataFrame:
    """Links among codes within 2 bits, through the codes within one bit of each."""
    flips = F.array(*[F.lit(_signed(f)).cast("long") for f in [0] + [1 << k for k in range(64)]])
    spread = codes.select("rep", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
    met = spread.groupBy("mid").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    return met.select(F.explode("reps").alias("a"), F.array_min("reps").alias("b")).where("a <> b").distinct()


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Rows (fp, component) for each distinct fingerprint of (doc_id, fp).

    component is the smallest doc_id of any document reachable through
    fingerprints that differ in at most 2 bits; null where all of them are null.
    """
    classes = reliable(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.shiftrightunsigned("fp", 2)).alias("rep")))
    n = classes.count()
    share = max(1, -(-n // PLAN_ROWS))
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan(sample, n)
    keys = classes.select("fp", "rep", F.explode(_probes(F.col("fp"), parts)).alias("key")).select("key.part", "key.value", "fp", "rep")
    crowded = reliable(keys.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("part", "value"))
    many = crowded.limit(MAX_BROADCAST_ROWS + 1).count()
    links = []
    if many:
        side = F.broadcast(crowded) if many <= MAX_BROADCAST_ROWS else crowded
        hot = keys.join(side, ["part", "value"], "left_semi").select("fp", "rep").distinct()
        links.append(_balls(hot))
        keys = keys.join(side, ["part", "value"], "left_anti")
    dealt = keys.select("part", "value", "fp", "rep").repartition("part", "value").sortWithinPartitions("part", "value", "fp")
    links.append(dealt.mapInArrow(_compare, "a long, b long"))
    tied = connected_components(union_all(links))
    found = classes.join(tied, classes["rep"] == tied["node"], "left").select("fp", F.coalesce("root", "rep").alias("c"))
    return found.select("fp", F.when(F.col("c") < NO_ID, F.col("c")).alias("component"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id
    that is reachable through fingerprints differing in at most 2 bits.

    Null texts count as empty; empty texts have fingerprint zero and are linked
    like any other. Rows with a null doc_id take part and get the smallest
    non-null id of their component, null if it has none. Repeated rows are
    kept. Other columns of docs are ignored. An empty table gives an empty one.
    """
    fps = reliable(fingerprints(docs, id_col, text_col))
    linked = link_fingerprints(fps)
    out = fps.join(linked, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

