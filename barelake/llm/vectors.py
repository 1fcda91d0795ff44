"""Near-duplicate vectors by sorted projection passes (operator 3).

Equal vectors are one class from the start. In each pass a class gets a sort
key of random sign bits, concatenated; classes are ordered by it and each is
compared with a bounded window of neighbours. Pairs at or above the threshold
unite across passes into components. Besides, all vectors of a cell, whose keys
share their first bits, are compared, in blocks dealt over the cluster. A pair
at the threshold shares them in some pass with the wished probability, however
vectors are spread; how many bits, and so passes, is chosen by the measured
sizes of cells, and steers the cost only.

Members of a component are then compared with each other in full, in blocks
that are dealt over the cluster, which counts every link of a dense group that
windows can't hold. Only counts leave a block, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, reliable
from .components import connected_components

THRESHOLD = 0.95
WINDOW = 48
#: Wished probability that a pair just at the threshold is met in some pass.
RECALL = 0.995
BITS = 62
BLOCK = 512
SEED = 42


def passes(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes over n classes: a pass meets a pair if it shares the bits that leave a window's worth of classes."""
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(1.0, math.log2(max(2, n) / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def cell_passes(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has shared its first bits in one, with the wished probability."""
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - (1 - math.acos(threshold) / math.pi) ** bits)))


def _cell_bits(classes: DataFrame, n: int, threshold: float, window: int, recall: float, seed: int) -> int:
    """The bits of a cell that cost least by the sizes of cells in the first pass."""
    least = math.ceil(max(1.0, math.log2(max(2, n) / window)))
    tried = list(range(least, min(BITS, least + 25), 3))
    keys = classes.mapInArrow(_sorted_keys(1, seed), f"pass int, key long, rep long, v {classes.schema['v'].dataType.simpleString()}").select("key")
    cells = keys.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.shiftright("key", BITS - m).alias("cell")) for m in tried])).alias("x")).groupBy("x").count()
    pairs = {r["m"]: r["pairs"] for r in cells.groupBy("x.m").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    return min(tried, key=lambda m: (cell_passes(m, threshold, recall) * (1000.0 * n + pairs.get(m, 0.0) / 2), m))


def _cells(threshold: float):
    """mapInArrow function over rows (pass, cell, i, j, block, rep, v) in order of the first four: links of a forest over the pairs of each pair of blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        forest, now, rows = Forest(), None, []

        def settle():
            block, rep, x = (np.concatenate(c) for c in zip(*rows))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            mine, theirs = np.nonzero(block == now[2])[0], np.nonzero(block == now[3])[0]
            label = np.arange(len(rep))
            for a in range(0, len(mine), 1024):
                for b in range(0, len(theirs), 1024):
                    close = x[mine[a : a + 1024]] @ x[theirs[b : b + 1024]].T >= threshold
                    for k in np.nonzero(close.any(axis=1))[0]:
                        near = np.append(theirs[b : b + 1024][close[k]], mine[a + k])
                        if (label[near] != label[near[0]]).any():
                            met = np.unique(label[near])
                            label[np.isin(label, met)] = met[0]
            for k in np.nonzero(label != np.arange(len(rep)))[0]:
                forest.join(int(rep[k]), int(rep[label[k]]))

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [len(key)]]) if len(key) else [0]
            block, rep = (batch.column(k).to_numpy() for k in (4, 5))
            x = _matrix(batch.column(6))
            for a, b in zip(cuts[:-1], cuts[1:]):
                group = tuple(int(k) for k in key[a])
                if rows and group != now:
                    settle()
                    rows = []
                now = group
                rows.append((block[a:b], rep[a:b], x[a:b]))
        if rows:
            settle()
        links = forest.links()
        for k in range(0, len(links), 65_536):
            some = links[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.int64()), pa.array([b for _, b in some], pa.int64())], schema=schema)

    return run


def _cell_links(keyed: DataFrame, bits: int, threshold: float) -> DataFrame:
    """Links within all cells of two or more vectors."""
    placed = keyed.withColumn("cell", F.shiftright("key", BITS - bits))
    sizes = placed.groupBy("pass", "cell").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = placed.join(sizes, ["pass", "cell"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pass", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "v")
    return dealt.repartition("pass", "cell", "i", "j").sortWithinPartitions("pass", "cell", "i", "j").mapInArrow(_cells(threshold), "a long, b long")


def _planes(dim: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((number * BITS, dim))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _sorted_keys(number: int, seed: int):
    """mapInArrow function from (rep, v) to a row (pass, key, rep, v) for each pass."""

    def run(batches):
        planes = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = _matrix(part.column(1))
                if planes is None or planes.shape[1] != x.shape[1]:
                    planes = _planes(x.shape[1], number, seed)
                bits = (x @ planes.T > 0).reshape(len(x), number, BITS)
                keys = (bits * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(axis=2)
                for p in range(number):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(keys[:, p]), part.column(0), part.column(1)], names=["pass", "key", "rep", "v"])

    return run


def _windows(threshold: float, window: int):
    """mapInArrow function over rows in order of (pass, key): links of a forest over the pairs at the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        forest, tail = Forest(), None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                at, reps, x = part.column(0).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                new = 0
                if tail is not None and tail[2].shape[1] == x.shape[1]:
                    new = len(tail[0])
                    at, reps, x = np.concatenate([tail[0], at]), np.concatenate([tail[1], reps]), np.concatenate([tail[2], x])
                for k in range(1, min(window, len(x) - 1) + 1):
                    low = max(0, new - k)
                    near = np.nonzero((np.einsum("ij,ij->i", x[low:-k], x[low + k :]) >= threshold) & (at[low:-k] == at[low + k :]))[0] + low
                    for i in near:
                        forest.join(int(reps[i]), int(reps[i + k]))
                tail = at[-window:], reps[-window:], x[-window:]
        links = forest.links()
        for k in range(0, len(links), 65_536):
            some = links[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.int64()), pa.array([b for _, b in some], pa.int64())], schema=schema)

    return run


def _counts(threshold: float):
    """mapInArrow function over rows (root, i, j, block, rep, n, v) in order of (root, i, j): rows (rep, links) of each pair of blocks."""

    def run(batches):
        now, rows = None, []

        def settle():
            block, rep, n, x = (np.concatenate(c) for c in zip(*rows))
            i, j = now[1:]
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            first, second = block == i, block == j
            links = np.zeros(len(rep), np.int64)
            for a in range(0, int(first.sum()), 1024):
                mine = np.nonzero(first)[0][a : a + 1024]
                for b in range(0, int(second.sum()), 1024):
                    theirs = np.nonzero(second)[0][b : b + 1024]
                    near = x[mine] @ x[theirs].T >= threshold
                    if i == j:
                        near &= mine[:, None] != theirs[None, :]
                    links[mine] += near @ n[theirs]
                    if i != j:
                        links[theirs] += n[mine] @ near
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], names=["rep", "links"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [len(key)]]) if len(key) else [0]
            block, rep, n = (batch.column(k).to_numpy() for k in (3, 4, 5))
            for a, b in zip(cuts[:-1], cuts[1:]):
                group = tuple(int(k) for k in key[a])
                if rows and group != now:
                    yield settle()
                    rows = []
                now = group
                rows.append((block[a:b], rep[a:b], n[a:b], _matrix(batch.column(6).slice(a, b - a))))
        if rows:
            yield settle()

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors.

    n_links: other rows with cosine at or above the threshold, in double
    precision. component_id: the smallest vec_id reachable by links, itself
    included. kept: whether that is the row's own.

    Vectors that are null, empty or zero, or hold a null or non-finite
    component, link with nothing; vectors of different lengths don't link.
    Ids are taken as unique; rows with a null id get no links and a null
    component, and kept is true. Other columns are ignored. An empty table
    gives an empty one.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # floats are moved as such and compared as doubles
    v = F.col(vector_col).cast(f"array<{kind}>")
    good = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, v).alias("v"))
    classes = reliable(rows.where("v IS NOT NULL").select("vec_id", F.transform("v", lambda x: (x + 0.0).cast(kind)).alias("v")).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "v"))
    ties = []
    for dim, number in sorted((r["d"], r["c"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).collect()):
        if number < 2:
            continue
        own = classes.where(F.size("v") == dim).select("rep", "v")
        bits = _cell_bits(own, number, threshold, window, recall, seed)
        turns = max(passes(number, threshold, window, recall), cell_passes(bits, threshold, recall))
        keyed = own.mapInArrow(_sorted_keys(turns, seed), f"pass int, key long, rep long, v array<{kind}>")
        parts = max(1, -(-number * turns // 16_384))
        ordered = keyed.repartitionByRange(parts, "pass", "key").sortWithinPartitions("pass", "key", "rep")
        ties.append(ordered.mapInArrow(_windows(threshold, window), "a long, b long"))
        ties.append(_cell_links(keyed, bits, threshold))
    root_of = connected_components(_union(vectors.sparkSession, ties))
    root_of = reliable(root_of.union(root_of.select("root", "root").distinct()))
    sizes = root_of.groupBy("root").agg(F.count("*").alias("size"))
    sized = root_of.join(sizes, "root").join(classes, F.col("node") == F.col("rep"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = sized.select("root", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), "rep", "n", "v")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "v")
    counted = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_counts(threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counted, "rep", "left").join(root_of, F.col("rep") == F.col("node"), "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    found = rows.withColumn("v", F.transform("v", lambda x: (x + 0.0).cast(kind))).join(known, "v", "left")
    component = F.coalesce("root", "vec_id")
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _union(spark, frames: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "a long, b long")
    for f in frames:
        out = out.union(f)
    return out


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(node, root) AS (SELECT a, a FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.root, e.vec_id)::BIGINT AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
