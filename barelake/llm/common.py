"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side is broadcast only up to this many rows; beyond it a salted shuffle join is used.
MAX_BROADCAST_ROWS = 200_000
#: Copies of the small side and slices of the large side in a salted join.
SALTS = 32


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by an eager checkpoint in the shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``; a
    temporary one is set only where the session names none (tests, local runs).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of frames made and run herein are removed when their action ends.

    Otherwise they lie on the disks until the driver happens to collect
    garbage. A frame that reads its files once more after that computes them anew.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@functools.cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim; where there is none, nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Hand this process's free memory back to the system, which else stays with it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function after which the worker gives its free memory back.

    Workers are kept for later tasks and stages; one that doesn't would hold
    what its largest task took until it ends.
    """

    @functools.wraps(run)
    def then(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return then


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, arrow: pa.Schema, rows: int = 1024) -> DataFrame:
    """mapInArrow over slices of at most ``rows`` rows; fn gives the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in arrow}, schema=arrow)

    return df.mapInArrow(run, schema)


def lookup(df: DataFrame, key: str, small: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Inner join of df with one row per key of ``small``, null-safe on ``key``.

    The number of rows of ``small`` is counted (it stops counting beyond the
    limit): up to the limit the side is broadcast, beyond it both sides are
    salted so that a key with a large share of df is dealt over SALTS tasks.
    """
    renamed = small.withColumnRenamed(key, "__key")
    if small.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(renamed), df[key].eqNullSafe(F.col("__key"))).drop("__key")
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = renamed.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, salted[key].eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__slice"))).drop("__key", "__salt", "__slice")


def lookup_side(small: DataFrame, rows: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame, to be broadcast if its known number of rows is within the limit."""
    return F.broadcast(small) if rows <= limit else small


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def row_identity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id as text; rows without one are told apart by their text."""
    return F.coalesce(df[id_col].cast("string"), F.md5(df[text_col]), F.lit("null"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


class Forest:
    """Union-find over hashable nodes; the root of a set is its smallest node."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.up[high] = low
            self.up.setdefault(low, low)

    def links(self) -> list[tuple]:
        """(node, root) of each node that is not a root."""
        return [(x, r) for x in self.up if (r := self.find(x)) != x]

