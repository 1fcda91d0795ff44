"""Packing documents into sequences of a fixed length (operator 6).

Each document is cut into full sequences and a rest. The rests are dealt over
randomised groups of documents, and each group is packed by first-fit
decreasing, finding the first bin with room in a tournament tree of bin
capacities. Groups are bounded, so a task holds one group whatever the size of
the table, and the cuts are made as a document is tokenised, so no ids are
moved between tasks: only lengths and checksums are.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LENGTH = 2048
END = 1
#: Documents packed together.
GROUP = 8192
SEED = 42


class Tree:
    """Tournament tree over bins in order: each node holds the largest room below it."""

    def __init__(self, n: int, room: int) -> None:
        self.size = 1 << max(0, (n - 1).bit_length())
        self.top = [room] * (2 * self.size)

    def take(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin with that much room; (bin, room it had)."""
        top, k = self.top, 1
        while k < self.size:
            k *= 2
            if top[k] < need:
                k += 1
        had = top[k]
        top[k] = had - need
        j = k >> 1
        while j:
            best = max(top[2 * j], top[2 * j + 1])
            if top[j] == best:
                break
            top[j] = best
            j >>= 1
        return k - self.size, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in the order given; ties keep their order."""
    if any(s < 1 or s > capacity for s in sizes):
        raise ValueError("sizes must be from 1 to the capacity")
    tree, out = Tree(max(1, len(sizes)), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        place, had = tree.take(sizes[i])
        out[i] = (place, capacity - had)
    return out


@functools.cache
def _encoder(vocabulary: str):
    """A function from a text to its ids, and one that is slower but takes any text.

    The vocabulary file is a byte-level BPE for the library tokenizers. Where
    the same vocabulary lies beside it as ranks, tiktoken encodes by those: the
    ids are the same (tests compare them) at several times the speed.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    slow.encode_special_tokens = True

    def by_tokenizers(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
    try:
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, OSError):
        return by_tokenizers, by_tokenizers
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary, by_tokenizers


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_ids(text: str | None, vocabulary: str | None = None, end: int = END) -> np.ndarray:
    """The ids of a text and the end id, as little-endian unsigned 32-bit."""
    fast, slow = _encoder(vocabulary or default_vocabulary())
    text = (text or "").encode("utf-8", "replace").decode()
    try:
        ids = fast(text)
    except Exception:  # the fast library's pattern gives up on some very long runs
        ids = slow(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = end
    return out


def cut(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, doc_tokens, crcs): the CRC-32 of each piece of ``length`` ids, the last one shorter."""
    arrow = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> dict:
        sizes, crcs = [], []
        for text in batch.column(1).to_pylist():
            ids = token_ids(text, vocabulary)
            sizes.append(len(ids))
            crcs.append([zlib.crc32(ids[k : k + length].tobytes()) for k in range(0, len(ids), length)])
        return {"doc_id": batch.column(0), "doc_tokens": sizes, "crcs": crcs}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, doc_tokens long, crcs array<long>", arrow, rows=256)


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(group: int, length: int):
    """mapInArrow function: packs each run of ``group`` rows of a partition."""

    def flush(rows: list[tuple], first: int) -> tuple[list[pa.RecordBatch], int]:
        out: list[list] = [[] for _ in _PIECES]

        def piece(*values) -> None:
            for column, v in zip(out, values):
                column.append(v)

        rests = [(doc, tokens, crcs) for doc, tokens, crcs in rows if tokens % length]
        for doc, tokens, crcs in rows:
            for k in range(tokens // length):
                piece(doc, k * length, length, crcs[k], tokens, first, 0)
                first += 1
        places = first_fit_decreasing([tokens % length for _, tokens, _ in rests], length)
        for (doc, tokens, crcs), (place, offset) in zip(rests, places):
            piece(doc, tokens - tokens % length, tokens % length, crcs[-1], tokens, first + place, offset)
        first += 1 + max((place for place, _ in places), default=-1)
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_PIECES)], first

    def run(batches):
        at = TaskContext.get()
        first, rows = (at.partitionId() if at else 0) << 40, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                if len(rows) == group:
                    out, first = flush(rows, first)
                    rows = []
                    yield from out
        if rows:
            yield from flush(rows, first)[0]

    return run


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, group: int = GROUP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    The ids of a document are those of its text and the end id; null texts
    count as empty, so each row of docs has at least one piece. Pieces of a
    sequence lie gaplessly from offset 0; sequence ids are unique, not dense.
    Rows with a null id and repeated rows are packed like others. Other
    columns of docs are ignored. An empty table gives an empty one.
    """
    pieces = cut(docs, length, vocabulary, id_col, text_col)
    order = F.xxhash64("doc_id", "doc_tokens", "crcs", F.lit(seed))
    partitions = max(1, -(-docs.count() // group))
    dealt = pieces.withColumn("o", order).repartition(partitions, "o").sortWithinPartitions("o", "doc_id", "doc_tokens").select("doc_id", "doc_tokens", "crcs")
    return dealt.mapInArrow(_pack(group, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
