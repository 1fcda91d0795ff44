"""Secrets in texts, also under layers of encoding (operator 7).

A worklist starts with the text. Each layer is scanned, then unwrapped in every
way that applies: percent escapes, Unicode and character-reference escapes,
base64, and compression beneath base64. What results is a layer of its own,
with a map from its offsets to those of the text, until nothing new comes out;
a layer that was seen before at the same place isn't entered again, which ends
cycles; the same blob at another place is.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import io
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .spans import Span, digest, written

BASE = ("assign", "access", "hex")
#: Found beneath a layer; ``oversize`` marks a compressed layer that unpacks to more than MAX_LAYER bytes, which is scanned in stretches.
ADDED = ("decoded_assign", "decoded_access", "decoded_hex", "private_key", "oversize")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
MAX_LAYER = 64 << 20

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_KEY = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
_HEXES, _B64 = b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_HEX_MAP = bytes(120 if c in _HEXES else 32 for c in range(256))
_B64_MAP = bytes(120 if c in _B64 else 32 for c in range(256))
#: The least run that holds a secret: that of 12 bytes, "token=abcdef".
_LEAST_B64 = 16
#: Bytes that a decompressor may take.
_MEMORY = 256 << 20
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]+)+")
#: Characters that two stretches of a long inflated layer have in common.
OVERLAP = 1 << 16
#: Decoded text may hold this share of characters that don't print.
_ODD = 0.1
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|lt|gt|apos|colon|equals);")


def _runs(text: str, table: bytes, least: int):
    """(start, end) of the maximal runs of at least ``least`` characters of a table."""
    flat = text.encode("latin-1", "replace").translate(table)  # a byte for each code point
    need, at = b"x" * least, 0
    while (at := flat.find(need, at)) >= 0:
        end = flat.find(b" ", at)
        end = len(flat) if end < 0 else end
        yield at, end
        at = end


def scan_layer(text: str) -> list[Span]:
    """The base spans of a text: leftmost non-overlapping matches of each kind that pass its test."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", a, b) for a, b in _runs(text, _HEX_MAP, 24)]
    return out


class _Layer:
    """A text and its map: pieces (start here, start below, length below or None if offsets run along)."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int | None]], below: _Layer | None) -> None:
        self.text, self.pieces, self.below, self.starts = text, pieces, below, [p[0] for p in pieces]

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that a span of this layer comes from."""
        if self.below is None:
            return start, end
        a, b = self.pieces[bisect_right(self.starts, start) - 1], self.pieces[bisect_right(self.starts, max(start, end - 1)) - 1]
        low = a[1] + (start - a[0] if a[2] is None else 0)
        high = b[1] + (end - b[0] if b[2] is None else b[2])
        return self.below.place(low, high)


def _unescaped(layer: _Layer, pattern: re.Pattern, decode: Callable[[str], str | None]) -> _Layer | None:
    """The layer with each match decoded in place; None if nothing changes."""
    out, pieces, at, size = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        plain = decode(m[0])
        if plain is None or plain == m[0]:
            continue
        if m.start() > at:
            pieces.append((size, at, None))
            out.append(layer.text[at : m.start()])
            size += m.start() - at
        if plain:
            pieces.append((size, m.start(), m.end() - m.start()))
            out.append(plain)
            size += len(plain)
        at = m.end()
    if not out:
        return None
    if at < len(layer.text):
        pieces.append((size, at, None))
        out.append(layer.text[at:])
    return _Layer("".join(out), pieces, layer)


def _percent(run: str) -> str | None:
    return unquote_to_bytes(run).decode("utf-8", "replace")


def _escape(run: str) -> str | None:
    try:
        if run[0] == "&":
            return html.unescape(run)
        if run[1] == "x":
            return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
        if run[1] == "U":
            return chr(int(run[2:], 16))
        return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace")
    except (ValueError, OverflowError):
        return None


def _printable(data: bytes) -> str | None:
    """The text, if it is UTF-8 but for a small share of odd characters or holds something to find."""
    text = data.decode("utf-8", "replace")
    bad = sum(not (c.isprintable() or c in "\r\n\t") or c == "\ufffd" for c in text)
    return text if text and (bad <= _ODD * len(text) or scan_layer(text) or _KEY.search(text)) else None


class _Reader(io.RawIOBase):
    """Chunks of bytes as a file."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        self.rest = self.rest or next(self.chunks, b"")
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _inflated(head: bytes, chunks: Iterator[bytes]) -> Iterator[bytes] | None:
    """The contents of a compressed stream in chunks of at most MAX_LAYER bytes; None if it isn't one. Damage ends it."""
    gzipped = head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0
    zstd = head[:4] == b"\x28\xb5\x2f\xfd"
    if not (gzipped or zstd or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00"):
        return None

    def run() -> Iterator[bytes]:
        try:
            if zstd:
                import zstandard

                with zstandard.ZstdDecompressor(max_window_size=_MEMORY // 4).stream_reader(io.BufferedReader(_Reader(chunks))) as f:
                    while out := f.read(MAX_LAYER):
                        yield out
                return
            box = zlib.decompressobj(47) if gzipped else bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor(memlimit=_MEMORY)
            for data in chunks:
                more = True
                while more and not box.eof:
                    out = box.decompress(data, MAX_LAYER)
                    data = box.unconsumed_tail if gzipped else b""
                    more = bool(data or len(out) == MAX_LAYER) if gzipped else not box.needs_input
                    if out:
                        yield out
        except Exception:  # damaged data isn't a layer
            return

    return run()


def _unpack(data: bytes) -> Iterator[bytes] | None:
    """What is beneath all compression of data, in chunks; None if it isn't compressed."""
    chunks, head, known, unpacked = iter([data]), data, set(), False
    while head and head not in known and (inner := _inflated(head, chunks)) is not None:
        known.add(head)
        unpacked = True
        head = next(inner, b"")
        chunks = itertools.chain([head], inner)
    return chunks if unpacked else None


def _stretches(chunks: Iterator[bytes]) -> Iterator[str]:
    """The text of chunks in stretches of MAX_LAYER characters or more, each beginning with the end of the one before."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    overlap, parts, size, fresh = min(OVERLAP, MAX_LAYER // 2), [], 0, False
    for chunk in chunks:
        if fresh and size >= MAX_LAYER:
            text = "".join(parts)
            yield text
            parts, size, fresh = [text[-overlap:]], overlap, False
        parts.append(decode(chunk))
        size += len(parts[-1])
        fresh = fresh or bool(chunk)
    if fresh:
        yield "".join(parts) + decode(b"", True)


def _encoded(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of base64 runs; of runs over line breaks also the whole, and it without its last line, which may be other text."""
    for a, b in _runs(text, _B64_MAP, _LEAST_B64):
        yield a, b, text[a:b]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            for end in (m.end(), m.start() + m[0].rindex("\n")):
                whole = text[m.start() : end].rstrip("\r\n")
                if "\n" in whole:
                    yield m.start(), m.start() + len(whole), whole.replace("\r", "").replace("\n", "")


def _base64(layer: _Layer) -> Iterator[tuple[_Layer, bool]]:
    """Layers decoded from runs that hold text, perhaps compressed, one at a time; and whether one goes on from the layer before."""
    for a, b, run in _encoded(layer.text):
        run = run.replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1 or run.isalpha() and (run[1:].islower() or run.isupper()):
            continue
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        chunks = _unpack(data)
        if chunks is None:
            texts: Iterable[str] = [text] if (text := _printable(data)) else []
        else:
            texts = _stretches(chunks)
        for k, text in enumerate(texts):
            if text:
                yield _Layer(text, [(0, a, b - a)], layer), k > 0


def _within(layer: _Layer) -> Iterator[tuple[_Layer, bool]]:
    """Every layer right beneath this one."""
    if "%" in layer.text and (x := _unescaped(layer, _PERCENT, _percent)):
        yield x, False
    if ("\\" in layer.text or "&" in layer.text) and (x := _unescaped(layer, _ESCAPE, _escape)):
        yield x, False
    yield from _base64(layer)


def _key(layer: _Layer) -> tuple[bytes, int, int]:
    """What tells layers apart: the text, as a digest, and the place it comes from."""
    return hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.place(0, len(layer.text))


def find(text: str | None) -> list[Span]:
    """All spans of one text: the base ones, and those found in decoded layers at the places they come from."""
    if not text:
        return []
    base = scan_layer(text)
    out = list(base)
    if "PRIVATE KEY" in text:
        out += [("private_key", m.start(), m.end()) for m in _KEY.finditer(text)]
    plain = {(k, a, b) for k, a, b in base}
    first = _Layer(text, [], None)
    work, seen = [_within(first)], {_key(first)}
    while work:
        layer, further = next(work[-1], (None, False))
        if layer is None:
            work.pop()
            continue
        if further:
            out.append(("oversize", *layer.place(0, len(layer.text))))
        if (key := _key(layer)) in seen:
            continue
        seen.add(key)
        for kind, a, b in scan_layer(layer.text):
            place = layer.place(a, b)
            if (kind, *place) not in plain:
                out.append((f"decoded_{kind}", *place))
        out += [("private_key", *layer.place(m.start(), m.end())) for m in _KEY.finditer(layer.text)]
        work.append(_within(layer))
    return list(dict.fromkeys(out))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one for each row of docs.

    Null texts count as empty and have no spans; rows with null ids and
    repeated rows are kept; other columns are ignored. Offsets are code points,
    end exclusive; a secret in a decoded layer has the span of its encoded form.
    """
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        found = [find(t) for t in batch.column(1).to_pylist()]
        base = [[s for s in spans if s[0] in BASE] for spans in found]
        return {"doc_id": batch.column(0), **{f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE}, "base_sha256": [digest(b, ORDER) for b in base], "spans": [written(s, ORDER) for s in found]}

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema, arrow)
