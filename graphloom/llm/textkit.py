"""Whole texts as NumPy arrays, straight from Arrow buffers.

A word is a maximal run of ASCII letters, digits, underscores and bytes of non-ASCII characters, other than the general
punctuation block (U+2000 to U+207F), U+00A0 to U+00BF and U+3000 to U+303F. Case is folded for ASCII and Latin-1. Texts are never cut: texts
are taken in chunks of whole documents, and a document above the chunk size is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20
_PIECE = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {"pow": np.ones(1, U64), "inv": np.ones(1, U64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
WORD[95] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["pow"]) < n:
        size = max(n, _PIECE + 1)
        for name, base in (("pow", _BASE), ("inv", _INV)):
            a = np.empty(size, U64)
            a[0] = 1
            a[1:] = base
            _tables[name] = np.multiply.accumulate(a)
    return _tables["pow"][:n], _tables["inv"][:n]


class Texts:
    """Some whole documents: ``data`` bytes, ``off`` their bounds (n + 1), ``rows`` their places in the batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, rows: np.ndarray, null: np.ndarray):
        self.data, self.off, self.rows, self.null = data, off, rows, null
        self._low = self._words = None

    def __len__(self) -> int:
        return len(self.rows)

    @property
    def low(self) -> np.ndarray:
        """The bytes with case folded."""
        if self._low is None:
            b = self.data
            t = LOWER[b]
            at = np.flatnonzero(b[:-1] == 0xC3) + 1
            if len(at):
                v = b[at]
                up = (v >= 0x80) & (v <= 0x9E) & (v != 0x97)
                t[at[up]] = v[up] + 0x20
            self._low = t
        return self._low

    def word_mask(self) -> np.ndarray:
        b = self.data
        m = WORD[b]
        i = np.flatnonzero(b[:-2] == 0xE2) if len(b) > 2 else b[:0].astype(int)
        i = i[(b[i + 1] == 0x80) | (b[i + 1] == 0x81)] if len(i) else i
        if len(i):
            m[i] = m[i + 1] = m[i + 2] = False
        i = np.flatnonzero(b[:-2] == 0xE3) if len(b) > 2 else b[:0].astype(int)
        i = i[b[i + 1] == 0x80] if len(i) else i
        if len(i):
            m[i] = m[i + 1] = m[i + 2] = False
        i = np.flatnonzero(b[:-1] == 0xC2) if len(b) > 1 else b[:0].astype(int)
        i = i[b[i + 1] >= 0xA0] if len(i) else i
        if len(i):
            m[i] = m[i + 1] = False
        return m

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the bounds of each document's words in them (n + 1)."""
        if self._words is None:
            self._words = self.runs(self.word_mask())
        return self._words

    def runs(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of a mask, none across two documents."""
        inner = self.off[(self.off > 0) & (self.off < len(m))]
        before = np.empty(len(m), bool)
        after = np.empty(len(m), bool)
        if len(m):
            before[0], before[1:] = False, m[:-1]
            after[-1], after[:-1] = False, m[1:]
            before[inner] = False
            after[inner - 1] = False
        st = np.flatnonzero(m & ~before)
        en = np.flatnonzero(m & ~after) + 1
        return st, en, np.searchsorted(st, self.off)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all case-folded words and each document's bounds in them."""
        st, en, ptr = self.words()
        return span_hashes(self.low, st, en), ptr


def span_hashes(low: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """Hashes of spans that are in order and don't overlap."""
    out = np.empty(len(st), U64)
    i = 0
    while i < len(st):
        base = st[i]
        j = max(i + 1, int(np.searchsorted(en, base + _PIECE, "right")))
        seg = low[base : en[j - 1]]
        power, inverse = _powers(len(seg) + 1)
        total = np.empty(len(seg) + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[seg] * power[:-1], out=total[1:])
        out[i:j] = (total[en[i:j] - base] - total[st[i:j] - base]) * inverse[st[i:j] - base]
        i = j
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each start (len(h) - n + 1); of all words together if there are fewer."""
    n = max(1, min(n, len(h)))
    if len(h) == 0:
        return h
    g = h[: len(h) - n + 1]
    for k in range(1, n):
        g = g * U64(0x100000001B3) + h[k : len(h) - n + 1 + k]
    return mix(g + U64(n))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    """A string column as Texts of about ``size`` bytes. A null is an empty text with ``null`` set."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_string())
        wide = True
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    null = np.asarray(column.is_null())
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Texts(data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j), null[i:j])
        i = j


def id_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit integer ids, and where they are null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    null = np.asarray(column.is_null())
    return np.asarray(column.cast(pa.int64()).fill_null(0)), null


def simple_words(text: str) -> list[str]:
    """The words of a text as defined above, one at a time; the yardstick of tests."""
    out, cur = [], []
    for c in text:
        o = ord(c)
        ok = c == "_" or (o < 128 and c.isalnum()) or (o >= 128 and not (0x2000 <= o <= 0x207F or 0xA0 <= o <= 0xBF or 0x80 <= o < 0xA0 and False or 0x3000 <= o <= 0x303F))
        if ok:
            cur.append(c.lower() if o < 128 or 0xC0 <= o <= 0xDE and o != 0xD7 else c)
        elif cur:
            out.append("".join(cur))
            cur = []
    return out + (["".join(cur)] if cur else [])
