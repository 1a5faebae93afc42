"""Benchmark decontamination by SimHash of item-sized windows.

Shingles are pairs of neighbouring words, weighted by their rarity among the benchmark items. For each item of m words, the windows of m words at every word of every document are
compared to it (a shorter document is one window). A window and an item match if their weighted Jaccard similarity, the weight of shared distinct shingles over that of all, is at
least ``SIMILARITY``.

A window that shares too little weight with all items together cannot match one; an exact bound from prefix sums drops it. The others get a 64-bit SimHash from prefix
sums of signed weights. Fingerprints of the items are cut into blocks, and each block is indexed with all its one-bit neighbours: of (R + 1) / 2 blocks of two
fingerprints within R bits of each other, at least one differs by at most one bit, so the index finds all items within ``RADIUS``. Those are verified exactly.

Items are broadcast ``ITEMS`` at a time; a larger benchmark takes several passes over the documents.

Defined results: ids are integers, or strings of them (others fail in the cast); null and empty texts match nothing; null and empty items, and those of fewer than ``LEAST`` words, are no evidence and are left out; items of equal text are all
reported; rows that repeat a doc_id give one row for each item, of their best window (the first of equal ones); a null doc_id is reported as null. Other columns are ignored, or carried by ``keep_clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

SIMILARITY, RADIUS, LEAST, ITEMS = 0.6, 19, 4, 100_000
#: Windows that are fingerprinted at a time.
AT_ONCE = 16_384
U64 = np.uint64
SCHEMA = "doc_id long, item_id long, first_word long, words int, similarity double, distance int"


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Hashes of two neighbouring words, one for each word but the last."""
    return K.mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]


def signs(shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights with the signs of the 64 bits of each shingle."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.float32) * 2 - 1) * weight[:, None].astype(np.float32)


def packed(total: np.ndarray) -> np.ndarray:
    """Fingerprints of sums of signed weights. Sums are rounded, so that their order doesn't matter."""
    return np.packbits(np.round(total, 2) > 0, axis=1, bitorder="little").view("<u8").ravel().astype(U64)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of a fingerprint."""
    n = min(64, (radius + 2) // 2)
    cuts = np.round(np.linspace(0, 64, n + 1)).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])]


def _words(items: list[tuple[int | None, str]]) -> tuple[list, list[np.ndarray]]:
    """(ids, hashes of their words) of the items that are evidence, in order."""
    ids, words = [], []
    for i, t in sorted(((i, t) for i, t in items if t), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        c = next(K.chunks(pa.array([t], pa.large_string()), 1 << 62))
        h, _ = c.hashes()
        if len(h) >= LEAST:
            ids.append(i)
            words.append(h)
    return ids, words


def counted(items: list[tuple[int | None, str]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles, in how many items each is, items)."""
    sets = [np.unique(pairs_of(h)) for h in _words(items)[1]]
    v, df = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, U64), np.empty(0, np.int64))
    return v, df, len(sets)


class Index:
    """The items: weights of their shingles, fingerprints, and the block index of each size. ``counts``: of the whole benchmark (``counted``), if the items are a part of it."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY, radius: int = RADIUS, counts: tuple[np.ndarray, np.ndarray, int] | None = None):
        self.similarity, self.radius, self.blocks = similarity, radius, blocks(radius)
        self.ids, words = _words(items)
        self.sizes = np.array([len(h) for h in words], np.int64)
        lists = [pairs_of(h) for h in words]
        sets = [np.unique(s) for s in lists]
        self.vocabulary, df, n = counts or counted(items)
        self.weights = np.log1p((n + 1) / (df + 1.0))
        self.other = float(np.log1p(n + 1.0))
        self.sets = sets
        self.mass = np.array([self.weight(s).sum() for s in sets])
        self.prints = np.concatenate([packed(signs(s, self.weight(s)).sum(0, dtype=np.float64)[None]) for s in lists]) if lists else np.empty(0, U64)
        self.by_size = {}
        for m in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == m)
            tables = []
            for shift, width in self.blocks:
                v = ((self.prints[own] >> U64(shift)) & U64((1 << width) - 1)).astype(np.int64)
                near = np.concatenate([v] + [v ^ (1 << k) for k in range(width)])
                who = np.tile(own, width + 1)
                order = np.argsort(near, kind="stable")
                tables.append((near[order], who[order]))
            self.by_size[m] = (own, float(self.mass[own].min()) * similarity, tables)
        self.longest = int(self.sizes.max()) if sets else 0
        self.floor = min((x[1] for x in self.by_size.values()), default=0.0)

    def weight(self, s: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(s), self.other)
        i = np.searchsorted(self.vocabulary, s)
        i[i == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[i] == s, self.weights[i], self.other)

    def shared(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item."""
        w = np.unique(window)
        both = self.weight(np.intersect1d(w, self.sets[item], assume_unique=True)).sum()
        return float(both / (self.weight(w).sum() + self.mass[item] - both))

    def near(self, prints: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints and items of m words within the radius."""
        _, _, tables = self.by_size[m]
        n = len(self.ids)
        got = []
        for (shift, width), (keys, who) in zip(self.blocks, tables):
            v = ((prints >> U64(shift)) & U64((1 << width) - 1)).astype(np.int64)
            lo, hi = np.searchsorted(keys, v, "left"), np.searchsorted(keys, v, "right")
            many = hi - lo
            total = int(many.sum())
            if total:
                win = np.repeat(np.arange(len(prints)), many)
                at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                pair = win * n + who[at]
                got.append(pair[np.bitwise_count(prints[win] ^ self.prints[who[at]]) <= self.radius])
        pair = np.unique(np.concatenate(got)) if got else np.empty(0, np.int64)
        win, item = pair // n, pair % n
        return win, item, np.bitwise_count(prints[win] ^ self.prints[item]).astype(np.int64)

    def search(self, c: K.Texts) -> list[tuple[int, int, int, int, float, int]]:
        """(row of the batch, item, first word, words, similarity, distance): the best window of every matching document and item."""
        if not len(self.ids) or not len(c.data):
            return []
        h, ptr = c.hashes()
        if len(h) < 2:
            return []
        s = pairs_of(h)
        i = np.searchsorted(self.vocabulary, s)
        i[i == len(self.vocabulary)] = 0
        hit = np.where(self.vocabulary[i] == s, self.weights[i], 0.0)
        end = np.repeat(ptr[1:], np.diff(ptr))  # of each word's document
        inner = ptr[1:-1]
        hit[inner[(inner > 0) & (inner <= len(hit))] - 1] = 0.0  # pairs across two documents
        cum = np.concatenate(([0.0], np.cumsum(hit)))
        word = np.arange(len(h))
        reach = cum[np.minimum(word + self.longest, end) - 1] - cum[np.minimum(word, len(cum) - 1)]
        live = np.flatnonzero(reach >= self.floor - 1e-6)
        if not len(live):
            return []
        owner = np.searchsorted(ptr, live, "right") - 1
        first_of, end_of = ptr[owner], ptr[owner + 1]
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for m, (_, least, _) in self.by_size.items():
            # windows of m words, and whole documents of fewer
            last = np.minimum(live + m, end_of)
            ok = ((live + m <= end_of) | (live == first_of)) & (cum[last - 1] - cum[np.minimum(live, len(cum) - 1)] >= least - 1e-6) & (last - live > 1)
            starts, stops, docs = live[ok], last[ok], owner[ok]
            for lo in range(0, len(starts), AT_ONCE):
                a, z, d = starts[lo : lo + AT_ONCE], stops[lo : lo + AT_ONCE], docs[lo : lo + AT_ONCE]
                for win, item, dist in zip(*self.near(self._prints(s, a, z), m)):
                    sim = self.shared(s[a[win] : z[win] - 1], item)
                    if sim >= self.similarity - 1e-12:
                        key = (int(d[win]), int(item))
                        new = (-sim, int(a[win] - ptr[d[win]]), int(z[win] - a[win]), int(dist))
                        if key not in best or new < best[key]:
                            best[key] = new
        return [(int(c.rows[k]), item, at, n, -sim, dist) for (k, item), (sim, at, n, dist) in sorted(best.items())]

    def _prints(self, s: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Fingerprints of windows of words a to z, from prefix sums over the stretches that they cover."""
        out = np.empty(len(a), U64)
        i = 0
        while i < len(a):
            # a stretch of windows that overlap, of bounded length
            j = i + 1
            while j < len(a) and a[j] <= z[j - 1] and z[j] - a[i] < 4096:
                j += 1
            part = s[a[i] : z[j - 1] - 1]
            cum = np.zeros((len(part) + 1, 64))
            np.cumsum(signs(part, self.weight(part)), axis=0, dtype=np.float64, out=cum[1:])
            out[i:j] = packed(cum[z[i:j] - 1 - a[i]] - cum[a[i:j] - a[i]])
            i = j
        return out


def indexes(benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> list[Index]:
    """The items in groups of at most ITEMS, with weights by counts over all of them."""
    rows = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    groups: list[list] = [[]]
    for r in rows.toLocalIterator():
        if len(groups[-1]) == ITEMS:
            groups.append([])
        groups[-1].append((r["item_id"], r["text"]))
    parts = [counted(g) for g in groups]
    v, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = v, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(v)).astype(np.int64), sum(p[2] for p in parts)
    return [Index(g, similarity, radius, counts) for g in groups]


def _found(docs: DataFrame, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()]

    def run(batches):
        ix = sent.value
        for b in batches:
            ids, gone = K.id_array(b.column(0))
            rows = [(None if gone[r] else int(ids[r]), ix.ids[item], at, n, sim, dist) for c in K.chunks(b.column(1)) for r, item, at, n, sim, dist in ix.search(c)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first_word, words, similarity, distance) of every document and item that match, with the best window."""
    out = None
    for index in indexes(benchmark, similarity, radius):
        part = _found(docs, index)
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct((-F.col("similarity")).alias("n"), "first_word", "words", "distance")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.first_word", "b.words", (-F.col("b.n")).alias("similarity"), "b.distance")


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that match no item, with their columns as they are."""
    columns = docs.columns
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    schema, text = out.schema, columns.index("text")
    for index in indexes(benchmark, similarity, radius):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for c in K.chunks(b.column(text)):
                    for row in sent.value.search(c):
                        keep[row[0]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, schema)
    return out.toDF(*columns)
