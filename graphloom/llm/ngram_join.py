"""N-gram Jaccard join by universe partition and pigeonhole.

Every document is its set of word n-grams. Documents of equal sets collapse first. If two sets of sizes a and b have a
Jaccard similarity of at least d, their symmetric difference holds at most H = (1-d)/(1+d) * (a+b) grams. The universe of
gram hashes is cut into segments. A segment has an allowance of 0 (it must be equal in both sets) or 1 (it may differ by one
gram: both sets index the segment and all its one-deletion neighbours). If the allowances plus one add up to more than H, some segment
of every similar pair stays within its allowance. So both index a key for it, and the pair is a candidate; every candidate is verified on whole sets.

Sizes are in bands of powers of two. A space holds the pairs of one band, or of two neighbouring ones, and has its own cut.
Of its equal-only segments a set indexes just the cheapest H + q, in an order that depends on a segment's content alone (how common its rarest
gram is, then its hash). Two similar sets have at least (segments - H) equal segments; each indexes the cheapest q of those at least, so they share q keys. Pairs with fewer
shared keys need no verification. How many segments a space has, how many get an allowance of 1 and q come from a cost model
fed with a bounded sample of documents; it affects the cost, never the result.

Crowds of near copies would give as many candidates as their size squared. A set that shares signature keys with CROWD others or more is
compared with one leader, the most central of them, and labelled with it if they are similar. Sets of one label form no candidates: by the triangle inequality
two of them are similar for certain if their differences from the leader are small together, which counting decides for whole cells of equal differences at once;
the rest are compared by these differences alone, in blocks. So no pair is lost and none is listed. Labels too affect the cost only.

Sets are compared as sets of 64-bit gram hashes, and are equal if two 64-bit sums and their sizes are.

Defined results: null, empty and wordless texts take part in no pair; a text of fewer than n words has one gram, all its words; rows that share a
doc_id and a text are one document, rows that share a doc_id only are several; rows with a null doc_id are left out. doc_id is an integer, or a
string of one; anything else fails in the cast. Other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import BROADCAST_IDS, by_ids, discard, written

from . import textkit as K

N = 2
THRESHOLD = 0.7
#: Bytes of text for each bucket of keys: bounds what one task of the candidate search holds.
BUCKET_BYTES = 12_000_000
#: Sampled documents for the frequencies of grams, and sampled sets of a space for its cost model.
SAMPLE, MODELLED = 6000, 100
#: What the shared keys of a pair must weigh together; in a space where similar sets share q keys at least, a key weighs FULL / q.
FULL = 120
#: What a space may choose: segments in terms of the fewest possible, the share of them with an allowance of 1, q.
CHOICES = ((1.1, 0.0, 1), (1.1, 0.0, 3), (1.3, 0.0, 3), (1.6, 0.0, 3), (1.2, 0.0, 6), (1.3, 0.0, 12), (1.2, 1.0, 1))
#: Signature keys of a set and grams of each; sets that share a key before a leader is sought.
SIGN, OF, CROWD = 6, 4, 10
#: Rows of a block of labelled sets; pairs that one task verifies; bytes of the leaders' sets that are broadcast; edges whose components one task finds.
BLOCK, PAIRS_AT_ONCE, BROADCAST_BYTES, EDGES_AT_ONCE = 1024, 100_000, 32_000_000, 2_000_000
#: Pairs that a task holds at once while it lists those of its keys.
LISTED = 4_000_000
U64 = np.uint64
_BINS = (np.arange(SIGN, dtype=U64) * U64((1 << 64) // SIGN)).astype(U64)


def gram_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    t = np.sort(K.grams(h, n))
    return t[np.concatenate(([True], t[1:] != t[:-1]))] if len(t) else t


def _numbered(batch: pa.RecordBatch, n: int):
    """(row, doc_id, gram set) of each document that has an id and a word."""
    ids, gone = K.id_array(batch.column(0))
    for c in K.chunks(batch.column(1)):
        h, ptr = c.hashes()
        for k, r in enumerate(c.rows):
            if not gone[r] and ptr[k + 1] > ptr[k]:
                yield int(r), int(ids[r]), gram_set(h[ptr[k] : ptr[k + 1]], n)


def _each(batch: pa.RecordBatch, n: int):
    """(doc_id, gram set) of each document that has an id and a word."""
    for _, d, t in _numbered(batch, n):
        yield d, t


def signature(t: np.ndarray) -> np.ndarray:
    """A key of each range of the hash: of the OF least grams of the set in it; 0 where there is none."""
    at = np.append(np.searchsorted(t, _BINS), len(t))
    i = at[:-1, None] + np.arange(OF)
    there = i < at[1:, None]
    keys = K.mix(np.where(there, K.mix(t[np.minimum(i, len(t) - 1)]), U64(0)).sum(1, dtype=U64) + _BINS)
    return np.where(there[:, 0], keys, U64(0))


def set_hashes(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, h1, h2, size, signs): a 128-bit hash of each document's set, and its signature."""

    def run(batches):
        for b in batches:
            rows, signs = [], []
            for d, t in _each(b, n):
                rows.append((d % (1 << 64), int(t.sum(dtype=U64)), int(K.mix(t ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)), len(t)))
                signs.append(signature(t))
            a = np.array(rows, dtype=U64).reshape(-1, 4).astype(np.int64)
            s = np.array(signs, U64).reshape(-1, SIGN).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * SIGN, pa.int32()), pa.array(s.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(a[:, k]) for k in range(4)), lists], names=["doc_id", "h1", "h2", "size", "signs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, size long, signs array<long>")


# -- the plan of a space ---------------------------------------------------------------------------------------------


def difference(a: float, b: float, d: float) -> int:
    """The largest symmetric difference of two sets of these sizes with a Jaccard similarity of d or more."""
    return int(math.floor((1 - d) / (1 + d) * (a + b) + 1e-9))


def spaces_of(size: int, d: float) -> list[tuple[tuple[int, int], int]]:
    """The spaces a set of this size belongs to, each with the largest difference that it can have from a similar set in it."""
    b = size.bit_length() - 1
    out = [((b, b), difference(size, min(2 ** (b + 1) - 1, size / d), d))]
    if size >= d * 2 ** (b + 1):
        out.append(((b, b + 1), difference(size, size / d, d)))
    if b and size * d <= 2**b - 1:
        out.append(((b - 1, b), difference(size, 2**b - 1, d)))
    return out


def space_difference(space: tuple[int, int], d: float) -> int:
    lo, hi = space
    top = 2 ** (lo + 1) - 1
    return difference(top, top if lo == hi else min(2 ** (hi + 1) - 1, top / d), d)


def cut(points: int, deep: int) -> np.ndarray:
    """Bounds of the segments in the upper 32 bits of the hash; the first ``deep`` have an allowance of 1, 2 points and twice the width."""
    flat = points - 2 * deep
    w = np.concatenate((np.full(deep, 2.0), np.ones(max(flat, 0))))
    return np.minimum(np.round(np.concatenate(([0.0], np.cumsum(w))) / w.sum() * 2**32), 2**32).astype(U64)


class Plan:
    """The cut of every space, and the frequencies of the grams that are not rare: gram hashes in order, counts in a sample."""

    def __init__(self, d: float, grams: np.ndarray, counts: np.ndarray, chosen: dict[tuple[int, int], tuple[float, float, int]]):
        self.d, self.grams, self.counts, self.chosen, self.made = d, grams, counts, chosen, {}

    def space(self, s: tuple[int, int]):
        if s not in self.made:
            slack, share, q = self.chosen.get(s, (1.3, 0.0, 3))
            need = space_difference(s, self.d) + q
            points = max(need, math.ceil(slack * need))
            deep = int(share * points / 2)
            b = cut(points, deep)
            salt = K.mix(np.arange(len(b) - 1, dtype=U64) + U64(s[0] * 128 + s[1] + 1) * U64(1 << 40))
            self.made[s] = (deep, 1 if deep else q, b, salt)
        return self.made[s]

    def frequency(self, t: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(t), U64)
        i = np.searchsorted(self.grams, t)
        i[i == len(self.grams)] = 0
        return np.where(self.grams[i] == t, self.counts[i], U64(0))

    def keys(self, t: np.ndarray, freq: np.ndarray, mixed: np.ndarray, s: tuple[int, int], most: int) -> np.ndarray:
        """The keys of one set in one space. freq: of each gram; most: the largest difference from a similar set in this space."""
        deep, q, bounds, salt = self.space(s)
        at = np.searchsorted(t >> U64(32), bounds)
        at[-1] = len(t)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed)))
        sums = total[at[1:]] - total[at[:-1]]
        own = K.mix(sums ^ salt)
        size = np.diff(at)
        flat = len(size) - deep
        got = min(most + q - int(np.minimum(size[:deep], 2).sum()), flat)
        blank = most + q - 2 * deep > flat or most + q - int(np.minimum(size[:deep], 2).sum()) > flat
        out = []
        if got > 0:
            low = np.full(flat, U64((1 << 20) - 1))
            full = np.flatnonzero(size[deep:])
            if len(full):
                low[full] = np.minimum(np.minimum.reduceat(freq, at[deep:-1][full]), U64((1 << 20) - 2))
            rank = (low << U64(44)) | (own[deep:] >> U64(20))
            out.append(own[deep:][np.argpartition(rank, got - 1)[:got]] if got < flat else own[deep:])
        if deep:
            k = at[deep]
            seg = np.repeat(np.arange(deep), size[:deep])
            less = K.mix((sums[seg] - mixed[:k]) ^ salt[seg])
            out += [own[:deep], less] if blank else [own[:deep][size[:deep] > 0], less[size[seg] > 1]]
        return np.concatenate(out) if out else own[:0]


def plan(docs: DataFrame, reps: int, n: int, d: float) -> Plan:
    """Choose the cut of every space from a bounded sample of the sets; ``reps`` is how many sets there are."""
    share = min(1.0, SAMPLE / max(reps, 1))
    pick = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t.tobytes() for _, t in _each(b, n)], pa.binary())], names=["t"])

    sets = [np.frombuffer(r["t"], U64) for r in pick.select("doc_id", "text").mapInArrow(run, "t binary").toLocalIterator()]
    if not sets:
        return Plan(d, np.empty(0, U64), np.empty(0, U64), {})
    scale = reps / len(sets)
    u, c = np.unique(np.concatenate(sets), return_counts=True)
    grams, counts = u[c > 1], c[c > 1].astype(U64)
    known = Plan(d, grams, counts, {})
    members: dict[tuple[int, int], list] = {}
    for t in sets:
        for s, most in spaces_of(len(t), d):
            members.setdefault(s, []).append((t, most))
    chosen = {}
    for s, rows in members.items():
        times = scale * max(1.0, len(rows) / MODELLED)
        rows = [(t, known.frequency(t), K.mix(t), most) for t, most in rows[:MODELLED]]
        every = len(rows) * (len(rows) - 1) / 2
        similar: dict[int, bool] = {}
        best = None
        for slack, share, q in CHOICES:
            p = Plan(d, grams, counts, {s: (slack, share, q)})
            keys = [np.unique(p.keys(t, f, m, s, most)) for t, f, m, most in rows]
            made = sum(map(len, keys))
            a, b, times_shared = _listed(np.concatenate(keys), np.repeat(np.arange(len(rows)), [len(k) for k in keys]), None, None)
            code, place = np.unique(a * len(rows) + b, return_inverse=True)
            many = np.bincount(place, times_shared, len(code))
            for c in code.tolist():
                if c not in similar:
                    x, y = rows[c // len(rows)][0], rows[c % len(rows)][0]
                    similar[c] = len(np.intersect1d(x, y, assume_unique=True)) > 0.3 * min(len(x), len(y))
            many = many[[not similar[c] for c in code.tolist()]] if len(code) else many
            # where the sample shows no shared key, one may have been missed: with many sets, q must guard against that
            hits = int(many.sum()) + 1
            rate = hits / max(every, 1)
            tail = 1 - math.exp(-rate) * sum(rate**i / math.factorial(i) for i in range(p.space(s)[1]))
            left = int((many >= p.space(s)[1]).sum()) + max(tail, 0.0) * every
            # a key costs 5 bytes, a shared key 8, a candidate 150; false pairs grow with the square of the number of sets
            cost = 5 * made * times + (8 * hits + 150 * left) * times * times
            if best is None or cost < best[0]:
                best = (cost, slack, share, q)
        chosen[s] = best[1:]
    return Plan(d, grams, counts, chosen)


# -- candidates ------------------------------------------------------------------------------------------------------


def indexed(docs: DataFrame, p: Plan, n: int, buckets: int) -> DataFrame:
    """(bucket, base, keys, ids, labels) of documents (doc_id, text, label): packed keys of the sets.

    A bucket's number tells q and whether its spaces hold pairs of two bands; of these, the lowest bit of a key tells the upper band.
    Ids are differences in the order of the rows; labels are differences from the least label less one, 0 for none.
    """
    d = p.d
    space_cache: dict[int, list] = {}
    kinds = sorted({q for _, _, q in CHOICES} | {3})

    def run(batches):
        held: list[tuple] = []
        many = 0

        def flush():
            nonlocal held, many
            if not held:
                return
            lens = [len(x[0]) for x in held]
            key = np.concatenate([x[0] for x in held])
            doc, label, kind = (np.repeat(np.array([x[k] for x in held], np.int64), lens) for k in (1, 2, 3))
            upper = np.repeat(np.array([x[4] for x in held], np.uint32), lens)
            held, many = [], 0
            bucket = (key % U64(buckets)).astype(np.int64) * (2 * len(kinds)) + kind
            order = np.argsort(bucket, kind="stable")
            bucket, doc, label = bucket[order], doc[order], label[order]
            key = (((key >> U64(33)).astype(np.uint32) << np.uint32(1)) | upper)[order]
            at = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(bucket)]))
            kb = key.tobytes()
            out: list[list] = [[], [], [], [], []]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                ids, lab = doc[i:j], label[i:j]
                for k, v in zip(out, (int(bucket[i]), [int(ids[0]), int(lab.max())], kb[4 * i : 4 * j], _planes(_narrow(np.diff(ids, prepend=ids[0]))), _planes(_narrow(np.where(lab < 0, 0, lab.max() - lab + 1))) if lab.max() >= 0 else b"")):
                    k.append(v)
            for lo in range(0, len(out[0]), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 4096], t) for v, t in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "base", "keys", "ids", "labels"])

        for b in batches:
            labels = b.column(2).to_pylist()
            for row, doc, t in _numbered(b, n):
                if len(t) not in space_cache:
                    space_cache[len(t)] = [(s, most, kinds.index(p.space(s)[1]) * 2 + (s[0] != s[1]), int(len(t).bit_length() - 1 == s[1] != s[0])) for s, most in spaces_of(len(t), d)]
                freq, mixed = p.frequency(t), K.mix(t)
                for s, most, kind, upper in space_cache[len(t)]:
                    got = p.keys(t, freq, mixed, s, most)
                    held.append((got, doc, -1 if labels[row] is None else labels[row], kind, upper))
                    many += len(got)
                if many > 2_000_000:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "text", "label").mapInArrow(run, "bucket long, base array<long>, keys binary, ids binary, labels binary")


def _narrow(x: np.ndarray) -> np.ndarray:
    """Of 4 bytes where all are from 0 to 2^32, else of 8."""
    return x.astype(np.uint32) if len(x) and x.min() >= 0 and x.max() < 1 << 32 else x.astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, first all lowest ones, then the next: the zeros of small numbers come together, which the shuffle's compression sees."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: pa.Scalar, n: int) -> np.ndarray:
    """The integers of ``_planes``, of 4 or 8 bytes."""
    b = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(b.T).view(np.uint32 if len(b) == 4 else np.int64).ravel()


def _pairer(parts: int):
    """Pairs of documents that share keys of a bucket, packed for each of the parts that pairs are counted in."""

    def pack(table: pa.Table) -> pa.Table:
        a, b, n = _bucket_pairs(table)
        part = (K.mix(a.astype(U64) * U64(0x9E3779B97F4A7C15) + b.astype(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # a and b stay in order within a part
        part, a, b, n = part[order], a[order], b[order], n[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
        out: dict[str, list] = {k: [] for k in ("part", "base", "many", "a", "b", "n")}
        for i, j in zip(cuts[:-1], cuts[1:]):
            x, y = a[i:j], b[i:j]
            base = int(x[0])
            for k, v in zip(out, (int(part[i]), base, int(j - i), _planes(_narrow(np.diff(x, prepend=base))), _planes(_narrow(y - base)), n[i:j].astype(np.uint8).tobytes())):
                out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64() if k in ("part", "base", "many") else pa.binary()) for k, v in out.items()})

    return pack


def _counted(table: pa.Table) -> pa.Table:
    """(doc_a, doc_b) whose shared keys weigh enough over all buckets."""
    aa, bb, nn = [], [], []
    for base, many, a, b, n in zip(table["base"].to_pylist(), table["many"].to_pylist(), table["a"], table["b"], table["n"]):
        aa.append(np.cumsum(_unplaned(a, many), dtype=np.int64) + base)
        bb.append(_unplaned(b, many).astype(np.int64) + base)
        nn.append(np.frombuffer(n.as_buffer(), np.uint8))
    a, b, n = _summed(np.concatenate(aa), np.concatenate(bb), np.concatenate(nn))
    return pa.table({"doc_a": pa.array(a[n >= FULL], pa.int64()), "doc_b": pa.array(b[n >= FULL], pa.int64())})


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sum of n up to FULL."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    if not len(a):
        return a, b, n
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.minimum(np.add.reduceat(n, first, dtype=np.int64), FULL)


def _listed(key: np.ndarray, doc: np.ndarray, label: np.ndarray | None, upper: np.ndarray | None, weight: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n), a < b: pairs that share keys, with the sum of weights if there is more than one piece of LISTED pairs; else one row a key.

    label: pairs of one label are left out, -1 is none; upper: pairs on one side are left out.
    """
    label = np.full(len(key), -1, np.int64) if label is None else label
    order = np.lexsort((label, key))
    key, doc, label = key[order], doc[order], label[order]
    same = key[1:] == key[:-1]
    inside = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(key) else np.zeros(0, bool)
    key, doc, label, order = key[inside], doc[inside], label[inside], order[inside]
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none, none
    new = np.concatenate(([True], key[1:] != key[:-1]))
    end = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    own = new | np.concatenate(([True], label[1:] != label[:-1])) | (label < 0)
    start = np.append(np.flatnonzero(own)[1:], len(key))[np.cumsum(own) - 1]
    many = end - start
    total = np.concatenate(([0], np.cumsum(many)))
    found = []
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(total, total[i] + LISTED, "right")) - 1)
        x = np.repeat(np.arange(i, j), many[i:j])
        y = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], many[i:j]) + np.repeat(start[i:j], many[i:j])
        if upper is not None:
            ok = upper[order[x]] != upper[order[y]]
            x, y = x[ok], y[ok]
        a, b = doc[x], doc[y]
        a, b = np.minimum(a, b), np.maximum(a, b)
        ok = a != b
        piece = a[ok], b[ok], np.full(int(ok.sum()), weight, np.int64)
        found.append(piece if total[-1] <= LISTED else _summed(*piece))
        i = j
    return tuple(np.concatenate(z) for z in zip(*found))


def _bucket_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight) in order: what the keys of this bucket that two documents share weigh, FULL standing for more."""
    kinds = sorted({q for _, _, q in CHOICES} | {3})
    kind = table["bucket"][0].as_py() % (2 * len(kinds))
    ks, ds, ls = [], [], []
    for (base, top), k, o, lab in zip(table["base"].to_pylist(), table["keys"], table["ids"], table["labels"]):
        key = np.frombuffer(k.as_buffer(), np.uint32)
        ks.append(key)
        ds.append(np.cumsum(_unplaned(o, len(key)).astype(np.int64)) + base)
        if top < 0:
            ls.append(np.full(len(key), -1, np.int64))
        else:
            off = _unplaned(lab, len(key)).astype(np.int64)
            ls.append(np.where(off == 0, -1, top - off + 1))
    key = np.concatenate(ks)
    return _summed(*_listed(key >> np.uint32(1), np.concatenate(ds), np.concatenate(ls), key & np.uint32(1) if kind % 2 else None, -(-FULL // kinds[kind // 2])))


def candidates(keys: DataFrame, parts: int) -> DataFrame:
    """(doc_a, doc_b) of documents that share as many keys as similar ones must and have no label in common."""
    pairs = keys.groupBy("bucket").applyInArrow(_pairer(parts), "part long, base long, many long, a binary, b binary, n binary")
    return pairs.groupBy("part").applyInArrow(_counted, "doc_a long, doc_b long")


# -- verification ----------------------------------------------------------------------------------------------------


def sketch(t: np.ndarray) -> np.ndarray:
    """How many grams of a set fall into each of a power of two of ranges of the hash, about 3 in each; 255 stands for more."""
    k = min(16, max(4, int(len(t) // 3).bit_length()))
    return np.minimum(np.bincount((t >> U64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8)


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """At least as many grams as two sets with these sketches share."""
    if len(a) < len(b):
        a, b = b, a
    full = 255 in a or 255 in b
    a = a.reshape(len(b), -1).sum(1, dtype=np.int64)
    return 1 << 60 if full else int(np.minimum(a, b).sum())


def _packed(docs: DataFrame, n: int, sketched: bool) -> DataFrame:
    """(doc_id, size, grams): the sorted gram hashes as bytes, or their sketch."""

    def run(batches):
        for b in batches:
            ids, sizes, sets = [], [], []
            for d, t in _each(b, n):
                ids.append(d)
                sizes.append(len(t))
                sets.append((sketch(t) if sketched else t).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "size", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, grams binary")


def _siever(d: float):
    """Drops the pairs whose sketches rule out a similarity of d."""

    def sieve(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        place = {i: k for k, i in enumerate(sets["doc_id"].to_pylist())}
        held = [np.frombuffer(x.as_buffer(), np.uint8) for x in sets["grams"]]
        size = sets["size"].to_pylist()
        keep = []
        for a, b in zip(pairs["doc_a"].to_pylist(), pairs["doc_b"].to_pylist()):
            a, b = place[a], place[b]
            need = d / (1 + d) * (size[a] + size[b]) - 1e-9
            keep.append(min(size[a], size[b]) >= need and most_shared(held[a], held[b]) >= need)
        return pairs.select(["doc_a", "doc_b"]).filter(pa.array(keep, pa.bool_()))

    return sieve


def _verifier(d: float):
    def verify(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        ids = np.asarray(sets["doc_id"])
        order = np.argsort(ids)
        ids = ids[order]
        tok = [np.frombuffer(sets["grams"][int(i)].as_buffer(), U64) for i in order]
        size = np.array([len(t) for t in tok], np.int64)
        first, second = np.searchsorted(ids, np.asarray(pairs["doc_a"])), np.searchsorted(ids, np.asarray(pairs["doc_b"]))
        order = np.argsort(first, kind="stable")
        first, second = first[order], second[order]
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True]))) if len(first) else np.zeros(1, np.int64)
        out_a, out_b, out_j = [], [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            a, b = first[i], second[i:j]
            b = b[(size[b] >= d * size[a] - 1e-9) & (size[a] >= d * size[b] - 1e-9)]
            for lo in range(0, len(b), 512):
                part = b[lo : lo + 512]
                flat = np.concatenate([tok[x] for x in part])
                at = np.searchsorted(tok[a], flat)
                at[at == size[a]] = 0
                both = np.add.reduceat(tok[a][at] == flat, np.concatenate(([0], np.cumsum(size[part])[:-1])), dtype=np.int64)
                sim = both / (size[a] + size[part] - both)
                ok = sim >= d - 1e-12
                out_a += [int(ids[a])] * int(ok.sum())
                out_b += ids[part[ok]].tolist()
                out_j += sim[ok].tolist()
        return pa.table({"doc_a": pa.array(out_a, pa.int64()), "doc_b": pa.array(out_b, pa.int64()), "jaccard": pa.array(out_j, pa.float64())})

    return verify


def _in_parts(docs: DataFrame, pairs: DataFrame, n: int, sketched: bool, judge, schema: str, name: str) -> DataFrame:
    """Pairs judged in parts, named after the least document that doc_a is paired with, so that the sets of a group of copies travel a few times, not once a pair.

    A part of more than PAIRS_AT_ONCE pairs is cut by doc_a.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("doc_a").alias("x"), F.col("doc_b").alias("y")), F.struct(F.col("doc_b").alias("x"), F.col("doc_a").alias("y")))).alias("e"))
    least = ends.groupBy("e.x").agg(F.least(F.min("e.y"), F.col("x")).alias("part")).select(F.col("x").alias("doc_a"), "part")
    parts = written(pairs.join(least, "doc_a").select("part", "doc_a", "doc_b", F.lit(0).alias("piece")), "parts")
    large = parts.groupBy("part").agg(F.ceil(F.count("*") / F.lit(PAIRS_AT_ONCE)).alias("cuts")).where("cuts > 1")
    if not large.isEmpty():
        whole = parts
        parts = written(whole.join(large, "part", "left").select("part", "doc_a", "doc_b", F.pmod(F.hash("doc_a"), F.coalesce("cuts", F.lit(1))).cast("int").alias("piece")), "parts")
        discard(whole)
    need = parts.select(F.col("part").alias("of"), F.col("piece").alias("cut"), F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    ids = written(need.select("doc_id").distinct(), "candidate-ids")
    sets = _packed(by_ids(docs, ids, "doc_id", "left_semi"), n, sketched)
    there = need.join(sets.hint("shuffle_hash"), "doc_id").select("of", "cut", "doc_id", "size", "grams")
    out = written(there.groupBy("of", "cut").cogroup(parts.groupBy("part", "piece")).applyInArrow(judge, schema), name)
    discard(parts, ids)
    return out


def verified(docs: DataFrame, pairs: DataFrame, n: int, d: float) -> DataFrame:
    """(doc_a, doc_b, jaccard) of all candidate pairs with a similarity of d or more, doc_a < doc_b.

    Sketches of the sets, which are far smaller, first drop the pairs that they rule out for certain.
    """
    left = _in_parts(docs, pairs, n, True, _siever(d), "doc_a long, doc_b long", "sieved")
    out = _in_parts(docs, left, n, False, _verifier(d), "doc_a long, doc_b long, jaccard double", "pairs")
    discard(left)
    return out


# -- crowds ----------------------------------------------------------------------------------------------------------


def leaders(signs: DataFrame) -> DataFrame:
    """(doc_id, leader) of the sets (doc_id, signs) that share a signature key with CROWD sets or more.

    The leader of a key is the set whose keys are the most common together; a set takes the leader of most of its keys.
    """
    keys = signs.select("doc_id", F.explode("signs").alias("key")).where("key <> 0")
    hot = written(keys.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") >= CROWD), "hot-keys")
    k = hot.count()
    crowd = written(keys.join(F.broadcast(hot) if k <= BROADCAST_IDS else hot.hint("merge"), "key"), "crowds")
    score = crowd.groupBy("doc_id").agg(F.sum("many").alias("score"))
    first = crowd.join(score, "doc_id").groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("of"))).alias("top")).select("key", "top.score", (-F.col("top.of")).alias("leader"))
    votes = crowd.join(first, "key").groupBy("doc_id", "leader").agg(F.count("*").alias("votes"), F.max("score").alias("score"))
    out = written(votes.groupBy("doc_id").agg(F.max(F.struct("votes", "score", (-F.col("leader")).alias("of"))).alias("top")).select("doc_id", (-F.col("top.of")).alias("leader")), "leaders")
    discard(hot, crowd)
    return out


def labelled(docs: DataFrame, lead: DataFrame, n: int, d: float) -> DataFrame:
    """(doc_id, label, size, apart, delta): the sets that are similar to their leader.

    delta: the sorted hashes of the grams that one of them lacks; apart: how far the set is from being half as far from the leader as similar sets may be from one another,
    scaled to a whole number. Two sets of a label whose ``apart`` add up to 0 or less are similar.
    """
    many, tops = lead.count(), lead.select(F.col("leader").alias("doc_id")).distinct()
    sets = written(_packed(by_ids(docs, tops, "doc_id", "left_semi"), n, False).select(F.col("doc_id").alias("leader"), F.col("grams").alias("of")), "leader-sets")
    held = sets.agg(F.sum(F.length("of"))).first()[0] or 0
    rows = docs.join(F.broadcast(lead) if many <= BROADCAST_IDS else lead.hint("merge"), "doc_id")
    rows = rows.join(F.broadcast(sets) if held <= BROADCAST_BYTES else sets.hint("merge"), "leader")
    over, under = _scaled(d)

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            lead, of = b.column(2).to_pylist(), b.column(3)
            for row, doc, t in _numbered(b, n):
                top = np.frombuffer(of[row].as_buffer(), U64)
                delta = np.setxor1d(t, top, assume_unique=True)
                if len(delta) * over <= (len(t) + len(top)) * under:
                    for k, v in zip(out, (doc, lead[row], len(t), len(delta) * over - len(t) * under, delta.tobytes())):
                        k.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (*[pa.int64()] * 4, pa.binary()))], names=["doc_id", "label", "size", "apart", "delta"])

    out = written(rows.select("doc_id", "text", "leader", "of").mapInArrow(run, "doc_id long, label long, size long, apart long, delta binary"), "labelled")
    discard(sets)
    return out


def _scaled(d: float) -> tuple[int, int]:
    """Whole numbers o, u so that sets with a difference of x and sizes of s together are similar if x * o <= s * u."""
    k = round(d * 1_000_000)
    return 1_000_000 + k, 1_000_000 - k


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """(doc_id, links): what verified pairs of a left, far set and a right one add to their links."""
    right = right.rename_columns([c.removeprefix("other_") for c in right.column_names])
    if not left.num_rows or not right.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    ids, apart, weight = ([np.asarray(t[c]) for t in (left, right)] for c in ("doc_id", "apart", "weight"))
    over = left["over"][0].as_py()
    delta = [[np.frombuffer(x.as_buffer(), U64) for x in t["delta"]] for t in (left, right)]
    flat = [np.concatenate(x) if x else np.empty(0, U64) for x in delta]
    both = np.intersect1d(*flat)
    shared = np.zeros((len(ids[0]), len(ids[1])), np.float32)
    place = []
    for x, f in zip(delta, flat):
        at = np.searchsorted(both, f)
        at[at == len(both)] = 0
        ok = both[at] == f if len(both) else np.zeros(len(f), bool)
        place.append((np.repeat(np.arange(len(x)), [len(y) for y in x])[ok], at[ok]))
    for lo in range(0, len(both), 4096):
        m = []
        for (row, col), x in zip(place, delta):
            part = (col >= lo) & (col < lo + 4096)
            one = np.zeros((len(x), min(4096, len(both) - lo)), np.float32)
            one[row[part], col[part] - lo] = 1
            m.append(one)
        shared += m[0] @ m[1].T
    total = apart[0][:, None] + apart[1][None, :]
    ok = (total > 0) & (total - 2 * over * shared.astype(np.int64) <= 0)
    far = apart[1] > 0  # two far sets meet twice
    ok &= ~far[None, :] | (ids[0][:, None] < ids[1][None, :])
    doc, links = np.concatenate(ids), np.concatenate((ok @ weight[1], ok.T @ weight[0]))
    return pa.table({"doc_id": pa.array(doc[links > 0], pa.int64()), "links": pa.array(links[links > 0].astype(np.int64), pa.int64())})


def crowd_links(rows: DataFrame, d: float) -> DataFrame:
    """(doc_id, links): how many documents of other sets of its label each set of ``rows`` (labelled, and weight: documents of the set) is similar to."""
    cells = rows.groupBy("label", "apart").agg(F.sum("weight").alias("weight"))
    # a cell is similar to the cells up to minus its own value: one pass in order, a question behind the cells of its value
    line = cells.select("label", F.col("apart").alias("at"), F.lit(0).alias("asks"), "weight", F.lit(None).cast("long").alias("apart")).unionByName(
        cells.select("label", (-F.col("apart")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("weight"), "apart")
    )
    sure = line.withColumn("sure", F.sum("weight").over(Window.partitionBy("label").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))).where("asks = 1").select("label", "apart", "sure")
    own = F.when(F.col("apart") <= 0, F.col("weight")).otherwise(0)
    certain = rows.join(sure, ["label", "apart"]).select("doc_id", (F.col("sure") - own).alias("links"))
    span = rows.groupBy("label").agg(F.max("apart").alias("farthest"), F.ceil(F.sum(F.when(F.col("apart") > 0, 1).otherwise(0)) / BLOCK).alias("lefts"))
    open_ = rows.join(span.where("farthest > 0"), "label").where(F.col("apart") > -F.col("farthest"))
    rights = open_.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("rights"))
    open_ = open_.join(rights, "label").withColumn("over", F.lit(_scaled(d)[0]))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = open_.where("apart > 0").select("label", place("lefts").alias("l"), every("rights").alias("r"), "doc_id", "apart", "weight", "over", "delta")
    right = open_.select("label", every("lefts").alias("l"), place("rights").alias("r"), "doc_id", "apart", "weight", "delta")
    right = right.select(*(F.col(c).alias("other_" + c) for c in right.columns))
    checked = left.groupBy("label", "l", "r").cogroup(right.groupBy("other_label", "other_l", "other_r")).applyInArrow(_block_links, "doc_id long, links long")
    return certain.unionByName(checked).groupBy("doc_id").agg(F.sum("links").alias("links"))


# -- the join --------------------------------------------------------------------------------------------------------


class Joined:
    """What the join finds.

    ``docs`` (doc_id, rep): every document with words, and the least document of an equal set; ``sets`` (rep, weight): how many documents have it;
    ``pairs`` (doc_a, doc_b, jaccard): similar sets that have no label in common; ``labelled``: see there.
    """

    def __init__(self, docs: DataFrame, sets: DataFrame, pairs: DataFrame, labelled: DataFrame):
        self.docs, self.sets, self.pairs, self.labelled = docs, sets, pairs, labelled

    def classes(self) -> DataFrame:
        """(rep, class_id) of the sets that are linked to others: the least set that links lead to."""
        edges = self.pairs.select("doc_a", "doc_b").unionByName(self.labelled.select(F.col("doc_id").alias("doc_a"), F.col("label").alias("doc_b")))
        return components(edges).select(F.col("doc_id").alias("rep"), F.col("root").alias("class_id"))


def keyed(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, bool]:
    """Documents with an id and a text, each once, with a 64-bit ``key``, and whether ids repeat.

    The key is the doc_id; where rows of one doc_id have several texts, a hash of both.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    num = F.col("doc_id").cast("long")
    many = docs.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.count("*").alias("k"), (F.min("h") != F.max("h")).alias("differ")).where("k > 1").select("doc_id", "differ")
    many = written(many, "repeated")
    r = many.count()
    if not r:
        discard(many)
        return docs.withColumn(key, num), False
    mark = [c for c in ("differ", "differ_", "differ__") if c not in docs.columns][0]
    many = many.withColumnRenamed("differ", mark)
    again = docs.join(F.broadcast(many) if r <= BROADCAST_IDS else many.hint("merge"), "doc_id").withColumn(key, F.when(F.col(mark), F.xxhash64("doc_id", "text")).otherwise(num))
    once = by_ids(docs, many.select("doc_id"), "doc_id", "left_anti", r).withColumn(key, num)
    return once.unionByName(again.dropDuplicates([key]).select(*map(_named, once.columns))), True


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> Joined:
    """All links of documents (doc_id long, text), each id once, whose n-gram sets have a Jaccard similarity of at least ``threshold`` (0.5 or more)."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be from 0.5 to 1")
    hashes = written(set_hashes(docs, n), "hashes")
    sets = written(hashes.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")), "equal-sets")
    reps, grams, shared, extra = (int(x or 0) for x in sets.agg(F.count("*"), F.sum("size"), F.count(F.when(F.col("weight") > 1, 1)), F.sum(F.col("weight") - 1)).first())
    several = sets.where("weight > 1").select("h1", "h2", "size", "rep")
    rep = written(hashes.join(F.broadcast(several) if shared <= BROADCAST_IDS else several.hint("merge"), ["h1", "h2", "size"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "signs"), "representatives")
    own = rep.where("doc_id = rep")
    lead = leaders(own.select("doc_id", "signs"))
    close = labelled(docs, lead, n, threshold)
    discard(hashes, lead)
    role = rep.where("doc_id <> rep").select("doc_id", F.lit(True).alias("gone"), F.lit(None).cast("long").alias("label")).unionByName(close.select("doc_id", F.lit(False).alias("gone"), "label"))
    k = extra + close.count()
    own = docs.select("doc_id", "text").join(F.broadcast(role) if k <= BROADCAST_IDS else role.hint("merge"), "doc_id", "left").where("gone IS NULL OR NOT gone").select("doc_id", "text", "label")
    p = plan(own, reps, n, threshold)
    buckets = max(1, math.ceil(grams * 5 / BUCKET_BYTES))
    possible = written(candidates(indexed(own, p, n, buckets), buckets), "candidates")
    pairs = verified(docs.select("doc_id", "text"), possible, n, threshold)
    discard(possible)
    return Joined(rep.select("doc_id", "rep"), sets.select("rep", "weight"), pairs, close)


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): each document that is similar to another one; those of no link have no row.

    links: how many other documents have a similarity of ``threshold`` or more with it, equal ones included. class_id: the least doc_id that links lead to;
    documents are in one class if and only if a chain of links connects them. A doc_id whose rows have several texts has a row for each linked one.
    """
    known, repeats = keyed(docs.select("doc_id", "text"), "key")
    found = join(known.select(F.col("key").alias("doc_id"), "text"), n, threshold)
    pairs = found.pairs.select(F.explode(F.array(F.struct(F.col("doc_a").alias("x"), F.col("doc_b").alias("rep")), F.struct(F.col("doc_b").alias("x"), F.col("doc_a").alias("rep")))).alias("e")).select("e.*")
    other = pairs.join(found.sets, "rep").groupBy("x").agg(F.sum("weight").alias("links")).select(F.col("x").alias("rep"), "links")
    crowd = crowd_links(found.labelled.join(found.sets.withColumnRenamed("rep", "doc_id"), "doc_id"), threshold).withColumnRenamed("doc_id", "rep")
    links = other.unionByName(crowd).groupBy("rep").agg(F.sum("links").alias("links"))
    own = found.sets.join(links, "rep", "left").join(found.classes(), "rep", "left").select("rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("class_id", "rep").alias("class_id")).where("links > 0")
    own = written(own, "links")
    k = own.count()
    out = found.docs.join(F.broadcast(own) if k <= BROADCAST_IDS else own.hint("merge"), "rep").select("doc_id", "class_id", "links")
    if not repeats:
        return out
    names = known.select(F.col("key").alias("doc_id"), F.col("doc_id").cast("long").alias("name"))
    out = out.join(names, "doc_id").select("name", "class_id", "links")
    least = out.groupBy("class_id").agg(F.min("name").alias("least"))
    return out.join(least, "class_id").select(F.col("name").alias("doc_id"), F.col("least").alias("class_id"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the least id that each document of the edges (doc_a, doc_b) is connected to.

    Up to EDGES_AT_ONCE edges by union and find in one task; beyond it by alternating large-star and small-star rounds, a logarithmic number of them,
    each written to the shared folder. In these, edges meet the least neighbour of their end by a join, so no hub's neighbours are collected.
    """
    e = edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    if e.count() <= EDGES_AT_ONCE:
        return e.coalesce(1).mapInArrow(_united, "doc_id long, root long")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "edges")
        same = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        discard(e, large)
        e = new
        if same:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))


def _united(batches):
    """(doc_id, root) of all nodes of the edges, by halving of paths; a root is the least of its component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    for lo in range(0, len(nodes), 1 << 16):
        part = nodes[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["doc_id", "root"])


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with only the least doc_id of each group of near or exact copies; columns as they are.

    Rows with a null doc_id or text stay. Of rows that repeat a doc_id and a text one stays. Where rows of a doc_id have several texts,
    each stands for itself; which one of its group stays then goes by a hash of both.
    """
    key = next(f"key{k or ''}" for k in range(len(docs.columns) + 1) if f"key{k or ''}" not in docs.columns)
    known, repeats = keyed(docs, key)
    found = join(known.select(F.col(key).alias("doc_id"), "text"), n, threshold)
    classes = written(found.classes().select("rep", "class_id"), "classes")
    k = classes.count()
    gone = found.docs.join(F.broadcast(classes) if k <= BROADCAST_IDS else classes.hint("merge"), "rep", "left").where(F.col("doc_id") != F.coalesce("class_id", "rep")).select(F.col("doc_id").alias(key))
    gone = written(gone, "gone")
    rest = by_ids(known, gone, key, "left_anti").drop(key)
    return rest.select(*map(_named, docs.columns)).unionByName(docs.where(F.col("doc_id").isNull() | F.col("text").isNull()))


def _named(name: str) -> str:
    """A column's name, quoted."""
    return "`" + name.replace("`", "``") + "`"


__all__ = ["Joined", "components", "join", "keep_one", "near_duplicates"]
