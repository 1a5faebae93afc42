"""Toxicity: maximum-scoring segments of token log-odds.

A bounded sample of labelled documents gives token counts of both classes; copies within the sample count once. A word's score is the
log of its probability in toxic text over that in clean text, each smoothed by a Dirichlet prior that is proportional to the word's background frequency. Words whose
document-level log-odds are not significantly positive are pooled into one class with one, slightly negative score. So scores are log likelihood ratios, and
the best segment of a clean document of n words has P(M >= s) = 1 - exp(-K n e^-s), an extreme-value law whose K is fitted on the best segments of held-out clean documents.

Every document is scanned once, whole, for all its maximal-scoring segments (linear time); a segment is a toxic passage if so good a
segment is expected fewer than ``ALPHA`` times in the clean text of its document. A document is toxic if it has one. Its p-value is the chance that clean text of its length has
as many passages as it has that are as good as its least one: their number is Poisson, with the E-value as its mean.

Defined results: ids are integers, or strings of them (others fail in the cast); null, empty and wordless texts have no passages; every row is scanned by itself, so rows that are repeated give their passages again, and a
null doc_id is carried as null; passages with equal scores are all given. Without labelled documents of both kinds nothing is toxic and the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .labelled import labelled_texts

#: Labelled rows that the word scores are fitted on, at most.
LABELLED = 8000
#: Tokens that the prior weighs, least z-score of a toxic word, expected false passages in a document, least K.
PRIOR, Z_MIN, ALPHA, K_MIN = 500.0, 5.0, 1e-3, 0.02
BANDS, SPAN = 4, 6
U64 = np.uint64
SCHEMA = "doc_id long, toxic boolean, passage int, start_byte long, end_byte long, words long, score double, evalue double, doc_p double, doc_passages int"


def segments(at: np.ndarray, gain: np.ndarray, drift: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after, score) of n words that score ``-drift`` but for those ``at`` some places, which score ``gain`` > 0.

    Ruzzo and Tompa's scan: each candidate keeps the cumulative score before and after it, and a link to the last candidate before it with a lower score before it;
    it absorbs earlier ones while that pays. Whatever a search passes over is never met again, so the time is in proportion to the places.
    """
    lefts, rights, first, last, link = [], [], [], [], []
    total, before = 0.0, 0
    for p, g in zip(at.tolist(), gain.tolist()):
        total -= drift * (p - before)
        before = p + 1
        lo, start = total, p
        total += g
        hi = total
        j = len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= lo:
                j = link[j]
            if j < 0 or rights[j] >= hi:
                lefts.append(lo)
                rights.append(hi)
                first.append(start)
                last.append(p + 1)
                link.append(j)
                break
            lo, start, k = lefts[j], first[j], link[j]
            del lefts[j:], rights[j:], first[j:], last[j:], link[j:]
            j = k
    return [(a, b, r - l) for a, b, l, r in zip(first, last, lefts, rights)]


class Model:
    """Hashes of toxic words in order, their scores, the score of all others, and K."""

    def __init__(self, words: np.ndarray, gain: np.ndarray, drift: float, k: float = 1.0):
        self.words, self.gain, self.drift, self.k = words, gain, drift, k

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of toxic words and their scores."""
        if not len(self.words) or not len(h):
            return np.empty(0, np.int64), np.empty(0)
        low = np.searchsorted(self.words, h)
        low[low == len(self.words)] = 0
        at = np.flatnonzero(self.words[low] == h)
        return at, self.gain[low[at]]


def _doc_rows(docs: DataFrame) -> list[dict]:
    """(toxic, hashes, counts, bands, order) of each labelled document, ordered by content.

    order: the place of each of its words among its hashes, for a third of the clean documents, chosen by content; empty for the others.
    """

    def run(batches):
        salts = K.mix(np.arange(1, BANDS + 1, dtype=U64))
        for b in batches:
            rows = {"toxic": [], "hashes": [], "counts": [], "bands": [], "order": []}
            toxic = b.column(1).to_pylist()
            for c in K.chunks(b.column(0)):
                h, ptr = c.hashes()
                for k, r in enumerate(c.rows):
                    own = h[ptr[k] : ptr[k + 1]]
                    if len(own):
                        u, inverse, n = np.unique(own, return_inverse=True, return_counts=True)
                        g = K.grams(own, SPAN)
                        least = np.array([K.mix(g ^ s).min() for s in salts])
                        rows["toxic"].append(toxic[r])
                        rows["hashes"].append(u.tobytes())
                        rows["counts"].append(n.astype(np.int64).tobytes())
                        rows["bands"].append(least.tobytes())
                        rows["order"].append(inverse.astype(np.uint32).tobytes() if not toxic[r] and least[0] % U64(3) == 0 else b"")
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("toxic", pa.int32()), *((k, pa.binary()) for k in ("hashes", "counts", "bands", "order"))]))

    got = docs.select("text", "toxic").mapInArrow(run, "toxic int, hashes binary, counts binary, bands binary, order binary").collect()
    return sorted((r.asDict() for r in got), key=lambda r: (r["bands"], r["hashes"], r["toxic"]))


def _once(rows: list[dict]) -> list[dict]:
    """Rows without those that share a sketch with one before them: copies count once."""
    seen: set[tuple[int, bytes]] = set()
    out = []
    for r in rows:
        keys = [(k, bytes(r["bands"][8 * k : 8 * k + 8])) for k in range(BANDS)]
        if not any(x in seen for x in keys):
            out.append(r)
        seen.update(keys)
    return out


def _pooled(rows: list[dict], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and documents of each word."""
    tokens, docs = np.zeros(len(words)), np.zeros(len(words))
    for r in rows:
        at = np.searchsorted(words, np.frombuffer(r["hashes"], U64))
        tokens[at] += np.frombuffer(r["counts"], np.int64)
        docs[at] += 1
    return tokens, docs


def _root(dt: np.ndarray, dc: np.ndarray, at: int, ac: int) -> np.ndarray:
    """Signed root of the G statistic of two shares, about a standard normal if the shares are equal."""
    both = dt + dc
    g = np.zeros(len(dt))
    for seen, of in ((dt, at), (dc, ac)):
        for o, e in ((seen, both * of / (at + ac)), (of - seen, of - both * of / (at + ac))):
            g += np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return np.sign(dt / at - dc / ac) * np.sqrt(2 * np.maximum(g, 0.0))


def learn(rows: list[dict]) -> Model:
    """The word scores of labelled documents. About every third clean document, with its words in order, is held out for K."""
    rows = _once(rows)
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    held, clean = [r for r in clean if r["order"]], [r for r in clean if not r["order"]]
    if not toxic or not clean:
        return Model(np.empty(0, U64), np.empty(0), 0.0)
    words = np.unique(np.concatenate([np.frombuffer(r["hashes"], U64) for r in toxic + clean]))
    yt, dt = _pooled(toxic, words)
    yc, dc = _pooled(clean, words)
    nt, nc = yt.sum(), yc.sum()
    prior = PRIOR * (yt + yc) / (nt + nc)
    # signed root of the log likelihood ratio of the documents that have the word: bursts within one document don't count as evidence
    at, ac = len(toxic), len(clean)
    z = _root(dt, dc, at, ac)
    pick = z >= Z_MIN
    qt, qc = (yt + prior) / (nt + PRIOR), (yc + prior) / (nc + PRIOR)
    gain = np.log(qt / qc)
    pick &= gain > 0.5
    if not pick.any():
        return Model(np.empty(0, U64), np.empty(0), 0.0)
    drift = float(np.log((1 - qc[pick].sum()) / (1 - qt[pick].sum())))
    m = Model(words[pick], gain[pick], max(drift, 1e-4))
    m.k = rate([best_of(m, r) for r in held])
    return m


def best_of(m: Model, row: dict) -> tuple[int, float]:
    """(words, score of the best segment) of a document that has its words in order."""
    h = np.frombuffer(row["hashes"], U64)[np.frombuffer(row["order"], np.uint32)]
    at, gain = m.found(h)
    return len(h), max((s for _, _, s in segments(at, gain, m.drift, len(h))), default=0.0)


def rate(best: list[tuple[int, float]]) -> float:
    """K of the extreme-value law: n e^-M is exponential with this rate. A document without a segment has no score, so its n is a lower bound of that."""
    if not best:
        return 1.0
    return max(K_MIN, sum(s > 0 for _, s in best) / sum(n * np.exp(-s) for n, s in best))


def at_least(r: int, mean: float) -> float:
    """The chance of r or more events of a Poisson law."""
    term = math.exp(-mean + r * math.log(max(mean, 1e-300)) - math.lgamma(r + 1))
    total, k = 0.0, r
    while term > total * 1e-17 and k < r + 200:
        total += term
        k += 1
        term *= mean / k
    return min(total, 1.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Model:
    """Fit on at most ``rows`` labelled documents."""
    return learn(_doc_rows(labelled_texts(docs, labels, ["toxic"], rows, 2)))


def scan(docs: DataFrame, model: Model, alpha: float = ALPHA) -> DataFrame:
    """The toxic passages of all documents, see SCHEMA."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]

    def run(batches):
        m = sent.value
        for b in batches:
            ids, gone = K.id_array(b.column(0))
            out = []
            for c in K.chunks(b.column(1)):
                h, ptr = c.hashes()
                st, en, _ = c.words()
                at, gain = m.found(h)
                if not len(at):
                    continue
                bounds = np.searchsorted(at, ptr)
                for k in np.flatnonzero(np.diff(bounds)):
                    i, j, n = bounds[k], bounds[k + 1], int(ptr[k + 1] - ptr[k])
                    found = [(a, e, s, m.k * n * float(np.exp(-s))) for a, e, s in segments(at[i:j] - ptr[k], gain[i:j], m.drift, n)]
                    found = [x for x in found if x[3] < alpha]
                    if found:
                        r = c.rows[k]
                        p = at_least(len(found), max(x[3] for x in found))
                        for no, (a, e, s, ev) in enumerate(found):
                            out.append((None if gone[r] else int(ids[r]), True, no, int(st[ptr[k] + a] - c.off[k]), int(en[ptr[k] + e - 1] - c.off[k]), e - a, s, ev, p, len(found)))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def toxic_passages(docs: DataFrame, labels: DataFrame, rows: int = LABELLED, alpha: float = ALPHA) -> DataFrame:
    """Every significant toxic passage: its bytes, words, score and E-value, with the document's p-value."""
    return scan(docs, fit(docs, labels, rows), alpha)
