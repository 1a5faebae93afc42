"""Quality rules: an isolation forest on rule statistics.

Each document gives the statistics of common quality rules (lengths, symbols, capitals, repeats, line shapes). Random trees split them at random;
documents that are isolated after short paths are anomalous. There is a forest on all statistics and one on each, fitted on a bounded sample of
labelled rows that are good; the threshold of each forest's anomaly score is calibrated on the labelled rows. A document is kept that is below all thresholds.

Defined results: a null or empty text has statistics of 0 and no words, and is rejected; every row gives one row, repeated rows too; a null doc_id is kept.
A document whose score equals a threshold is kept. Without labelled rows of both kinds nothing is known to be bad: only wordless texts are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .labelled import labelled_texts

#: Labelled rows that fit and calibrate; trees and the rows of each.
LABELLED, TREES, ROWS = 6000, 120, 256
#: Share of the good held-out rows that each threshold must keep.
KEEP_GOOD = 0.998
#: What a lost share of the good rows weighs against an equal share of bad rows caught.
LOSS = 16
NAMES = ["words", "word_length", "upper", "digits", "symbols", "shouts", "stutter", "top_word", "repeated_pairs", "line_words", "stops"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^`{|}~[]"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), ord("?")]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(","), ord(";"), ord(":")]] = True


def _per_doc(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return (c[off[1:]] - c[off[:-1]]).astype(float)


def statistics(c: K.Texts) -> np.ndarray:
    """One row of rule statistics for each text; ratios are drawn towards 0 in short texts."""
    b, off = c.data, c.off
    st, en, _ = c.words()
    h, ptr = c.hashes()
    n = np.diff(ptr).astype(float)
    letters = (en - st).astype(float)
    cum = np.concatenate(([0.0], np.cumsum(letters)))
    chars = cum[ptr[1:]] - cum[ptr[:-1]]
    out = np.zeros((len(c), len(NAMES)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = chars / np.maximum(n, 1)
    out[:, 2] = _per_doc((b >= 65) & (b <= 90), off) / (chars + 40)
    out[:, 3] = _per_doc((b >= 48) & (b <= 57), off) / (chars + 40)
    out[:, 4] = _per_doc(_SYMBOL[b], off) / (n + 10)
    out[:, 5] = _per_doc(_SHOUT[b], off) / (n + 10)
    inside = np.ones(len(h), bool)
    inside[ptr[1:-1][ptr[1:-1] < len(h)]] = False
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & inside[1:]
    out[:, 6] = _per_doc(same, ptr) / (n + 10)
    two = K.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    for k in range(len(c)):
        i, j = ptr[k], ptr[k + 1]
        if j - i > 1:
            w = np.sort(h[i:j])
            cut = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
            out[k, 7] = (np.diff(cut).max() - 1) / (j - i + 10)
            p = np.sort(two[i : j - 1])
            out[k, 8] = (p[1:] == p[:-1]).sum() / (j - i + 10)
    out[:, 9] = np.log1p(n / (_per_doc(b == 10, off) + 1))
    out[:, 10] = _per_doc(_STOP[b], off) / (n + 10)
    return out


class Forest:
    """Isolation forest: ``score`` is 2 ** (-mean path length / expected path length), near 1 for anomalies."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        self.norm = _expected(rows)
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, np.int16)
        self.split = np.zeros((trees, size))
        self.length = np.zeros((trees, size))
        for t in range(trees):
            self._grow(t, 0, x[rng.choice(len(x), rows, replace=False)], 0, rng)

    def _grow(self, t, node, x, depth, rng):
        lo, hi = x.min(0), x.max(0)
        able = np.flatnonzero(hi > lo)
        if depth == self.depth or len(x) <= 1 or not len(able):
            self.length[t, node] = depth + _expected(len(x))
            return
        f = rng.choice(able)
        v = rng.uniform(lo[f], hi[f])
        self.feature[t, node], self.split[t, node] = f, v
        left = x[:, f] <= v
        self._grow(t, 2 * node + 1, x[left], depth + 1, rng)
        self._grow(t, 2 * node + 2, x[~left], depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                go = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.split[t, node]
                node = np.where(go, 2 * node + 1 + right, node)
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _spread(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Statistics on the scale of good rows, with what lies far outside pulled in to a few widths."""
    return np.clip((x - lo) / (hi - lo), -3.0, 4.0)


class Model:
    """A forest on all statistics and one on each statistic, each with its own threshold.

    ``judge`` gives the greatest ratio of score to threshold over the forests, and keeps what is not above 1.
    """

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.forests = []
        if good.sum() < 8 or (~good).sum() < 1:
            return
        clean = np.flatnonzero(good)
        fit, held = clean[::2], clean[1::2]
        self.lo, self.hi = np.quantile(x[fit], 0.005, axis=0), np.quantile(x[fit], 0.995, axis=0)
        self.hi = np.where(self.hi - self.lo > 1e-3, self.hi, self.lo + 0.05)
        z = _spread(x, self.lo, self.hi)
        rng = np.random.default_rng(5)
        able = []
        for k, own in enumerate([list(range(x.shape[1])), *[[f] for f in range(x.shape[1])]]):
            base = z[fit][:, own]
            # rows beyond the range of the good ones, so that there are splits outside it
            edge = base[rng.integers(0, len(base), max(8, len(base) // 16))]
            edge[np.arange(len(edge)), rng.integers(0, len(own), len(edge))] = rng.uniform(-3.0, 4.0, len(edge))
            forest = Forest(np.concatenate((base, edge)), TREES if k == 0 else TREES // 3, seed=k)
            s = forest.score(z[:, own])
            able.append((own, forest, s, np.quantile(s[held], KEEP_GOOD)))
        # one forest after another, each with the threshold that adds most to those before it
        left = np.ones(len(x), bool)
        while True:
            tried = []
            for k, (own, forest, s, floor) in enumerate(able):
                bad, fine = np.sort(s[~good & left]), np.sort(s[good & left])
                cand = np.unique(np.concatenate(([floor], bad[bad > floor] - 1e-9)))
                gain = (len(bad) - np.searchsorted(bad, cand, "right")) / (~good).sum() - LOSS * (len(fine) - np.searchsorted(fine, cand, "right")) / good.sum()
                best = int(gain.argmax())
                tried.append((float(gain[best]), -k, float(cand[best])))
            gain, k, limit = max(tried)
            if gain < 0.002:
                return
            own, forest, s, _ = able[-k]
            self.forests.append((own, forest, limit))
            left &= s <= limit

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ratio = np.zeros(len(x))
        if self.forests:
            z = _spread(x, self.lo, self.hi)
            for own, forest, limit in self.forests:
                ratio = np.maximum(ratio, forest.score(z[:, own]) / limit)
        return ratio, (ratio <= 1.0) & (x[:, 0] > 0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Model:
    """Fit on at most ``rows`` labelled documents."""

    def run(batches):
        for b in batches:
            x = [statistics(c) for c in K.chunks(b.column(0))]
            x = np.concatenate(x) if x else np.empty((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "quality"])

    got = labelled_texts(docs, labels, ["quality"], rows, 10).select("text", "quality").mapInArrow(run, "x array<double>, quality int").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)
    return Model(x[order], np.asarray(got["quality"])[order] == 1)


def scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns, ``anomaly`` and ``keep`` of every row."""
    names = [f"c{k}" for k in range(len(carry))]

    # the text travels once, among the carried columns if it is one of them
    at = carry.index("text") if "text" in carry else len(carry)

    def run(batches):
        for b in batches:
            x = [statistics(c) for c in K.chunks(b.column(at))]
            s, keep = model.judge(np.concatenate(x) if x else np.empty((0, len(NAMES))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(s), pa.array(keep)], names=[*names, "anomaly", "keep"])

    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], *(["text"] if at == len(carry) else []))
    schema = T.StructType([*d.schema.fields[: len(carry)], T.StructField("anomaly", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return d.mapInArrow(run, schema).toDF(*carry, "anomaly", "keep")


def quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """(doc_id, anomaly, keep) of every row of the documents."""
    return scored(docs, fit(docs, labels, rows), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """The documents that the model keeps, with their columns as they are."""
    columns = docs.columns
    marked = scored(docs, fit(docs, labels, rows), columns)
    plain = [f"c{k}" for k in range(len(columns))]  # whatever the columns are called
    return marked.toDF(*plain, "anomaly", "keep").where("keep").select(*plain).toDF(*columns)
