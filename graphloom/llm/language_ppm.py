"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes, counted on a bounded sample of its distinct texts and then frozen. A byte is coded in the longest
context that is known, or after an escape in the next shorter one, down to a uniform code of the 256 bytes. A symbol seen c times in a
context of t symbols of which d differ has probability c / (t + d), an escape d / (t + d). As statistics are frozen, the code length of a byte is a function of
the bytes before it: all contexts of all languages become the states of one automaton with a table of code lengths, so that a
text is scored whole, with a few array look-ups a byte. The table holds each code length to the nearest 1/256 bit: a text's total is within 1/512 bit a byte of the
sum of the exact ones. An entry goes up to 128 bits, which no code length exceeds while a language's sample has fewer than 16 million bytes.
Contexts of three bytes and more that were seen fewer than ``SEEN`` times in all samples are no part of the trees: their shorter ones stand for them.

The language with the least code length wins. A text is accepted if it takes no more bits than texts of its language are known to take, with an allowance for
short texts. Ties go to the language that is first in order.

Defined results: null and empty texts have a null language and no score, and are rejected; every row gives one row, repeated rows and null ids too; languages with
null names or fewer than ``LEAST`` distinct texts are not learnt. With no language learnt all rows are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

ORDER = 4
#: Sampled distinct texts of each language that are counted (half as many again only set the acceptance limit), and the fewest that make a language.
SAMPLE, LEAST = 160, 3
#: Contexts seen fewer times than this in all languages together are dropped from the trees (longer than 2 bytes).
SEEN = 3
#: Bits by which a text may exceed the limit, whatever its length, and the share by which the limit exceeds the worst known rate.
ALLOWANCE, MARGIN = 120.0, 1.4
UNIT = 256.0


class Model:
    """The automaton. ``cost[state * symbols + symbol]`` holds the code lengths of all languages in 1/256 bits."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs = sorted(texts)
        self.order = order
        self.limit = np.full(len(self.langs), np.inf)
        if self.langs:
            self._build(texts)

    def _build(self, texts: dict[str, list[bytes]]) -> None:
        self.symbol = np.zeros(256, np.int64)
        seen = np.zeros(256, bool)
        for group in texts.values():
            for t in group:
                seen[np.unique(np.frombuffer(t, np.uint8))] = True
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        a = self.a = int(seen.sum()) + 1  # symbol 0: bytes that no sample has
        n_lang = len(self.langs)
        # joined texts, a run of symbol 0 between two: contexts never reach into another text
        seqs = [[np.concatenate([self.symbol[np.frombuffer(t, np.uint8)], np.zeros(self.order + 1, np.int64)]) for t in texts[l]] for l in self.langs]
        flat = np.concatenate([x for s in seqs for x in s])
        lang = np.repeat(np.arange(n_lang), [sum(len(x) for x in s) for s in seqs])
        real = flat > 0
        # nodes of depth k: contexts of k symbols; at[i]: the context that ends before i, -1 where it isn't in the tree
        at = np.zeros(len(flat), np.int64)
        self.child = []  # per depth: (sorted keys symbol-first, ids) of the contexts one symbol longer
        base = np.full((1, a, n_lang), 8.0, np.float32)
        self.levels = [{"cost": base, "n": 1}]
        parent = np.zeros(1, np.int64)
        for k in range(self.order + 1):
            # counts of the symbols after contexts of depth k, some contexts at a time
            ok = (at >= 0) & real
            size = self.levels[k]["n"]
            cell = np.sort((at[ok] * a + flat[ok]) * n_lang + lang[ok])
            cost = np.empty((size, a, n_lang), np.float32)
            for lo in range(0, size, 1024):
                hi = min(lo + 1024, size)
                i, j = np.searchsorted(cell, [lo * a * n_lang, hi * a * n_lang])
                c = np.bincount(cell[i:j] - lo * a * n_lang, minlength=(hi - lo) * a * n_lang).reshape(hi - lo, a, n_lang)
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                lower = base if k == 0 else self.levels[k - 1]["cost"][parent[lo:hi]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = -np.log2(c / (total + kinds))
                    escape = -np.log2(kinds / (total + kinds))
                cost[lo:hi] = np.where(c > 0, own, np.where(total > 0, escape + lower, lower))
            self.levels[k]["cost"] = cost
            del cell, ok
            if k == self.order:
                break
            # contexts of depth k + 1, as (context of the last k symbols, symbol before them)
            before = np.full(len(flat), -1, np.int64)
            if k + 1 <= len(flat):
                before[k + 1 :] = np.where(real[: len(flat) - k - 1], flat[: len(flat) - k - 1], -1)
            ok = (at >= 0) & (before > 0)
            key = np.full(len(flat), -1, np.int64)
            key[ok] = at[ok] * a + before[ok]
            u, times = np.unique(key[ok & real], return_counts=True)
            u = u[times >= (1 if k < 2 else SEEN)]
            self.child.append(u)
            if len(u) == 0:
                self.order = k
                break
            pos = np.searchsorted(u, key)
            pos[pos == len(u)] = 0
            at = np.where(u[pos] == key, pos, -1)
            del pos, key, before
            parent = u // a
            self.levels.append({"n": len(u)})
        self._compile(parent)

    def _compile(self, _) -> None:
        """One table: states of all depths in a row; ``start`` gives the first of each depth."""
        self.start = np.concatenate(([0], np.cumsum([x["n"] for x in self.levels])))
        self.width = -(-len(self.langs) // 4) * 4
        packed = np.zeros((int(self.start[-1]) * self.a, self.width), np.int16)
        for x, first in zip(self.levels, self.start):
            cost = x.pop("cost").reshape(-1, len(self.langs))
            for lo in range(0, len(cost), 1 << 18):
                part = cost[lo : lo + (1 << 18)]
                packed[first * self.a + lo : first * self.a + lo + len(part), : len(self.langs)] = np.minimum(np.round(part * UNIT), 32767)
        self.cost = packed.view(np.int64)
        # step[k]: from a context of depth k (row) and the symbol before it to the context of depth k + 1, or -1
        self.step = []
        for k, u in enumerate(self.child[: len(self.levels) - 1]):
            t = np.full(self.levels[k]["n"] * self.a, -1, np.int32)
            t[u] = np.arange(len(u))
            self.step.append(t)
        del self.levels, self.child

    def bits(self, c: K.Texts) -> np.ndarray:
        """Code lengths of the texts under each language."""
        s = self.symbol[c.data]
        out = np.zeros((len(c), len(self.langs)))
        if not len(s):
            return out
        # symbols before each byte, none across the start of its text
        place = np.arange(len(s)) - np.repeat(c.off[:-1], np.diff(c.off))
        state = np.zeros(len(s), np.int64)
        deep = np.zeros(len(s), np.int64)
        live = np.arange(len(s))
        for k, t in enumerate(self.step):
            live = live[place[live] > k] if k < 8 else live
            nxt = t[deep[live] * self.a + s[live - k - 1]]
            hit = nxt >= 0
            live = live[hit]
            deep[live] = nxt[hit]
            state[live] = nxt[hit] + self.start[k + 1]
        got = self.cost[state * self.a + s]
        lanes = got.view(np.int16).reshape(len(s), self.width)
        cum = np.zeros(len(s) + 1, np.int64)
        for j in range(len(self.langs)):
            np.cumsum(lanes[:, j], dtype=np.int64, out=cum[1:])
            out[:, j] = (cum[c.off[1:]] - cum[c.off[:-1]]) / UNIT
        return out

    def calibrate(self, texts: dict[str, list[bytes]]) -> None:
        """Set each language's limit in bits a byte from texts that were not counted."""
        for j, l in enumerate(self.langs):
            group = [t for t in texts.get(l, []) if len(t) >= 100]
            if group:
                c = next(K.chunks(pa.array(group, pa.binary()), 1 << 40))
                self.limit[j] = float((self.bits(c)[:, j] / np.diff(c.off)).max()) * MARGIN

    def judge(self, c: K.Texts):
        """Winning language (-1: none), bits a byte, bits by which the runner-up is worse, and acceptance."""
        n = np.diff(c.off)
        if not self.langs:
            return np.full(len(c), -1), np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c), bool)
        b = self.bits(c)
        best = b.argmin(1)
        least = b[np.arange(len(c)), best]
        margin = np.partition(b, 1, axis=1)[:, 1] - least if len(self.langs) > 1 else np.zeros(len(c))
        ok = (n > 0) & (least <= self.limit[best] * n + ALLOWANCE)
        return np.where(n > 0, best, -1), least / np.maximum(n, 1), margin, ok


def chosen(docs: DataFrame, most: int) -> DataFrame:
    """(lang, text, r): of each value of ``lang`` the ``most`` distinct texts of least hash ``r``, or all that it has; languages of fewer than LEAST distinct texts have none."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text", F.xxhash64("text", F.lit(1)).alias("r"))
    # hashes alone decide how far each language goes; then each text within comes once
    place = F.row_number().over(Window.partitionBy("lang").orderBy("r"))
    least = labelled.select("lang", "r").distinct().withColumn("k", place).where(F.col("k") <= most)
    tops = least.groupBy("lang").agg(F.max("r").alias("top"), F.count("*").alias("n")).where(F.col("n") >= LEAST).drop("n").collect()
    top = labelled.sparkSession.createDataFrame(tops, "lang string, top long")
    return labelled.join(F.broadcast(top), "lang").where(F.col("r") <= F.col("top")).select("lang", "text", "r").dropDuplicates(["lang", "text"])


def fit(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Fit on ``sample`` distinct texts of each value of ``lang``, chosen by hash; half as many again set the limits."""
    got: dict[str, list] = {}
    for r in chosen(docs, int(1.5 * sample)).toLocalIterator():
        got.setdefault(r["lang"], []).append((r["r"], r["text"].encode()))
    count, held = {}, {}
    for l in sorted(got):
        rows = [t for _, t in sorted(got[l])]
        count[l] = [t for k, t in enumerate(rows) if k % 3 < 2]
        held[l] = [t for k, t in enumerate(rows) if k % 3 == 2] or rows
    m = Model(count, order)
    m.calibrate(held)
    return m


def scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns, then lang_id, bits_per_byte, margin_bits and accepted, of every row."""
    names = [f"c{k}" for k in range(len(carry))]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # the text travels once, among the carried columns if it is one of them
    at = carry.index("text") if "text" in carry else len(carry)

    def run(batches):
        m = sent.value
        names_of = np.array([*m.langs, None], object)
        for b in batches:
            parts = [m.judge(c) for c in K.chunks(b.column(at))]
            best, rate, margin, ok = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, int), np.empty(0), np.empty(0), np.empty(0, bool))
            none = best < 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(carry)], pa.array(names_of[best], pa.string()), pa.array(rate, pa.float64(), mask=none), pa.array(margin, pa.float64(), mask=none), pa.array(ok)],
                names=[*names, "lang_id", "bits_per_byte", "margin_bits", "accepted"],
            )

    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], *(["text"] if at == len(carry) else []))
    more = [("lang_id", T.StringType()), ("bits_per_byte", T.DoubleType()), ("margin_bits", T.DoubleType()), ("accepted", T.BooleanType())]
    schema = T.StructType([*d.schema.fields[: len(carry)], *[T.StructField(n, t) for n, t in more]])
    return d.mapInArrow(run, schema).toDF(*carry, *[n for n, _ in more])


def identify(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, lang_id, bits_per_byte, margin_bits, accepted) of every row."""
    return scored(docs, fit(docs, sample, order), ["doc_id", "lang"])


def keep_known(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """The documents of an accepted language, with their columns as they are."""
    columns = docs.columns
    s = scored(docs, fit(docs, sample, order), columns)
    plain = [f"c{k}" for k in range(len(columns))]  # whatever the columns are called
    return s.toDF(*plain, "lang_id", "rate", "margin", "accepted").where("accepted").select(*plain).toDF(*columns)
