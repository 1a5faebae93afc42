"""The pipeline's stages, one after another on whole tables, each against a plain computation on its own input."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bestfit_packing, decontaminate, language_ppm, ngram_join, quality_forest
from graphloom.llm import textkit as K
from graphloom.session import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input rows, output rows) by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.selectExpr("*", "doc_id AS key", "text AS __keep", "1 AS c0", "'x' AS accepted")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_stages_keep_columns_and_rows_as_they_are(stages):
    for name, (before, after, had, have) in stages.items():
        if name != "packing":
            assert had == have and set(map(tuple, after)) <= set(map(tuple, before)) and len(after) <= len(before), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "packing"]


def test_quality_stage(spark, stages):
    before, after, *_ = stages["quality"]
    m = quality_forest.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def kept(text):
        x = quality_forest.statistics(next(K.chunks(pa.array([text]))))[0] if text else np.zeros(len(quality_forest.NAMES))
        if x[0] == 0:
            return False
        z = np.clip((x - m.lo) / (m.hi - m.lo), -3, 4) if m.forests else x
        for own, f, limit in m.forests:
            total = 0.0
            for t in range(len(f.feature)):
                node = 0
                while f.feature[t, node] >= 0:
                    node = 2 * node + (2 if z[own][f.feature[t, node]] > f.split[t, node] else 1)
                total += f.length[t, node]
            if 2.0 ** (-total / len(f.feature) / f.norm) > limit * (1 + 1e-12):
                return False
        return True

    assert {r.doc_id for r in after} == {r.doc_id for r in before if kept(r.text)} and 0.7 * len(before) < len(after) < len(before)


def test_language_stage(spark, stages):
    before, after, *_ = stages["language"]
    model = language_ppm.fit(spark.createDataFrame([(r.lang, r.text) for r in before], "lang string, text string"))

    def kept(text):
        b = text.encode()
        bits = model.bits(next(K.chunks(pa.array([text]))))[0]
        return len(b) > 0 and bits.min() <= model.limit[int(bits.argmin())] * len(b) + language_ppm.ALLOWANCE

    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and kept(r.text)} and len(after) > 0.9 * len(before)


def grams(text):
    w = K.simple_words(text)
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def test_near_duplicates_stage(stages):
    before, after, *_ = stages["near_duplicates"]
    sets = {r.doc_id: grams(r.text) for r in before}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= ngram_join.THRESHOLD * len(sets[a] | sets[b]) - 1e-12:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in after} == {i for i in ids if find(i) == i} and len(after) < len(before)


def test_decontamination_stage(spark, stages):
    """All windows of all items by plain sets of word pairs and dictionary weights."""
    before, after, *_ = stages["decontamination"]
    items = [K.simple_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [w for w in items if len(w) >= decontaminate.LEAST]
    pairs = [frozenset(zip(w, w[1:])) for w in items]
    df: dict[tuple, int] = {}
    for p in pairs:
        for s in p:
            df[s] = df.get(s, 0) + 1
    weight = lambda s: np.log1p((len(items) + 1) / (df.get(s, 0) + 1))
    mass = [sum(map(weight, p)) for p in pairs]
    leaked = set()
    for r in before:
        w = K.simple_words(r.text)
        two = list(zip(w, w[1:]))
        value = [weight(s) for s in two]
        shared = [s in df for s in two]
        for words, p, whole in zip(items, pairs, mass):
            for a in range(max(1, len(w) - len(words) + 1)):
                own = two[a : a + len(words) - 1]
                if sum(v for v, s in zip(value[a : a + len(words) - 1], shared[a : a + len(words) - 1]) if s) < 0.6 * whole:
                    continue  # an upper bound of what they share
                both = sum(map(weight, p & set(own)))
                if both / (sum(map(weight, set(own))) + whole - both) >= decontaminate.SIMILARITY:
                    leaked.add(r.doc_id)
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone <= leaked and len(gone) >= 0.9 * len(leaked) > 0


def test_packing_stage(stages):
    before, after, *_ = stages["packing"]
    words = {r.doc_id: len(K.simple_words(r.text)) for r in before}
    packed: dict[int, list] = {}
    for b in after:
        assert sum(p.words for p in b.pieces) == b.used <= bestfit_packing.CAPACITY and b.used + b.free == bestfit_packing.CAPACITY
        for p in b.pieces:
            packed.setdefault(p.doc_id, []).append((p.first_word, p.words))
    assert packed.keys() == {i for i, n in words.items() if n}
    for i, ps in packed.items():
        ps.sort()
        assert [a for a, _ in ps] == [sum(n for _, n in ps[:k]) for k in range(len(ps))] and sum(n for _, n in ps) == words[i]


def test_run_is_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF).collect()
    assert sum(b.used for b in out) == sum(b.used for b in stages["packing"][1])
    docs = {p.doc_id for b in out for p in b.pieces}
    assert docs == {p.doc_id for b in stages["packing"][1] for p in b.pieces}
