"""Similarity of vectors (id, vector array<float>)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

#: Rows of a block of near pairs; blocks of a search aren't cut smaller to have four of them.
BLOCK = 4096
#: Numbers of the vectors of a block of a search.
CELLS = 4_000_000
#: Similarities that are held at once.
TILE = 16_000_000
#: Most queries that are broadcast.
BROADCAST_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """A vector over its length (plus 1e-9)."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + F.lit(1e-9)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null for a vector of zeros."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def clipped(x: Column) -> Column:
    """A similarity between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k rows of the greatest similarity of each query, ids in order among equals."""
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("p", F.row_number().over(w)).where(F.col("p") <= k).drop("p")


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the vectors of one size that have no null in them and aren't of length 0."""
    length = pc.fill_null(pc.list_value_length(column), -1)
    at = np.flatnonzero(np.asarray(length) == size)
    flat = column.take(pa.array(at)).flatten()
    m = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), size)
    ok = ~(_length(m) <= 0)
    if flat.null_count:
        ok &= np.asarray(flat.is_valid()).reshape(len(at), size).all(axis=1)
    return m[ok], at[ok]


def _length(m: np.ndarray) -> np.ndarray:
    """Lengths of rows, summed in the order that ``norm`` has."""
    total = np.zeros(len(m))
    for c in m.T:
        total += c * c
    return np.sqrt(total)


def _best(m: np.ndarray, code: np.ndarray, qm: np.ndarray, qcode: np.ndarray, k: int, threshold: float, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity): of each query the k best rows with another code, of equal ones the first; exact.

    Equal rows are compared once. Products of matrices in single precision leave those rows that may be among the best, and only they are computed as ``cosine`` does.
    """
    k = min(k, len(m))
    if not len(m) or not len(qm):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    m, qm = np.ascontiguousarray(m), np.ascontiguousarray(qm)
    _, first, same = np.unique(m.view(f"V{m.dtype.itemsize * m.shape[1]}").ravel(), return_index=True, return_inverse=True)
    members = np.argsort(same, kind="stable")  # rows of each vector, in order
    starts = np.searchsorted(same[members], np.arange(len(first) + 1))
    u = m[first]
    size, qsize = _length(u), _length(qm)
    with np.errstate(invalid="ignore", over="ignore"):
        us, qs = (u / size[:, None]).astype(np.float32), (qm / qsize[:, None]).astype(np.float32)
    odd = not (np.isfinite(us).all() and np.isfinite(qs).all())
    ut, qt = np.ascontiguousarray(u.T), np.ascontiguousarray(qm.T)
    near = 1e-6 + 2e-7 * m.shape[1]
    most = k + int(np.bincount(np.unique(code, return_inverse=True)[1]).max())  # a query's own rows are taken out of so many
    step = max(1, TILE // len(u))
    wide = 1 if len(u) < 64 * most else 16
    groups = len(u) // wide
    out = []
    for lo in range(0, len(qm), step):
        with np.errstate(invalid="ignore"):
            s = qs[lo : lo + step] @ us.T
        if odd:
            s[np.isnan(s)] = 1
        least = np.full(len(s), -2.0, np.float32)
        if groups >= most:  # the best of each group of rows: the last of the best groups is no greater than the last of the best rows
            top = s[:, : groups * wide].reshape(len(s), wide, groups).max(axis=1)
            least = np.partition(top, groups - most, axis=1)[:, groups - most]
        least = np.maximum(np.minimum(least, 1), threshold) - near  # all of 1 and more are as good
        least = np.where(least <= 0, -np.inf, least)  # all below 0 are as good as 0
        at = np.flatnonzero(s >= least[:, None])
        x, y = at // len(u) + lo, at % len(u)
        sim = np.zeros(len(x))
        with np.errstate(invalid="ignore", over="ignore"):
            for a, b in zip(ut, qt):
                sim += a[y] * b[x]
            sim /= size[y] * qsize[x]
        sim[np.isnan(sim)] = 1
        sim = np.clip(sim, 0, 1)
        if digits is not None:
            sim = np.round(sim, digits)
        ok = sim >= threshold
        x, y, sim = x[ok], y[ok], sim[ok]
        many = np.minimum(starts[y + 1] - starts[y], most)
        row = members[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[y], many)]
        x, sim = np.repeat(x, many), np.repeat(sim, many)
        ok = code[row] != qcode[x]
        x, row, sim = x[ok], row[ok], sim[ok]
        order = np.lexsort((row, -sim, x))
        x, row, sim = x[order], row[order], sim[order]
        ok = np.arange(len(x)) - np.searchsorted(x, x) < k
        out.append((x[ok], row[ok], sim[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _compared(rows: pa.Table, queries: pa.Table, k: int, threshold: float, others: bool, group: bool, digits: int | None):
    """Batches (query, id, similarity, trivial) of the best of some rows (id, vector, trivial, group) for some queries (query, qv, group)."""
    rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_start")) if rows.num_rows else rows
    ids, qids = rows["id"].combine_chunks(), queries["query"].combine_chunks()
    if others:
        text = ids.type != qids.type
        both = pa.chunked_array([ids.cast(pa.string()) if text else ids, qids.cast(pa.string()) if text else qids]).combine_chunks().dictionary_encode().indices
        both = np.asarray(pc.fill_null(both, -1)).astype(np.int64)
        code, qcode = both[: len(ids)], both[len(ids) :]
        fits, qfits = code >= 0, qcode >= 0
    else:
        code, qcode, fits, qfits = np.arange(len(ids)), np.full(len(qids), -1), np.ones(len(ids), bool), np.ones(len(qids), bool)
    parts = [(fits, qfits)]
    if group:
        g, qg = np.asarray(rows["group"].to_pylist(), object), np.asarray(queries["group"].to_pylist(), object)
        parts = [(fits & (g == x), qfits & (qg == x)) for x in {x for x in qg if x is not None}]
    vectors, qvectors = rows["vector"].combine_chunks(), queries["qv"].combine_chunks()
    for mine, own in parts:
        mine, own = np.flatnonzero(mine), np.flatnonzero(own)
        v, qv = vectors.take(pa.array(mine)), qvectors.take(pa.array(own))
        sizes = [set(pc.unique(pc.list_value_length(c)).to_pylist()) for c in (v, qv)]
        for size in sorted(x for x in sizes[0] & sizes[1] if x):
            (m, at), (qm, qat) = _matrix(v, size), _matrix(qv, size)
            x, y, sim = _best(m, code[mine[at]], qm, qcode[own[qat]], k, threshold, digits)
            x, y = pa.array(own[qat[x]]), pa.array(mine[at[y]])
            yield pa.RecordBatch.from_arrays([qids.take(x), ids.take(y), pa.array(sim, pa.float64()), rows["trivial"].combine_chunks().take(y)], names=["query", "id", "similarity", "trivial"])


def _blocks(n: int, dims: int) -> int:
    """Blocks of n vectors: of CELLS numbers at most, and at least four where they aren't smaller than BLOCK rows for that."""
    return max(1, -(-n // max(1, min(CELLS // max(dims, 1), max(BLOCK, -(-n // 4))))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5, trivial: Column | None = None, others: bool = True, group: str | None = None, digits: int | None = None) -> DataFrame:
    """(query, id, similarity): for each query (query, qv), the k most similar others; then trivial ones count half, then the threshold applies. All rows count with ``others`` False, only those
    of the query's group if a column of both tables is named. Similarities are compared at ``digits``, if given.

    Up to BROADCAST_QUERIES queries are sent to where the vectors are; of more, blocks of queries meet blocks of vectors, so a task holds two blocks and rows are copied once for each block of the other side.
    """
    spark = vectors.sparkSession
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    v = vectors.select("id", "vector", (trivial if trivial is not None else F.lit(False)).alias("trivial"), g.alias("group")).where("vector IS NOT NULL")
    q = queries.select("query", "qv", g.alias("group")).where("qv IS NOT NULL")
    kinds = f"query {q.schema['query'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, similarity double, trivial boolean"
    least = max(threshold, 0.0)
    if q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        sent = spark.sparkContext.broadcast(q.toArrow())

        def here(batches):
            held, cells = [], 0
            for b in batches:
                held.append(b)
                cells += len(b.column(1).flatten())
                if cells >= CELLS:
                    yield from _compared(pa.Table.from_batches(held), sent.value, k, least, others, group is not None, digits)
                    held, cells = [], 0
            if held:
                yield from _compared(pa.Table.from_batches(held), sent.value, k, least, others, group is not None, digits)

        found = v.mapInArrow(here, kinds)
    else:
        v, q = written(v, "vectors"), written(q, "queries")
        n, dims = v.agg(F.count("*"), F.max(F.size("vector"))).first()
        a, b = _blocks(n, dims or 1), _blocks(q.count(), dims or 1)
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = v.select(block("id", a).alias("i"), every(b).alias("j"), "id", "vector", "trivial", "group", F.lit(None).cast(q.schema["query"].dataType).alias("query"), F.lit(True).alias("row"))
        right = q.select(every(a).alias("i"), block("query", b).alias("j"), F.lit(None).cast(v.schema["id"].dataType).alias("id"), F.col("qv").cast(v.schema["vector"].dataType).alias("vector"), F.lit(False).alias("trivial"), "group", "query", F.lit(False).alias("row"))

        def run(table: pa.Table) -> pa.Table:
            mine = table.filter(table["row"])
            own = table.filter(pc.invert(table["row"])).select(["query", "vector", "group"]).rename_columns(["query", "qv", "group"])
            got = list(_compared(mine, own, k, least, others, group is not None, digits))
            empty = pa.RecordBatch.from_arrays([own["query"].combine_chunks().slice(0, 0), mine["id"].combine_chunks().slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.bool_())], names=["query", "id", "similarity", "trivial"])
            return pa.Table.from_batches([empty, *got])

        found = left.unionByName(right).repartition(2 * a * b, "i", "j").groupBy("i", "j").applyInArrow(run, kinds)
    top = best_of(found, k)
    score = F.when(F.col("trivial"), F.col("similarity") * 0.5).otherwise(F.col("similarity"))
    return top.select("query", "id", score.alias("similarity")).where(F.col("similarity") >= threshold)


def near_pairs(vectors: DataFrame, threshold: float = 0.9, group: str | None = None) -> DataFrame:
    """(a, b, similarity): all pairs a < b from the threshold on, of different ``group`` if one is named.

    Blocks of rows are multiplied as matrices: each pair of blocks is one task's work, so nothing is sent to every executor.
    """
    cols = ["id", "vector"] + ([group] if group else [])
    v = vectors.where("vector IS NOT NULL").select(*cols)
    n = v.count()
    blocks = max(1, -(-n // BLOCK))
    v = written(v.withColumn("block", F.pmod(F.hash("id"), F.lit(blocks))), "vectors")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    pair = lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))
    sent = v.withColumn("x", F.explode(F.array_distinct(F.transform(others, pair)))).select("x.i", "x.j", "block", *cols)

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["id"])
        m = np.array(table["vector"].to_pylist(), np.float64).reshape(len(ids), -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
        g = np.unique(np.asarray(table[group].to_pylist(), object).astype(str), return_inverse=True)[1] if group else None
        i, j, at = table["i"][0].as_py(), table["j"][0].as_py(), np.asarray(table["block"])
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        s = m[left] @ m[right].T
        x, y = np.nonzero(s >= threshold - 1e-12)
        a, b, sim = left[x], right[y], s[x, y]
        ok = (ids[a] < ids[b]) if i == j else ids[a] != ids[b]
        if g is not None:
            ok &= g[a] != g[b]
        a, b, sim = ids[a[ok]], ids[b[ok]], sim[ok]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "similarity": pa.array(sim, pa.float64())})

    return sent.groupBy("i", "j").applyInArrow(run, "a long, b long, similarity double")


def nearest(vectors: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(query, id, similarity): what ``search`` gives with every row as a query, exactly. Similarities are compared at 12 digits; ties by id."""
    v = written(vectors.where("vector IS NOT NULL").select("id", "vector"), "vectors")
    return search(v, v.select(F.col("id").alias("query"), F.col("vector").alias("qv")), k, threshold, digits=12)


def fused_score(similarity: Column, depth: Column, alpha: float = 0.6, beta: float = 0.4) -> Column:
    """Similarity and closeness in a graph in one score."""
    return F.lit(alpha) * similarity + F.lit(beta) / (depth + 1)


def fused_matches(reach: DataFrame, similar: DataFrame, threshold: float = 0.3, k: int = 10) -> DataFrame:
    """(id, similarity, depth, score): the k best of what a graph search and a vector search both found; the least depth of either direction counts."""
    near = reach.groupBy("id").agg(F.min("depth").alias("depth"))
    both = near.join(similar, "id").withColumn("score", fused_score(F.col("similarity"), F.col("depth"))).where(F.col("score") >= threshold)
    return both.orderBy(F.desc("score"), "id").limit(k)


def related_unconnected(similar: DataFrame, connected: DataFrame, threshold: float = 0.6, k: int = 5) -> DataFrame:
    """The k most similar (id, similarity) that the graph does not connect (id)."""
    return similar.where(F.col("similarity") >= threshold).join(connected.select("id"), "id", "left_anti").orderBy(F.desc("similarity"), "id").limit(k)


def encode(texts: DataFrame, dims: int = 64) -> DataFrame:
    """(id, vector): a deterministic encoding of texts (id, text) by signed hashes of their words, of unit length; the stand-in where no model is given."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                v = np.zeros(dims)
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dims] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "vector"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, vector array<float>")


def refresh(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, content_hash, status): which chunks (id, content_hash) are unchanged, changed or new against a cache."""
    c = cached.select("id", F.col("content_hash").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content_hash"), "unchanged").otherwise("changed")
    return chunks.join(c, "id", "left").select("id", "content_hash", status.alias("status"))
