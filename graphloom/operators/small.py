"""Graphs of up to AT_ONCE edges, solved as arrays in one task: no round trips of shuffles and written tables. Larger ones take the distributed rounds, with the same results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most edges that one task holds.
AT_ONCE = 2_000_000


def fits(edges: DataFrame) -> bool:
    """Whether a table of edges, which should be written, has at most AT_ONCE rows."""
    return edges.limit(AT_ONCE + 1).count() <= AT_ONCE


def solved(edges: DataFrame, name: str, kind: str, solve: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """(id, name): what ``solve`` gives for each node of the edges (src, dst), or for those where it gives no negative place or NaN.

    Nodes are numbered in the order of their ids. ``kind`` is a type, or ``id`` if the results are places of nodes.
    """
    of = edges.schema["src"].dataType.simpleString()
    out = of if kind == "id" else kind

    def run(batches):
        got = [pa.Table.from_batches([b]) for b in batches]
        if not got:
            return
        table = pa.concat_tables(got)
        both = pa.chunked_array(table["src"].chunks + table["dst"].chunks).combine_chunks().dictionary_encode()
        ids = both.dictionary
        order = pc.sort_indices(ids)
        place = np.empty(len(ids), np.int64)
        place[np.asarray(order)] = np.arange(len(ids))
        code = place[np.asarray(both.indices)]
        ids = ids.take(order)
        value = solve(code[: table.num_rows], code[table.num_rows :], len(ids))
        yield answer(ids, value, name, kind)

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"id {of}, {name} {out}")


def answer(ids: pa.Array, value: np.ndarray, name: str, kind: str) -> pa.RecordBatch:
    """(id, name) of a solution."""
    keep = ~np.isnan(value) if value.dtype.kind == "f" else value >= 0
    return pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), ids.take(pa.array(value[keep])) if kind == "id" else pa.array(value[keep])], names=["id", name])


def csr(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each node's targets, and targets."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def connected(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, directions ignored, by least labels of neighbours and jumps to the label's label."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        least = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def strong(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each strongly connected component of two nodes or more, -1 elsewhere; Tarjan's search with a stack of its own."""
    ptr, to = csr(src, dst, n)
    ptr, to = ptr.tolist(), to.tolist()
    index, low, out = [-1] * n, [0] * n, [-1] * n
    on = [False] * n
    stack: list[int] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, ptr[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, k = work[-1]
            if k < ptr[v + 1]:
                work[-1] = (v, k + 1)
                w = to[k]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, ptr[w]))
                elif on[w] and index[w] < low[v]:
                    low[v] = index[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1][0]]:
                low[work[-1][0]] = low[v]
            if low[v] == index[v]:
                group = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    group.append(w)
                    if w == v:
                        break
                if len(group) > 1:
                    least = min(group)
                    for w in group:
                        out[w] = least
    return np.array(out, np.int64)


def propagated(rounds: int) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """Label propagation: each node takes the most frequent label of itself and those around it, the least of equals, all at once, until nothing moves, labels swap back, or ``rounds`` are over."""
    return lambda src, dst, n: moved(src, dst, n, rounds)[0]


def moved(src: np.ndarray, dst: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(labels, labels a round before, round of the end, whether labels still swap) of ``propagated``; the round is 0 if ``rounds`` were over."""
    pair = np.unique(np.concatenate((src * n + dst, dst * n + src, np.arange(n) * (n + 1))))
    src, dst = pair // n, pair % n
    label, before = np.arange(n), None
    for r in range(rounds):
        vote, many = np.unique(dst * n + label[src], return_counts=True)
        at, named = vote // n, vote % n
        order = np.lexsort((named, -many, at))
        first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))]
        new = label.copy()
        new[at[first]] = named[first]
        still = (new == label).all()
        if still or before is not None and (new == before).all():
            return new, label, r + 1, not still
        before, label = label, new
    return label, label if before is None else before, 0, True


def ranked(alpha: float, rounds: int, tolerance: float | None) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """Power iterations of PageRank."""

    def solve(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
        pair = np.unique(src * n + dst)
        src, dst = pair // n, pair % n
        outs = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            got = np.bincount(dst, rank[src] / outs[src], n)
            new = (1 - alpha) / n + alpha * (got + rank[outs == 0].sum() / n)
            moved = np.abs(new - rank).sum()
            rank = new
            if tolerance is not None and moved < n * tolerance:
                break
        return rank

    return solve


def loose(df: DataFrame, ids: DataFrame, column: str, value) -> DataFrame:
    """``df`` (id, column) with the ids that it lacks, which get a value."""
    return ids.select("id").distinct().join(df, "id", "left").select("id", F.coalesce(column, value).alias(column))
