"""Graphs beyond what one task holds, cut along their connected components: each task solves whole components as arrays. No graph is held on the driver or sent to every executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import small
from graphloom.session import written

#: Edges that a bin of components gets on average, where there are many; one component is never cut.
BIN = 100_000
#: Edges that are taken in at once while components are looked for, and edges of a task's share of the first pass.
STEP, SHARE = 2_000_000, 16_000_000
#: Tasks for each core that seeds are spread over.
SPREAD = 3


class Pieces(NamedTuple):
    """edges (src, dst, bin), nodes (id, bin), and how many bins there are."""

    edges: DataFrame
    nodes: DataFrame
    bins: int


def _stars(batches) -> Iterator[pa.RecordBatch]:
    """(src, dst): each node and the least of those that are connected with it by these edges. Edges are taken in a share at a time."""
    held, many, kept = [], 0, None

    def taken(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst, ids = numbered(pa.Table.from_batches(parts))
        label = small.connected(src, dst, len(ids))
        return pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], names=["src", "dst"])

    for b in batches:
        held.append(b)
        many += b.num_rows
        if many >= max(STEP, kept.num_rows if kept is not None else 0):
            kept = taken(([kept] if kept is not None else []) + held)
            held, many = [], 0
    if held:
        kept = taken(([kept] if kept is not None else []) + held)
    if kept is not None:
        for lo in range(0, kept.num_rows, 100_000):
            yield kept.slice(lo, 100_000)


def numbered(table: pa.Table, a: str = "src", b: str = "dst") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(sources, targets, ids in order), nodes by their places."""
    import pyarrow.compute as pc

    both = pa.chunked_array(table[a].chunks + table[b].chunks, table.schema.field(a).type).combine_chunks().dictionary_encode()
    if isinstance(both, pa.ChunkedArray):
        both = both.combine_chunks()
    order = pc.sort_indices(both.dictionary)
    place = np.empty(len(order), np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    code = place[np.asarray(both.indices)]
    return code[: table.num_rows], code[table.num_rows :], both.dictionary.take(order)


def cut(edges: DataFrame) -> Pieces | None:
    """Distinct edges without empty ends in bins of whole components; None if a component has more than small.AT_ONCE edges."""
    e = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "pieces")
    ends = F.explode(F.array("src", "dst")).alias("id")
    if small.fits(e):
        return Pieces(e.withColumn("bin", F.lit(0)), e.select(ends).distinct().withColumn("bin", F.lit(0)), 1)
    many = e.count()
    kind = e.schema["src"].dataType.simpleString()
    shares = max(1, min(e.sparkSession.sparkContext.defaultParallelism, many // SHARE))
    # so few large shares, as small ones of a graph hold its nodes over and over
    stars = written(e.coalesce(shares).mapInArrow(_stars, f"src {kind}, dst {kind}"), "stars")
    if shares > 1:
        stars = written(stars.coalesce(1).mapInArrow(_stars, f"src {kind}, dst {kind}"), "stars")
    bins = max(1, many // BIN)
    of = stars.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    e = e.join(of.withColumnRenamed("id", "src"), "src")
    largest = e.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest > small.AT_ONCE:
        return None
    hashed = F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int").alias("bin")
    e = written(e.select("src", "dst", hashed), "pieces")
    return Pieces(e, of.select("id", hashed), e.select("bin").distinct().count())


def groups(batches, *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each value of the keys, of batches in their order."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    at = [*np.flatnonzero(change).tolist(), table.num_rows]
    for lo, hi in zip(at, at[1:]):
        part = table.slice(lo, hi - lo)
        yield tuple(part[k][0].as_py() for k in keys), part


def each(pieces: Pieces, run: Callable[[np.ndarray, np.ndarray, pa.Array], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that ``run`` makes of the edges of each bin, as places of its ids, which are in order."""

    def of(batches):
        for _, part in groups(batches, "bin"):
            yield from run(*numbered(part))

    return pieces.edges.repartition(2 * pieces.bins, "bin").sortWithinPartitions("bin").mapInArrow(of, schema)


def solved(pieces: Pieces, name: str, kind: str, solve: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """As small.solved, for each bin."""
    of = pieces.edges.schema["src"].dataType.simpleString()

    def run(src, dst, ids):
        yield small.answer(ids, solve(src, dst, len(ids)), name, kind)

    return each(pieces, run, f"id {of}, {name} {of if kind == 'id' else kind}")


def from_seeds(pieces: Pieces, seeds: DataFrame, run: Callable, schema: str, nodes: DataFrame | None = None, of_nodes: str = "file", kind_of: str = "string") -> DataFrame:
    """Rows of ``run(src, dst, ids, places of seeds, places of nodes, files)`` for shares of the seeds (id) of each bin; ``nodes`` (id, file) are those of the graph that have a row. Another column than ``file`` may be named, with its type."""
    spark = pieces.edges.sparkSession
    shares = max(1, -(-SPREAD * spark.sparkContext.defaultParallelism // pieces.bins))
    kind = pieces.edges.schema["src"].dataType
    none, every = F.lit(None).cast(kind), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    own = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share")
    s = seeds.select(F.col("id").cast(kind).alias("id")).where("id IS NOT NULL").distinct().join(pieces.nodes, "id")
    no_file = F.lit(None).cast(kind_of).alias("file")
    rows = pieces.edges.select("bin", every, F.lit(0).alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), no_file)
    rows = rows.unionByName(s.select("bin", own, F.lit(1).alias("what"), F.col("id").alias("a"), none.alias("b"), no_file))
    if nodes is not None:
        n = nodes.select(F.col("id").cast(kind).alias("id"), F.col(of_nodes).cast(kind_of).alias("file")).join(pieces.nodes, "id")
        rows = rows.unionByName(n.select("bin", every, F.lit(2).alias("what"), F.col("id").alias("a"), none.alias("b"), "file"))

    def of(batches):
        import pyarrow.compute as pc

        for _, part in groups(batches, "bin", "share"):
            e, s, n = (part.filter(pc.equal(part["what"], k)) for k in range(3))
            if not s.num_rows:
                continue
            src, dst, ids = numbered(e, "a", "b")
            at = lambda t: np.asarray(pc.index_in(t["a"].combine_chunks(), value_set=ids)).astype(np.int64)
            yield from run(src, dst, ids, np.sort(at(s)), at(n), n["file"].combine_chunks())

    return rows.repartition(2 * pieces.bins * shares, "bin", "share").sortWithinPartitions("bin", "share").mapInArrow(of, schema)
