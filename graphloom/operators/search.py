"""Search by text over chunks, with encoders that callers plug in, candidates from the graph, and a store of vectors by scope."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import vectors
from graphloom.session import written

#: An encoder: texts to one vector each, or None for a text that it can't take.
Encoder = Callable[[list[str]], list[list[float] | None]]
#: Texts that an encoder gets at once.
AT_ONCE = 64


def encoded(texts: DataFrame, encoder: Encoder | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(id, vector, skipped, reason) of texts (id, text). Without an encoder, hashes of words stand in for a model.

    An encoder gets batches. One that raises is given halves of the batch, down to the texts that it can't take; these are skipped, with what it said.
    """
    if encoder is None:
        return vectors.encode(texts).withColumns({"skipped": F.lit(False), "reason": F.lit(None).cast("string")})

    def tried(part: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None if v is not None else "no vector") for v in encoder(part)]
        except Exception as e:
            if len(part) == 1:
                return [(None, str(e) or type(e).__name__)]
            half = len(part) // 2
            return tried(part[:half]) + tried(part[half:])

    def run(batches):
        for b in batches:
            text = [t or "" for t in b.column(1).to_pylist()]
            got = [x for lo in range(0, len(text), at_once) for x in tried(text[lo : lo + at_once])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([v is None for v, _ in got]), pa.array([r for _, r in got], pa.string())], names=["id", "vector", "skipped", "reason"]
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, vector array<float>, skipped boolean, reason string")


def within(rows: DataFrame, prefix: str | None, column: str = "file", fall_back: bool = True) -> DataFrame:
    """Rows whose file begins with a package's prefix. If none does, all rows where ``fall_back`` is set."""
    if not prefix:
        return rows
    inside = rows.where(F.col(column).startswith(prefix))
    return rows if fall_back and inside.isEmpty() else inside


def only(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows whose id is on a list (id)."""
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def text_search(chunks: DataFrame, queries: DataFrame, encoder: Encoder | None = None, k: int = 10, threshold: float = 0.3, ids: DataFrame | None = None) -> DataFrame:
    """(query, id, similarity): for each query (query, text) the k chunks (id, vector, trivial) most like it; trivial ones count half."""
    q = encoded(queries.select(F.col("query").alias("id"), "text"), encoder).where("NOT skipped").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    # chunks may have the ids of queries: a query is no row of theirs here
    return vectors.search(only(chunks, ids), q, k, threshold, F.col("trivial") if "trivial" in chunks.columns else None, others=False)


def hybrid_search(rows: DataFrame, queries: DataFrame, candidates: DataFrame | str, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(query, id, similarity): as a search, over the candidates (query, id) of each query where it has k of them or more, else over all vectors.

    Candidates may be a column of rows and queries instead: those of a query are then all other rows of its value, and no pairs are made of them.
    """
    if isinstance(candidates, str):
        c = F.col(candidates)
        many = rows.groupBy(c.alias("of")).agg(F.countDistinct("id").alias("n"))
        own = rows.select(F.col("id").alias("query"), c.alias("of")).distinct().withColumn("own", F.lit(1))
        q = queries.withColumn("of", c).join(many, "of", "left").join(own, ["query", "of"], "left")
        q = written(q.withColumn("enough", F.coalesce(F.col("n"), F.lit(0)) - F.coalesce(F.col("own"), F.lit(0)) >= k).select("query", "qv", candidates, "enough"), "queries")
        return vectors.search(rows, q.where("enough"), k, threshold, group=candidates).unionByName(vectors.search(rows, q.where("NOT enough"), k, threshold))
    enough = candidates.join(rows.select("id"), "id", "left_semi").groupBy("query").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= k).select("query")
    near = candidates.join(enough, "query", "left_semi").select("query", "id").distinct().join(rows.select("id", "vector"), "id").join(queries, "query").where("id <> query")
    sim = near.select("query", "id", vectors.clipped(vectors.cosine(F.col("vector"), F.col("qv"))).alias("similarity"))
    best = vectors.best_of(sim.where("similarity IS NOT NULL"), k).where(F.col("similarity") >= threshold)
    return best.unionByName(vectors.search(rows, queries.join(enough, "query", "left_anti"), k, threshold))


class Store:
    """Vectors of chunks on disk: (id, file, line_start, line_end, content_hash, model, vector), a folder for each scope. A scope is replaced whole; others stay."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def save(self, rows: DataFrame, scope: str = "", full: bool = False) -> None:
        """Replace a scope, or everything."""
        out = rows.withColumn("scope", F.lit(scope or "*")).write.partitionBy("scope")
        (out if full else out.option("partitionOverwriteMode", "dynamic")).mode("overwrite").parquet(self.path)

    def load(self, model: str | None = None, prefix: str | None = None, ids: DataFrame | None = None) -> DataFrame:
        """All rows, or those of a model (vectors of another one can't be compared), of files below a prefix, of some ids."""
        rows = self.spark.read.parquet(self.path)
        if model is not None:
            rows = rows.where(F.col("model") == model)
        if prefix:
            rows = rows.where(F.col("file").startswith(prefix))
        return only(rows, ids)

    def hashes(self) -> DataFrame:
        return self.load().select("id", "content_hash")

    def without_vectors(self) -> DataFrame:
        return self.load().where("vector IS NULL")

    def files(self) -> DataFrame:
        """(file, chunks)."""
        return self.load().groupBy("file").agg(F.count("*").alias("chunks"))
