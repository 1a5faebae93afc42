"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to cells of a grid, each row gets the index of its cell on the Hilbert curve through the grid, rows are sorted by
it, and the order is cut into runs of about equal weight. As the curve keeps neighbours together, each run covers a small box of all dimensions at once, and a reader
can skip most runs whichever dimension it filters by.

The index is computed inside the JVM: the curve is a finite automaton, walked once for each bit with a table look-up. Quantiles and the weights of the
cells come from all rows. The table of cells has at most 2 ** (bits * dimensions) rows, so it is broadcast only while it has at most ``BROADCAST_CELLS`` of them. A cell that
outweighs a run is cut into several runs by a scramble of doc_id, or of n_chars where doc_id is null; rows that are the same in both stay together.

Defined results: a null in a dimension is quantised to 0, the cell of the least values; null and empty texts weigh nothing but their row; rows that are repeated stay as often as they are there; equal
indexes are in the order of doc_id, nulls first; an empty table gives no rows. Other columns are carried along; input columns named ``curve`` or ``shard`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

#: Bits of each dimension, characters of text that a run holds, and most cells that are broadcast.
BITS, RUN_CHARS, BROADCAST_CELLS = 4, 64_000_000, 262_144
#: Characters that a row counts as besides those of its text.
ROW_CHARS = 64


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _rotl(x: int, k: int, n: int) -> int:
    k %= n
    return ((x << k) | (x >> (n - k))) & ((1 << n) - 1)


def automaton(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of each state and each corner of the cube, at ``state * 2**n + corner``; a state is entry corner * n + direction."""
    digit, nxt = [], []
    for state in range((1 << n) * n):
        entry, turn = divmod(state, n)
        for corner in range(1 << n):
            g = _rotl(corner ^ entry, n - (turn + 1) % n, n)
            w = 0
            while g:
                w ^= g
                g >>= 1
            trail = lambda i: ((i + 1) & -(i + 1)).bit_length() - 1
            e = 0 if w == 0 else _gray(2 * ((w - 1) // 2))
            d = 0 if w == 0 else (trail(w - 1) if w % 2 == 0 else trail(w)) % n
            digit.append(w)
            nxt.append((entry ^ _rotl(e, turn + 1, n)) * n + (turn + d + 1) % n)
    return digit, nxt


def curve_index(dims: list[Column], bits: int) -> Column:
    """The Hilbert index of cells with integer coordinates below 2 ** bits."""
    n = len(dims)
    digit, nxt = automaton(n)
    digits, nexts = F.array(*[F.lit(x) for x in digit]), F.array(*[F.lit(x) for x in nxt])
    corners = []
    for b in range(bits - 1, -1, -1):
        c = F.lit(0)
        for k, d in enumerate(dims):
            c = c + F.shiftleft(F.shiftright(d, b).bitwiseAND(1), k)
        corners.append(c.cast("int"))

    def step(acc: Column, corner: Column) -> Column:
        at = acc["state"] * (1 << n) + corner
        return F.struct(F.get(nexts, at).alias("state"), (F.shiftleft(acc["curve"], n) + F.get(digits, at)).alias("curve"))

    return F.aggregate(F.array(*corners), F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("curve")), step, lambda acc: acc["curve"])


def _numbered(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, cell) of a column: places in the order of the values, spread over the cells by row counts.

    Running sums in two steps: ranges of values are summed, then each range runs on from the sum of those before it.
    """
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "values")
    sums = counts.groupBy("part").agg(F.sum("n").alias("n"))  # at most ``parts`` rows
    ahead = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("all"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.join(F.broadcast(ahead), "part").select("value", F.floor((F.col("ahead") + inside) * (1 << bits) / F.col("all")).cast("int").alias("cell"))


def placed(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows with their ``curve`` index over lang, source and length (in powers of the square root of 2, from 64 characters up)."""
    top = (1 << bits) - 1
    plain = docs.drop("curve", "shard")
    own = _free(plain.columns)
    for name in ("lang", "source"):
        value, cell = f"{own}value", f"{own}{name}"
        cells = written(_numbered(docs, name, bits).toDF(value, cell), "cells")
        # a join by shuffle would put a hot value's rows into one task; that many values have none that hot
        plain = plain.join(F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells, F.col(name) == F.col(value), "left").drop(value)
    chars = F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0))
    length = F.when(chars < 64, 0).otherwise(F.least(F.lit(top), F.floor(2 * (F.log2(F.greatest(chars, F.lit(64.0))) - 6) + 1e-9))).cast("int")
    dims = [F.coalesce(F.col(f"{own}lang"), F.lit(0)), F.coalesce(F.col(f"{own}source"), F.lit(0)), length]
    return plain.withColumn("curve", curve_index(dims, bits)).drop(f"{own}lang", f"{own}source")


def _free(columns: list[str]) -> str:
    """A beginning of names that no column has."""
    own = "_"
    while any(c.lower().startswith(own) for c in columns):
        own += "_"
    return own


def runs(rows: DataFrame, weight: Column, run: int = RUN_CHARS) -> DataFrame:
    """(curve, first, pieces): the first run of each cell and how many runs it is cut into."""
    cells = rows.groupBy("curve").agg(F.sum(weight).alias("w"))
    before = F.coalesce(F.sum("w").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a cell starts in the run that its weight before it falls into; the pieces of a heavy cell take the runs that it reaches
    cells = cells.withColumn("first", F.floor(before / run).cast("long"))
    return cells.select("curve", "first", F.greatest(F.lit(1).cast("long"), F.floor((before + F.col("w")) / run).cast("long") - F.col("first")).alias("pieces"))


def shard(docs: DataFrame, bits: int = BITS, run: int = RUN_CHARS) -> DataFrame:
    """All rows and columns of the documents with ``curve`` and ``shard``, in the order of the shards and of the curve within each."""
    rows = placed(docs, bits)
    weight = F.coalesce(F.col("n_chars"), F.lit(0)) + ROW_CHARS
    plan = written(runs(rows.select("curve", "n_chars"), weight, run), "runs")
    got = plan.agg(F.count("*"), F.max(F.col("first") + F.col("pieces"))).first()
    own = _free(rows.columns)
    plan = plan.toDF("curve", f"{own}first", f"{own}pieces")
    out = rows.join(F.broadcast(plan) if got[0] <= BROADCAST_CELLS else plan, "curve")
    key = F.coalesce(F.col("doc_id").cast("long"), F.col("n_chars").cast("long"), F.lit(0))
    scrambled = F.shiftright(F.pmod(key, F.lit(1 << 31)) * F.lit(2654435761), 15)
    out = out.withColumn("shard", F.col(f"{own}first") + F.pmod(scrambled, F.col(f"{own}pieces")))
    columns = [c for c in docs.columns if c not in ("curve", "shard")]
    out = out.select(*[F.col(f"`{c}`") for c in columns], "curve", "shard")
    # each shard is a partition of its own
    return out.repartitionById(max(1, int(got[1] or 1)), F.col("shard").cast("int")).sortWithinPartitions("shard", "curve", "doc_id")


def manifest(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: rows and the least and greatest lang, source and n_chars of each shard."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars") for f, n in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *bounds)


def write(sharded: DataFrame, path: str) -> None:
    """One folder and file for each shard."""
    sharded.write.partitionBy("shard").parquet(path)


def oracle() -> str:
    """The same rows in DuckDB SQL over ``documents``."""
    digit, nxt = automaton(3)
    walk, last = "", "dims"
    for k, b in enumerate(range(BITS - 1, -1, -1)):
        at = f"(state * 8 + ((c_lang >> {b}) & 1) + 2 * ((c_source >> {b}) & 1) + 4 * ((c_len >> {b}) & 1)) + 1"
        walk += f", w{k} AS (SELECT * EXCLUDE (state, curve), (SELECT nexts FROM tables)[{at}] AS state, curve * 8 + (SELECT digits FROM tables)[{at}] AS curve FROM {last})"
        last = f"w{k}"

    def cells(c: str) -> str:
        return f"c_{c} AS (SELECT {c} AS v, CAST(floor(coalesce(sum(n) OVER (ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << BITS} / sum(n) OVER ()) AS INT) AS cell FROM (SELECT {c}, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c}))"

    chars = "coalesce(CAST(n_chars AS DOUBLE), 0)"
    return f"""WITH tables AS (SELECT {digit} AS digits, {nxt} AS nexts), {cells("lang")}, {cells("source")},
dims AS (SELECT d.*, coalesce(a.cell, 0) AS c_lang, coalesce(b.cell, 0) AS c_source, CAST(CASE WHEN {chars} < 64 THEN 0 ELSE least({(1 << BITS) - 1}, floor(2 * (log2(greatest({chars}, 64)) - 6) + 1e-9)) END AS INT) AS c_len,
0 AS state, CAST(0 AS BIGINT) AS curve FROM documents d LEFT JOIN c_lang a ON d.lang = a.v LEFT JOIN c_source b ON d.source = b.v){walk},
cell AS (SELECT curve, sum(coalesce(n_chars, 0) + {ROW_CHARS}) AS w FROM {last} GROUP BY curve),
cum AS (SELECT curve, w, coalesce(sum(w) OVER (ORDER BY curve ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM cell),
run AS (SELECT curve, CAST(floor(p / {RUN_CHARS}.0) AS BIGINT) AS first, greatest(1, CAST(floor((p + w) / {RUN_CHARS}.0) AS BIGINT) - CAST(floor(p / {RUN_CHARS}.0) AS BIGINT)) AS pieces FROM cum)
SELECT doc_id, text, lang, source, n_chars, curve, CAST(first + ((((coalesce(doc_id, n_chars, 0) % 2147483648 + 2147483648) % 2147483648 * 2654435761) >> 15) % pieces) AS BIGINT) AS shard FROM {last} JOIN run USING (curve)"""
