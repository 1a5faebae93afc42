"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that are sent to every executor at once; longer id lists are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a partition of ``spread``.
ROWS_A_TASK = 500_000
#: Folders made for local sessions that name none, by application.
_made: dict[str, str] = {}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A cluster must name one. Only a local master, as in tests, gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = "file://" + tempfile.mkdtemp(prefix="graphloom_")
    return _made[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *keys: str, factor: int = 1, rows: int | None = None) -> DataFrame:
    """A table by hash of keys, in as many partitions as keep each at about ROWS_A_TASK rows, so that what a task holds doesn't grow with the table; small tables are left alone.

    Partitions of a number that is given aren't put together again. ``factor``: rows that are made of one. ``rows``: their number, where it is known.
    """
    parts = -(-factor * (df.count() if rows is None else rows) // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > 1 else df


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str, count: int | None = None) -> DataFrame:
    """``left_semi`` or ``left_anti`` of a wide table with a table of ids (one column named ``key``).

    The ids are broadcast while there are at most BROADCAST_IDS of them; beyond it the join is left to shuffle.
    """
    n = ids.count() if count is None else count
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), key, how)


def fixed(x: Column, digits: int = 6) -> Column:
    """Rounding that gives the same double here and in other SQL engines."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)
