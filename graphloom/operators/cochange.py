"""What changes together: pairs of files in commits (commit_id, file)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import spread

#: Pairs that are expected for a row of commits, for the number of partitions only.
PAIRS = 4


def pair_counts(commits: DataFrame, least: int = 2) -> DataFrame:
    """(file_a, file_b, n): commits that list both files, for file_a < file_b, from ``least`` on.

    Pairs are made inside each commit's own set of files, so there is one shuffle for commits and one for pairs. Both are in partitions of a bounded number of rows,
    and pairs, most of which come once, are only counted behind their shuffle.
    """
    n = commits.count()
    sets = spread(commits.where("file IS NOT NULL"), "commit_id", rows=n).groupBy("commit_id").agg(F.array_sort(F.collect_set("file")).alias("fs")).where(F.size("fs") > 1)
    a = sets.select("fs", F.posexplode("fs").alias("at", "file_a"))
    pairs = a.select("file_a", F.explode(F.slice("fs", F.col("at") + 2, F.size("fs"))).alias("file_b"))
    return spread(pairs, "file_a", "file_b", factor=PAIRS, rows=n).groupBy("file_a", "file_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def file_counts(commits: DataFrame) -> DataFrame:
    """(file, listed): how often a file is listed; twice in a commit counts twice."""
    return commits.where("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("listed"))


def strength(commits: DataFrame, least: int = 2, threshold: float = 0.3) -> DataFrame:
    """(file_a, file_b, n, strength): Jaccard strength n / (a + b - n), from the threshold on."""
    files = file_counts(commits)
    p = pair_counts(commits, least).join(files.select(F.col("file").alias("file_a"), F.col("listed").alias("ca")), "file_a").join(files.select(F.col("file").alias("file_b"), F.col("listed").alias("cb")), "file_b")
    s = F.col("n") / (F.col("ca") + F.col("cb") - F.col("n"))
    return p.withColumn("strength", s).where(s >= threshold).select("file_a", "file_b", "n", "strength")


def metadata(pairs: DataFrame) -> DataFrame:
    """One row: pairs, files, mean and greatest strength (0 without pairs)."""
    ends = pairs.select(F.explode(F.array("file_a", "file_b")).alias("f")).agg(F.countDistinct("f").alias("files"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.agg(F.count("*").alias("pairs"), zero(F.avg("strength")).alias("mean_strength"), zero(F.max("strength")).alias("max_strength")).crossJoin(ends)


def busiest(pairs: DataFrame, k: int = 15) -> DataFrame:
    """(file, total): the k files with the greatest sum of counts over their pairs."""
    return pairs.select(F.explode(F.array("file_a", "file_b")).alias("file"), "n").groupBy("file").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "file").limit(k)


def neighbours(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, other, strength) of the given files' partners."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("file_a").alias("file"), F.col("file_b").alias("other")), F.struct(F.col("file_b").alias("file"), F.col("file_a").alias("other")))).alias("x"), "strength")
    return both.select("x.file", "x.other", "strength").join(files.select("file"), "file", "left_semi")


def cross_language(pairs: DataFrame, one: str = r"\.py$", other: str = r"\.[jt]sx?$") -> DataFrame:
    """Pairs of which one file is of one language and the other of another (patterns)."""
    a, b = F.col("file_a").cast("string"), F.col("file_b").cast("string")
    return pairs.where(a.rlike(one) & b.rlike(other) | a.rlike(other) & b.rlike(one))
