"""History: churn, change coupling, hotspots and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def churn(commits: DataFrame) -> DataFrame:
    """(file, commits): how many commits touch each file."""
    return commits.select("commit_id", "file").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("commits"))


def coupling(commits: DataFrame, most_files: int = K.COUPLING_FILES, together: int = K.COUPLING_TOGETHER, pairs: int | None = K.COUPLING_PAIRS) -> DataFrame:
    """(a, b, together, strength) of files that change together; commits of more files than ``most_files`` tell nothing.

    The bound on a commit's files bounds its pairs, so pairs are made within one row and not by a self-join.
    """
    c = commits.select("commit_id", "file").where("file is not null").distinct()
    sized = c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("commit_id"))).where(F.col("n") <= most_files)
    own = sized.groupBy("commit_id").agg(F.array_sort(F.collect_list("file")).alias("f"))
    pair = own.select(F.explode(F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    both = pair.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= together)
    single = sized.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    x = both.join(single.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    out = x.select("a", "b", "together", F.round(F.col("together") / F.least("na", "nb"), 3).alias("strength"))
    return out if pairs is None else out.orderBy(F.desc("strength"), F.desc("together"), "a", "b").limit(pairs)


def hotspots(files: DataFrame, counts: DataFrame, limit: int = K.TOP_HOTSPOTS) -> DataFrame:
    """(rel, commits, lines, score): commits times the logarithm of lines."""
    c = F.coalesce("commits", F.lit(0))
    x = files.join(counts.withColumnRenamed("file", "rel"), "rel", "left").select("rel", c.alias("commits"), "lines", F.round(c * F.log2(F.col("lines") + 1), 2).alias("score"))
    return x.where("commits > 0").orderBy(F.desc("score"), F.desc("lines"), "rel").limit(limit)


def risk(complexity: DataFrame, counts: DataFrame, limit: int = K.TOP_HOTSPOTS) -> DataFrame:
    """(rel, commits, complexity, score): commits and one, times complexity."""
    c = F.coalesce("commits", F.lit(0))
    x = complexity.join(counts.withColumnRenamed("file", "rel"), "rel", "left").select("rel", c.alias("commits"), "complexity", ((c + 1) * F.col("complexity")).alias("score"))
    return x.orderBy(F.desc("score"), "rel").limit(limit)
