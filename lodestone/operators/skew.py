"""Results per key when a few keys hold most rows: value-frequency compression.

Rows are first grouped by (key, value): the hash of both spreads a hot key over all tasks, and repeated values
shrink to one weighted row. Only these weighted rows are grouped by key, again with a map-side combine. Exact
counts, distinct counts, modes and percentiles follow from the weights.

Defined results: a null key is no key but its rows count in the total; null values have a weight of their own and
are left out of distinct counts, modes and percentiles; the mode's ties go to the smallest value; percentiles are
lower ones (the smallest value whose cumulated weight reaches the share), hence existing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def weighted(df: DataFrame, key: Column, values: list[Column]) -> DataFrame:
    """(key, v0, v1, ..., w): each pair of key and values with its number of rows."""
    named = [v.alias(f"v{i}") for i, v in enumerate(values)]
    return df.select(key.alias("key"), *named).groupBy("key", *[f"v{i}" for i in range(len(values))]).agg(F.count(F.lit(1)).alias("w"))


def row_digest(df: DataFrame) -> list[Column]:
    """96 bits that stand for the whole row, so that copies of a row fall into one weighted value."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in df.columns]
    return [F.xxhash64(*marked), F.hash(F.lit("second"), *reversed(marked))]


def distinct_row_counts(df: DataFrame, key: Column) -> DataFrame:
    """(key, n_rows, n_distinct): rows and distinct rows of each key, null key included."""
    return weighted(df, key, row_digest(df)).groupBy("key").agg(F.sum("w").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))


def heavy_keys(df: DataFrame, key: Column, share: float = 0.01) -> DataFrame:
    """(key_value, n_rows, n_distinct) of the keys with at least ``share`` of the distinct rows."""
    per_key = written(distinct_row_counts(df, key), "per-key")
    total = per_key.agg(F.sum("n_distinct")).first()[0] or 0
    return per_key.where(F.col("key").isNotNull() & (F.col("n_distinct") >= F.lit(share * total))).select(F.col("key").alias("key_value"), "n_rows", "n_distinct")


def modes(freq: DataFrame, value: str = "v0") -> DataFrame:
    """(key, mode, mode_count, n, n_distinct) from weighted values of one column."""
    known = F.col(value).isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("w")).alias("w"), F.col(value).alias("v"))))
    return freq.groupBy("key").agg(F.sum("w").alias("n"), F.count(F.when(known, 1)).alias("n_distinct"), best.alias("_b")).select("key", F.col("_b.v").alias("mode"), (-F.col("_b.w")).alias("mode_count"), "n", "n_distinct")


def percentiles(freq: DataFrame, shares: dict[str, float], value: str = "v0") -> DataFrame:
    """Lower percentiles of each key from weighted values of any type that has an order.

    The weighted values are put in order of (key, value) by ranges of about equal size, so a hot key lies in as many
    ranges as it fills. Sums of each range and key, of which a key has no more than there are ranges, say what comes
    before; within a range the weights are added up in order. No task ever holds all values of a key.
    """
    known = freq.where(F.col(value).isNotNull() & F.col("key").isNotNull()).select("key", F.col(value).alias("v"), "w")
    parts = int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(known.repartitionByRange(parts, "key", "v").withColumn("range", F.spark_partition_id()), "placed")
    of_key = Window.partitionBy("key")
    sums = placed.groupBy("range", "key").agg(F.sum("w").alias("rw"))
    sums = sums.select("range", "key", F.coalesce(F.sum("rw").over(of_key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rw").over(of_key).alias("n"))
    inside = Window.partitionBy("range", "key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    x = placed.join(sums, ["range", "key"]).withColumn("upto", F.col("before") + F.sum("w").over(inside))
    picked = []
    for name, share in shares.items():
        need = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * share, 9)))
        picked.append(F.max(F.when((F.col("upto") >= need) & (F.col("upto") - F.col("w") < need), F.col("v"))).alias(name))
    return x.groupBy("key").agg(*picked)
