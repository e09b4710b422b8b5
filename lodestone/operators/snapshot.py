"""Status of each file against the snapshot of the last run, and what follows for the whole index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(listing: DataFrame, snapshot: DataFrame, full_hash: bool = False) -> DataFrame:
    """(rel, status): stat_hit, hash_hit, changed, new or deleted, by one full outer join.

    ``listing``: rel, kind, hash, size, mtime_ms; ``snapshot``: rel, hash, size, mtime_ms. Documents are never
    taken on their stat values alone.
    """
    s = snapshot.select("rel", F.lower("hash").alias("s_hash"), F.col("size").alias("s_size"), F.col("mtime_ms").alias("s_mtime"), F.lit(True).alias("was"))
    x = listing.select("rel", "kind", F.lower("hash").alias("hash"), "size", "mtime_ms", F.lit(True).alias("is")).join(s, "rel", "full_outer")
    stat = (F.col("kind") != "doc") & (F.col("size") == F.col("s_size")) & (F.col("mtime_ms") == F.col("s_mtime")) & F.lit(not full_hash)
    c = F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull(), "new").when(stat, "stat_hit").when(F.col("hash") == F.col("s_hash"), "hash_hit").otherwise("changed")
    return x.select("rel", c.alias("status"))


def flags(statuses: DataFrame) -> DataFrame:
    """One row: whether all content is unchanged and whether the stored snapshot must be written again."""
    hit = F.col("status").isin("stat_hit", "hash_hit")
    return statuses.agg(F.coalesce(F.min(hit), F.lit(True)).alias("content_unchanged"), (~F.coalesce(F.min(F.col("status") == "stat_hit"), F.lit(True))).alias("cache_dirty"), F.count_if(F.col("status") == "deleted").alias("deleted"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: number of files and the sum of 60-bit hashes of (rel, hash), which adds up in any order."""
    line = F.concat_ws(":", "rel", "hash")
    part = F.conv(F.substring(F.sha1(line), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("fingerprint"))
