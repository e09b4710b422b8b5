"""Top N items of every group by statistics-guided skipping.

The items are written once, clustered: range-partitioned and sorted by (group, score descending), so a hot group
spans many blocks of falling score and small groups share one. Each block is a file, and for each block and group
the greatest and least score and the number of items are kept, from which follows without reading a block which
blocks a group needs: in descending order of their greatest score until they hold N items. Those are read first
and give each group its current N-th score. Then every block is read that is not strictly below that score for at
least one of its groups; the others are skipped. What was read holds the exact answer, ties included.

Ranking is by score, then the further orders given. The last step ranks only items at or above their group's N-th
score. A ``Clustered`` table may be asked any number of times.

Defined results: items with a null group or a null or NaN score do not rank; the orders' nulls go last; repeated
rows count once; a group with fewer than N items gives all; empty tables give no rows; columns not named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import written

LEAST_ROWS = 2000


def block_rows_for(rows: int) -> int:
    """Rows of a block: four times the root, so that blocks and the list of them grow alike, a quarter of the root each."""
    return max(LEAST_ROWS, 4 * math.isqrt(rows))


class Clustered:
    """Items in blocks by group and falling score, with the statistics of each block."""

    def __init__(self, items: DataFrame, group: str, score: str, block_rows: int | None = None):
        self.spark, self.group, self.score = items.sparkSession, group, score
        seen = Observation()
        ranked = items.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
        ranked = written(ranked.observe(seen, F.count(F.lit(1)).alias("n")), "ranked")
        total = seen.get["n"]
        self.blocks = max(1, -(-total // (block_rows or block_rows_for(total))))
        order = [F.col(group), F.col(score).desc()]
        self.rows = written(ranked.repartitionByRange(self.blocks, *order).sortWithinPartitions(*order), "clustered")
        name = F.col("_metadata.file_name").alias("block")
        self.stats = written(self.rows.select(name, group, score).groupBy("block", group).agg(F.max(score).alias("hi"), F.min(score).alias("lo"), F.count(F.lit(1)).alias("n")), "block-stats")
        #: The blocks that the last question has read, first those that give the N-th scores.
        self.read: tuple[list[str], list[str]] = ([], [])

    def _of(self, names: list[str]) -> DataFrame:
        folder = self.rows.inputFiles()[0].rsplit("/", 1)[0]
        return self.spark.read.schema(self.rows.schema).parquet(*[f"{folder}/{x}" for x in names])

    def top(self, n: int, ties: list[Column]) -> DataFrame:
        """The first n items of each group with their ``rank_no``; ``ties`` order items of equal score."""
        group, score = self.group, self.score
        order = Window.partitionBy(group).orderBy(F.desc("hi"), F.desc("lo"), "block").rowsBetween(Window.unboundedPreceding, -1)
        needed = self.stats.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < n)
        first = sorted(r[0] for r in needed.select("block").distinct().collect())  # the list of blocks at most
        if not first:
            self.read = ([], [])
            return self.rows.withColumn("rank_no", F.lit(0)).limit(0)
        best = Window.partitionBy(group).orderBy(F.desc(score))
        nth = self._of(first).select(group, score).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).groupBy(group).agg(F.min(score).alias("_nth"), F.max("_r").alias("_have"))
        nth = written(nth.select(group, F.when(F.col("_have") >= n, F.col("_nth")).alias("_nth")), "nth")
        alive = self.stats.join(nth, group).where(F.col("_nth").isNull() | (F.col("hi") >= F.col("_nth")))
        every = sorted({r[0] for r in alive.select("block").distinct().collect()} | set(first))
        self.read = (first, every)
        near = self._of(every).join(nth, group).where(F.col("_nth").isNull() | (F.col(score) >= F.col("_nth"))).drop("_nth")
        final = Window.partitionBy(group).orderBy(F.desc(score), *ties)
        return near.withColumn("rank_no", F.row_number().over(final)).where(F.col("rank_no") <= n)


def top_n(items: DataFrame, group: str, score: str, ties: list[Column], n: int, block_rows: int | None = None) -> DataFrame:
    """The first n items of each group of a table that is clustered for this question."""
    return Clustered(items, group, score, block_rows).top(n, ties)
