"""Processing only new or changed records by partition fingerprints.

A partition's fingerprint is its number of records and two sums of 64-bit hashes of (key, content). Sums add up
in any order, so a fingerprint is one aggregate with a map-side combine, and no record is shuffled for it.
Partitions with equal fingerprints are left alone; of the others the records are compared one by one, and
``PartitionStore`` replaces the partition whole.

Defined results: a null key is no record; a null content differs from everything, also from null; exact
duplicates count once; columns beyond those named are carried by ``PartitionStore`` and ignored by
``changed_records``; empty inputs give empty results (and an empty listing drops every stored partition).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_path, latest, written

LEAST_PARTITIONS = 16
#: A folder with more rows than so many usual partitions gets partitions of its own.
HOT = 4
#: A layout is made anew when there are so many times the rows it was made for.
GROWTH = 4
_WIDE = T.DecimalType(38, 0)


def partitions_for(rows: int) -> int:
    """As many partitions as a partition has rows, to a power of two: the list of them grows as the root of the table."""
    return max(LEAST_PARTITIONS, 1 << math.ceil(math.log2(max(1.0, math.sqrt(rows)))))


def by_hash(key: str, partitions: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(partitions)).cast("int")


def folder_of(key: str) -> Column:
    """The folder of a path, empty for none."""
    return F.regexp_extract(F.col(key), "^(.*)/", 1)


def fingerprints(df: DataFrame, partition: str, columns: list[str]) -> DataFrame:
    """(partition, n, a, b, nulls): rows, two additive hashes over ``columns`` and rows with a null in them, of each partition."""
    mark = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns]
    return df.groupBy(partition).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*mark).cast(_WIDE)).alias("a"),
        F.sum(F.xxhash64(F.lit("b"), *reversed(mark)).cast(_WIDE)).alias("b"),
        F.count_if(reduce(Column.__or__, [F.col(c).isNull() for c in columns])).alias("nulls"),
    )


def changed_partitions(now: DataFrame, stored: DataFrame, partition: str) -> DataFrame:
    """The partitions whose fingerprints differ, that are on one side only, or that hold a null content."""
    s = stored.select(F.col(partition).alias("_p"), F.col("n").alias("_n"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    joined = now.join(s, now[partition].eqNullSafe(s["_p"]), "full_outer")
    same = now["n"].eqNullSafe(s["_n"]) & now["a"].eqNullSafe(s["_a"]) & now["b"].eqNullSafe(s["_b"]) & now["nulls"].eqNullSafe(F.lit(0))
    return joined.where(~same).select(F.coalesce(now[partition], s["_p"]).alias(partition))


def _unchanged(content: list[str]) -> Column:
    """Whether a record has the content that is stored as ``_w0``, ``_w1``, ...; a null is known on neither side."""
    return F.coalesce(reduce(Column.__and__, [F.col(c) == F.col(f"_w{i}") for i, c in enumerate(content)]), F.lit(False))


def changed_records(current: DataFrame, stored: DataFrame, key: str, content: str, partitions: int | None = None) -> DataFrame:
    """Keys of ``current`` whose content differs from the one in ``stored`` or that have none there, without a store.

    Both inputs have one row per key. They are written once, partitioned by hash of the key; only the folders of
    the changed partitions are read again and compared.
    """
    count = partitions or partitions_for(current.count())
    sides = []
    for side, df in (("now", current), ("was", stored)):
        kept = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(content).alias("_c"), by_hash(key, count).alias("_part"))
        sides.append(written(kept.repartition("_part"), f"records-{side}", ["_part"]))
    now, was = sides
    ids = [r[0] for r in changed_partitions(*[fingerprints(df, "_part", ["_k", "_c"]) for df in sides], "_part").collect()]  # ``count`` numbers at most
    near = now.where(F.col("_part").isin(ids))
    far = was.where(F.col("_part").isin(ids)).select("_k", F.col("_c").alias("_w0"))
    return near.join(far, "_k", "left").where(~_unchanged(["_c"])).select(F.col("_k").alias(key))


@dataclass
class Layout:
    """How keys are put into partitions: ``parts`` for small folders, and for each hot folder where its own begin and how many they are."""

    number: int
    parts: int
    made_for: int
    hot: dict[str, tuple[int, int]]


class Run(dict):
    """``run``: its number; ``partitions``: how many it replaced. The attribute ``pending`` has the records it processed."""

    pending: DataFrame


class PartitionStore:
    """Results kept per partition and refreshed only where the input changed.

    ``refresh`` compares the fingerprints of the input with those that the last run that ended has stored, finds in
    the changed partitions the records that are new or have another content, gives only these to ``work``, and
    replaces each changed partition, made up of what ``work`` returns and of the records that stay, through dynamic
    partition overwrite. What a run writes carries its number; the last thing it writes is the table of fingerprints
    with the run that holds each partition, under its own number and by one rename. A run that fails anywhere before
    that leaves the older table in force and with it every row of the older runs: the next run sees the same changes
    or, if the input has gone back, none. Nothing is skipped and nothing stands twice.

    Partitions are folders of the key where ``folder`` is given, so that what changes together lies together; small
    folders share one by hash, a folder of many rows is spread over several by hash of its keys. Their number grows
    as the root of the number of rows unless ``partitions`` sets it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, content: list[str], partitions: int | None = None, folder: Callable[[str], Column] | None = None):
        self.spark, self.path, self.key, self.content, self.partitions, self.folder = spark, path.rstrip("/"), key, list(content), partitions, folder
        self._fs, _ = hadoop_path(spark, self.path)

    def _at(self, *parts: str):
        return hadoop_path(self.spark, "/".join([self.path, *parts]))[1]

    def runs(self) -> list[int]:
        """The numbers of the runs that have ended, in order."""
        if not self._fs.exists(self._at("fingerprints")):
            return []
        names = [s.getPath() for s in self._fs.listStatus(self._at("fingerprints"))]
        return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("run=") and self._fs.exists(self._at("fingerprints", p.getName(), "_SUCCESS")))

    def _manifest(self, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fingerprints/run={run}")

    def _read(self, slots: list[str]) -> DataFrame | None:
        """The rows of some slots; a slot is one partition as one run wrote it, and one folder of the data."""
        if not self._fs.exists(self._at("data")):
            return None
        data = self.spark.read.schema(self._schema()).parquet(f"{self.path}/data")
        return data.where(F.col("_slot").isin(slots) & F.col(self.key).isNotNull()).drop("_slot")

    def _schema(self) -> T.StructType:
        told = self._text("schema.json")
        # a run may have been lost while it replaced the file: the data tell the same
        return T.StructType.fromJson(json.loads(told)) if told else self.spark.read.parquet(f"{self.path}/data").schema

    def _text(self, name: str) -> str | None:
        """The content of a small file of the store."""
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Replaces a small file by one rename."""
        part = f".{name}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(part))
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(part), self._at(name))

    def rows(self) -> DataFrame:
        """The rows of the last run that ended: a list of slots, of which there are as many as partitions."""
        runs = self.runs()
        slots = [r[0] for r in self._manifest(runs[-1]).select("slot").collect()] if runs else []
        found = self._read(slots)
        return found if found is not None else self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [self.key, *self.content]))

    # layout

    def _layout(self, rows: DataFrame | None) -> Layout:
        """The layout the store has, or a new one for ``rows`` where there is none or they have outgrown it."""
        told = self._text("layout.json")
        old = Layout(**json.loads(told)) if told else None
        if old and (rows is None or self.partitions):
            return old
        n = rows.count()
        if old and n <= GROWTH * old.made_for:
            return old
        made = Layout(old.number + 1 if old else 0, self.partitions or partitions_for(n), n, {})
        if self.folder is not None:
            sizes = rows.groupBy(self.folder(self.key).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
            start = made.parts
            # at most n / (HOT * n / parts) = parts / HOT folders
            for r in sizes.where(F.col("n") > F.lit(HOT * max(1, n // made.parts))).orderBy("folder").collect():
                own = 1 << math.ceil(math.log2(r["n"] * made.parts / n))
                made.hot[r["folder"]] = (start, own)
                start += own
        self._put("layout.json", json.dumps(asdict(made)))
        return made

    def _placed(self, rows: DataFrame, layout: Layout) -> DataFrame:
        """Rows with the number of their partition, which tells the layout as well."""
        base = F.lit(layout.number << 40).cast("bigint")
        if self.folder is None:
            return rows.withColumn("_part", base + by_hash(self.key, layout.parts))
        usual = F.pmod(F.xxhash64(self.folder(self.key)), F.lit(layout.parts))
        if not layout.hot:
            return rows.withColumn("_part", base + usual)
        hot = self.spark.createDataFrame([(f, a, n) for f, (a, n) in layout.hot.items()], "_f string, _start int, _own int")
        x = rows.withColumn("_f", self.folder(self.key)).join(F.broadcast(hot), "_f", "left")  # a quarter of the partitions at most
        spread = F.col("_start") + F.pmod(F.xxhash64(F.col(self.key)), F.col("_own"))
        return x.withColumn("_part", base + F.coalesce(spread, usual)).drop("_f", "_start", "_own")

    # runs

    def refresh(self, source: DataFrame, work: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> Run:
        """Bring the store to the state of ``source``, which has one row per key.

        ``before_commit`` is called between the data and the commit; tests make it raise.
        """
        src = written(source.where(F.col(self.key).isNotNull()).dropDuplicates(), "source")
        layout = self._layout(src)
        return self._advance(self._placed(src, layout), layout, None, work, before_commit)

    def upsert(self, rows: DataFrame, by: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, before_commit: Callable[[], None] | None = None) -> Run:
        """Take up some rows: of each key the row with the greatest ``by`` stays, whatever the order they come in.

        Only the partitions that the rows fall into are read. The layout stays as the first rows have made it.
        """
        columns = list(dict.fromkeys([*self.content, by]))
        best = lambda df: latest(df.select(self.key, *columns, F.col(by).alias("_by")), self.key, "_by", columns)
        new = written(best(rows.where(F.col(self.key).isNotNull())), "batch")
        layout = self._layout(None if self.runs() else new)
        touched = [r[0] for r in self._placed(new, layout).select("_part").distinct().collect()]
        old = self._read(self._slots(touched)) if self.runs() else None
        both = new if old is None else best(new.select(self.key, *columns).unionByName(old.select(self.key, *columns)))
        return self._advance(self._placed(written(both, "merged"), layout), layout, touched, work, before_commit)

    def _slots(self, parts: list[int]) -> list[str]:
        m = self._manifest(self.runs()[-1])
        return [r[0] for r in m.where(F.col("_part").isin(parts)).select("slot").collect()]

    def _advance(self, src: DataFrame, layout: Layout, only: list[int] | None, work: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None) -> Run:
        runs = self.runs()
        run = runs[-1] + 1 if runs else 1
        now = written(fingerprints(src, "_part", [self.key, *self.content]), "fingerprints")
        stored = self._manifest(runs[-1]) if runs else now.withColumn("slot", F.lit("")).limit(0)
        scope = stored if only is None else stored.where(F.col("_part").isin(only))
        ids = [r[0] for r in changed_partitions(now, scope, "_part").collect()]  # as many as there are partitions at most
        done = Run(run=run if ids else (runs[-1] if runs else 0), partitions=len(ids))
        near = src.where(F.col("_part").isin(ids)).drop("_part")
        if not ids:
            done.pending = near
            return done
        old = self._read(self._slots(ids)) if runs else None
        if old is None:
            done.pending, kept = near, None
        else:
            far = old.select(F.col(self.key).alias("_k"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(self.content)])
            done.pending = written(near.join(far, near[self.key] == far["_k"], "left").where(~_unchanged(self.content)).select(near.columns), "pending")
            same = near.select(F.col(self.key).alias("_k"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(self.content)])
            kept = old.join(same, (old[self.key] == same["_k"]) & reduce(Column.__and__, [old[c] == same[f"_w{i}"] for i, c in enumerate(self.content)]), "left_semi")
        out = work(done.pending)
        out = out if kept is None else out.unionByName(kept, allowMissingColumns=True)
        self._write(self._placed(out, layout), ids, run)
        if before_commit:
            before_commit()
        slot = F.concat(F.lit(f"r{run}p"), F.col("_part").cast("string"))
        fresh = now.where(F.col("_part").isin(ids)).withColumn("slot", slot)
        rest = stored.where(~F.col("_part").isin(ids))
        self._commit(fresh.unionByName(rest), run)
        return done

    def _write(self, out: DataFrame, ids: list[int], run: int) -> None:
        # one null row for each changed partition: what a failed attempt left in it is overwritten in any case
        empty = self.spark.createDataFrame([(i,) for i in ids], "_part bigint")
        out = out.unionByName(empty, allowMissingColumns=True).withColumn("_slot", F.concat(F.lit(f"r{run}p"), F.col("_part").cast("string"))).drop("_part")
        self._put("schema.json", out.schema.json())
        tasks = min(len(ids), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        out.repartition(tasks, "_slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_slot").parquet(f"{self.path}/data")

    def _commit(self, manifest: DataFrame, run: int) -> None:
        part = f".run={run}-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.path}/fingerprints/{part}")
        if not self._fs.rename(self._at("fingerprints", part), self._at("fingerprints", f"run={run}")):
            raise RuntimeError(f"run {run} was committed by another writer")
        self._tidy()

    def _tidy(self, keep: int = 2) -> None:
        """Removes the slots that none of the last runs names; readers of the run before may still be at work."""
        runs = self.runs()
        if len(runs) <= keep:
            return
        held = {r[0] for run in runs[-keep:] for r in self._manifest(run).select("slot").collect()}
        for s in self._fs.listStatus(self._at("data")):
            name = s.getPath().getName()
            if name.startswith("_slot=") and name[6:] not in held:
                self._fs.delete(s.getPath(), True)
        for run in runs[:-keep]:
            self._fs.delete(self._at("fingerprints", f"run={run}"), True)
