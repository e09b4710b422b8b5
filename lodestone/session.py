"""The session, the shared folder and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t"
_own: dict[str, str] = {}


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(map=conf)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only in local mode may it be unset; then it is one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="lodestone-"))
    return folder.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, to look at and remove what lies in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


_tables: list[tuple] = []


def kept(files, path) -> None:
    """Notes what ``release`` removes."""
    _tables.append((files, path))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The DataFrame written as a table in the shared folder and read again: it survives the loss of executors.

    Results may depend on it as long as the process runs; ``release`` removes it, at the end of the process at the latest.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    kept(*hadoop_path(spark, path))
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Removes the tables that ``written`` has made. Nothing that depends on them may be used afterwards."""
    while _tables:
        files, path = _tables.pop()
        try:
            files.delete(path, True)
        except Exception:  # noqa: BLE001 the JVM may have ended before
            return


def clean(column: Column | str) -> Column:
    """A string without blanks and tabs at its ends; an empty one is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, by: str, columns: list[str]) -> DataFrame:
    """The row of each key with the greatest ``by`` (null lowest); ties go to the greatest values of ``columns``.

    An aggregate, not a window, so that older rows leave before the shuffle.
    """
    rest = [c for c in columns if c not in (key, by)]
    best = F.max(F.struct(F.col(by), *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in columns if c != key])
