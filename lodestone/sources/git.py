"""What git says, as DataFrames: commits, changed files, hunks."""

from __future__ import annotations

import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import hadoop_path, kept, shared_dir

#: Where a branch may have begun, in order.
BASES = ["origin/HEAD", "origin/main", "origin/master", "main", "master"]


def git(root: str, *args: str) -> str | None:
    """Output of a git command; null where it fails."""
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None


def is_worktree(root: str) -> bool:
    return (git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def head(root: str) -> str | None:
    return (git(root, "rev-parse", "HEAD") or "").strip() or None


def base_ref(root: str, wanted: str | None = None) -> tuple[str, str | None]:
    """The ref to compare with, and a note where it is not the one wanted."""
    for ref in [wanted] if wanted else BASES:
        if git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}"):
            return ref, None
    return "HEAD", f"{wanted or 'no base branch'} not found; compared with HEAD"


def commits(spark: SparkSession, root: str, since: str | None = None) -> DataFrame | None:
    """(commit_id, file) of the history; null outside a repository, which is not the same as an empty history.

    What git says goes to a file in the shared folder as it comes, and is taken apart there: the driver holds none of it.
    """
    if not is_worktree(root):
        return None
    folder = f"{shared_dir(spark)}/tables/history-{uuid.uuid4().hex}"
    fs, path = hadoop_path(spark, folder)
    kept(fs, path)
    to = fs.create(hadoop_path(spark, f"{folder}/log")[1])
    cmd = ["git", "-C", root, "-c", "core.quotepath=off", "log", "--no-merges", "--name-only", "--format=%x1e%H", *([f"--since={since}"] if since else [])]
    with subprocess.Popen(cmd, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        while part := run.stdout.read(1 << 20):
            to.write(part, 0, len(part))
    to.close()
    blocks = spark.read.option("lineSep", "\x1e").text(folder).where("trim(value) <> ''")
    lines = blocks.select(F.split("value", "\n").alias("x"))
    return lines.select(F.col("x")[0].alias("commit_id"), F.explode(F.slice("x", 2, F.size("x"))).alias("file")).where("file <> ''")


def diff_files(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """(path, status, old_path, added, deleted, is_binary) from the lines of --name-status and of --numstat."""
    p = F.split("text", "\t")
    s = lines.where("text <> ''").select(F.element_at(p, -1).alias("path"), F.substring(F.element_at(p, 1), 1, 1).alias("status"), F.when(F.size(p) > 2, F.element_at(p, 2)).alias("old_path"))
    n = stats.where("text <> ''").select(F.element_at(p, 3).alias("path"), F.when(F.element_at(p, 1) != "-", F.element_at(p, 1).cast("int")).alias("added"), F.when(F.element_at(p, 2) != "-", F.element_at(p, 2).cast("int")).alias("deleted"), (F.element_at(p, 1) == "-").alias("is_binary"))
    return s.join(n, "path", "left")


def hunks(lines: DataFrame) -> DataFrame:
    """(path, start, stop, approx): new-side line ranges of a diff of one change set, carried forward from file headers.

    ``lines``: change, line_no, text. The window runs within one change set, whose size is that of one diff.
    """
    path = F.regexp_extract("text", r"^\+\+\+ b/(.*)$", 1)
    order = Window.partitionBy("change").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("path", F.last(F.when(path != "", path), ignorenulls=True).over(order))
    at = lambda g: F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", g)
    x = x.where(at(1) != "").select("change", "path", at(1).cast("int").alias("start"), F.when(at(2) == "", 1).otherwise(at(2).try_cast("int")).alias("n"))
    start = F.greatest(F.col("start"), F.lit(1))
    return x.select("change", "path", start.alias("start"), F.when(F.col("n") == 0, start).otherwise(F.col("start") + F.col("n") - 1).alias("stop"), (F.col("n") == 0).alias("approx"))


def changed_since(root: str, ref: str) -> set[str]:
    """Files that differ from a ref or are not yet known to git."""
    names = (git(root, "diff", "--name-only", "-z", ref) or "") + (git(root, "ls-files", "--others", "--exclude-standard", "-z") or "")
    return {n for n in names.split("\0") if n}
