"""Parent-child links to full hierarchies by tree contraction.

Contraction alternates raking of leaves and splicing of nodes with one child, records each removed node with the
node it hangs on and the distance, and reverses the records. What never ends is a core: a node that became its own
parent lies on a cycle.

Trees lie inside files. The symbols are shuffled once, by file; there the parent row of each symbol is found by one
sweep in order of (name, pos), and whole files are contracted, many at a time, as arrays. A file of more than
``FILE_ROWS`` rows is never held by one task: its links are found in a shuffle on (file, name) and contracted in
rounds over DataFrames, each written to the shared folder, so lineage stays short and lost executors cost no round.

Defined results: names and parents are trimmed, empty ones are null; a null name is nobody's parent; a null pos or
file is no symbol; repeated rows count once; of rows that share file and pos the least parent counts; a symbol that
is its own parent is a cycle of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import clean, written
from .sweep import by_file

#: Rows of a file that one task contracts at once.
FILE_ROWS = 200_000


def _tidy(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("file").isNotNull() & F.col("pos").isNotNull()).select("file", F.col("pos").cast("int").alias("pos"), clean("name").alias("name"), clean("parent").alias("parent"))


def parent_links(symbols: DataFrame, by_file: bool = False) -> DataFrame:
    """(file, pos, up) for each symbol whose parent row exists.

    Symbols and references meet in one shuffle on (file, name), or on the file alone if ``by_file``, and are swept in
    order of pos: the last symbol passed is the nearest with a smaller pos, the first one of the name is the fallback.
    """
    s = _tidy(symbols)
    if by_file:
        s = s.repartition("file")
    both = F.array(
        F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("name"), F.lit(0).alias("is_def"))),
        F.when(F.col("name").isNotNull(), F.struct(F.col("name"), F.lit(1).alias("is_def"))),
    )
    rows = s.select("file", "pos", F.explode(F.array_compact(both)).alias("r")).select("file", "pos", F.col("r.name").alias("name"), F.col("r.is_def").alias("is_def"))
    order = Window.partitionBy("file", "name").orderBy("pos", "is_def")
    at = F.when(F.col("is_def") == 1, F.col("pos"))
    near = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = rows.select("file", "pos", "is_def", near.alias("near"), F.min(at).over(Window.partitionBy("file", "name")).alias("first"))
    return swept.where("is_def = 0").select("file", "pos", F.coalesce("near", "first").alias("up")).where("up is not null")


class Forest:
    """The links of whole files as arrays, contracted: for each node its parent's place, root, depth."""

    def __init__(self, file: np.ndarray, pos: np.ndarray, up: np.ndarray):
        """``file`` numbers the files; one link for each (file, pos)."""
        key, goal = file << 32 | pos.astype(np.int64) & 0xFFFFFFFF, file << 32 | up.astype(np.int64) & 0xFFFFFFFF
        order = np.argsort(key, kind="stable")
        at = np.searchsorted(key[order], goal)
        at[at == len(key)] = 0
        found = key[order][at] == goal
        #: Place of the parent, -1 where it has no parent itself and is a root.
        self.parent = np.where(found, order[at], -1)
        self.pos, self.up = pos, up
        self.root, self.depth = self._contract()

    def _contract(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.pos)
        parent, up, weight = self.parent.copy(), self.up.copy(), np.ones(n, np.int64)
        alive = np.arange(n)
        removed: list[np.ndarray] = []
        rng = np.random.default_rng(1)
        while True:
            alive = alive[parent[alive] != alive]  # its own parent: a core
            if not len(alive):
                break
            hanging = parent[alive]
            kids = np.bincount(hanging[hanging >= 0], minlength=n)
            leaf = alive[kids[alive] == 0]
            coin = rng.random(n) < 0.5
            inner = alive[kids[alive] > 0]
            above = parent[inner]
            splice = inner[(kids[inner] == 1) & coin[inner] & ((above < 0) | ~coin[above])]
            gone = np.zeros(n, bool)
            gone[leaf] = gone[splice] = True
            removed += [leaf, splice]
            alive = alive[~gone[alive]]
            over = np.zeros(n, bool)
            over[splice] = True
            hang = alive[(parent[alive] >= 0)]
            hang = hang[over[parent[hang]]]
            mid = parent[hang]
            weight[hang] += weight[mid]
            up[hang], parent[hang] = up[mid], parent[mid]
        root, depth = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for nodes in reversed(removed):
            above = parent[nodes]
            top = above < 0
            root[nodes] = np.where(top, up[nodes], root[above])
            depth[nodes] = np.where(top, weight[nodes], np.where(depth[above] < 0, -1, depth[above] + weight[nodes]))
        return root, depth

    def paths(self) -> list[list[int] | None]:
        """For each node the pos of all from the root down to it, null on or below a cycle."""
        out: list[list[int] | None] = [None] * len(self.pos)
        pos, up, parent = self.pos.tolist(), self.up.tolist(), self.parent.tolist()
        for i in np.argsort(self.depth, kind="stable")[np.count_nonzero(self.depth < 0) :].tolist():
            out[i] = [*(out[parent[i]] if parent[i] >= 0 else (up[i],)), pos[i]]
        return out


def _contracted(links: DataFrame, with_path: bool) -> DataFrame:
    """(file, pos, up, root_pos, depth[, path]) of links that lie together by file, many whole files at a time."""
    fields = [("file", pa.string()), ("pos", pa.int32()), ("up", pa.int32()), ("root_pos", pa.int32()), ("depth", pa.int32())]
    schema = pa.schema(fields + [("path", pa.list_(pa.int32()))] * with_path)

    def contract_files(rows: pa.Table, file: np.ndarray) -> pa.Table:
        pos, up = (rows[c].to_numpy() for c in ("pos", "up"))
        order = np.lexsort((up, pos, file))
        one = np.ones(len(order), bool)
        one[1:] = (file[order][1:] != file[order][:-1]) | (pos[order][1:] != pos[order][:-1])
        keep = order[one]
        forest = Forest(file[keep], pos[keep], up[keep])
        columns = [rows["file"].take(pa.array(keep)), pa.array(pos[keep], pa.int32()), pa.array(up[keep], pa.int32()), pa.array(forest.root, pa.int32()), pa.array(forest.depth, pa.int32())]
        if with_path:
            columns.append(pa.array(forest.paths(), pa.list_(pa.int32())))
        return pa.table(columns, schema=schema)

    spec = "file string, pos int, up int, root_pos int, depth int" + ", path array<int>" * with_path
    return links.sortWithinPartitions("file").mapInArrow(by_file(contract_files), spec)


def _coin(column: str, turn: int):
    return F.pmod(F.xxhash64(F.col("file"), F.col(column), F.lit(turn)), F.lit(2)) == 1


def contract(links: DataFrame, with_path: bool = False) -> DataFrame:
    """(file, pos, root_pos, depth) of each node in ``links`` (file, pos, up), -1 and -1 for those on or below a cycle.

    ``with_path``: also the array of pos from the root to the node; a spliced edge then keeps the nodes it leaps.
    """
    extra = ["leapt"] if with_path else []
    no_nodes = F.expr("cast(array() as array<int>)")
    alive = written(links.dropDuplicates(["file", "pos"]).select("file", "pos", "up", F.lit(1).alias("w"), *[no_nodes.alias("leapt")] * with_path), "alive")
    records: list[DataFrame] = []
    cores = None
    turn = 0
    while True:
        fixed = alive.where("pos = up")
        cores = fixed.select("file", "pos") if cores is None else cores.unionByName(fixed.select("file", "pos"))
        alive = alive.where("pos <> up")
        kids = alive.groupBy("file", F.col("up").alias("pos")).agg(F.count(F.lit(1)).alias("kids"))
        state = alive.join(kids, ["file", "pos"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
        parents = alive.select("file", F.col("pos").alias("up"), F.lit(1).alias("hangs"))
        state = state.join(parents, ["file", "up"], "left")  # a parent that hangs on nothing is a root and stays
        splice = (F.col("kids") == 1) & _coin("pos", turn) & (F.col("hangs").isNull() | ~_coin("up", turn))
        step = F.when(F.col("kids") == 0, 0).when(splice, 1).otherwise(2)
        seen = Observation()
        state = state.select("file", "pos", "up", "w", *extra, step.alias("step")).observe(seen, F.count(F.lit(1)).alias("all"), F.count_if(F.col("step") > 0).alias("inner"))
        state = written(state, "round")
        if not seen.get["all"]:
            break
        records.append(state.where("step < 2"))
        if not seen.get["inner"]:
            break
        gone = state.where("step = 1").select("file", F.col("pos").alias("up"), F.col("up").alias("up2"), F.col("w").alias("w2"), *[F.concat("leapt", F.array("pos")).alias("leapt2")] * with_path)
        rest = state.where("step = 2").join(gone, ["file", "up"], "left")
        alive = written(rest.select("file", "pos", F.coalesce("up2", "up").alias("up"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), *[F.concat(F.coalesce("leapt2", no_nodes), "leapt").alias("leapt")] * with_path), "alive")
        turn += 1
    done = written(cores.select("file", "pos", F.lit(-1).alias("root_pos"), F.lit(-1).alias("depth"), *[F.lit(None).cast("array<int>").alias("path")] * with_path), "resolved")
    for state in reversed(records):
        for step in (1, 0):
            known = done.select("file", F.col("pos").alias("up"), F.col("root_pos").alias("r"), F.col("depth").alias("d"), *[F.col("path").alias("p")] * with_path)
            got = state.where(F.col("step") == step).join(known, ["file", "up"], "left")
            root = F.coalesce("r", "up")
            depth = F.when(F.col("d") == -1, -1).otherwise(F.coalesce("d", F.lit(0)) + F.col("w"))
            path = F.when(depth != -1, F.concat(F.coalesce("p", F.array("up")), "leapt", F.array("pos"))) if with_path else None
            done = done.unionByName(got.select("file", "pos", root.alias("root_pos"), depth.cast("int").alias("depth"), *([path.alias("path")] if with_path else [])))
        done = written(done, "resolved")
    return done


def placed(symbols: DataFrame, with_path: bool = False, file_rows: int = FILE_ROWS) -> DataFrame:
    """(file, pos, up, root_pos, depth[, path]) of each symbol that has a parent; root_pos and depth are -1 on or below a cycle."""
    sizes = symbols.where(F.col("file").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > file_rows).select("file"), "large-files")
    some = large.limit(1).count() > 0
    small = symbols.select("file", "pos", "name", "parent")
    out = _contracted(parent_links(small.join(large, "file", "left_anti") if some else small, by_file=True), with_path)
    if some:
        links = written(parent_links(small.join(large, "file", "left_semi")).groupBy("file", "pos").agg(F.min("up").alias("up")), "links")
        out = out.unionByName(contract(links, with_path).join(links, ["file", "pos"]).select(out.columns))
    return out


def hierarchy(symbols: DataFrame) -> DataFrame:
    """(file, pos, up, root_pos, depth) of each symbol that has a parent; root_pos and depth are -1 on or below a cycle."""
    return placed(symbols)


def deep_or_cyclic(symbols: DataFrame) -> DataFrame:
    """(file, pos, root_pos, depth) of the symbols with at least two ancestors or on or below a cycle."""
    return placed(symbols).where("depth >= 2 or depth = -1").select("file", "pos", "root_pos", "depth")


def _node_paths(symbols: DataFrame) -> DataFrame:
    """(file, pos, depth, path) of every symbol: the array of pos from the root down to it, null on or below a cycle."""
    below = written(placed(symbols, with_path=True).select("file", "pos", "depth", "path"), "paths-below")
    every = symbols.where(F.col("file").isNotNull() & F.col("pos").isNotNull()).select("file", "pos").distinct()
    roots = every.join(below.select("file", "pos"), ["file", "pos"], "left_anti").select("file", "pos", F.lit(0).alias("depth"), F.array("pos").alias("path"))
    return written(below.unionByName(roots), "paths")


def paths(symbols: DataFrame) -> DataFrame:
    """(file, pos, path, depth, root_pos, n_descendants) of every symbol; the path holds names, with a slash between."""
    nodes = _node_paths(symbols)
    names = symbols.where(F.col("file").isNotNull() & F.col("pos").isNotNull()).groupBy("file", "pos").agg(F.min(clean("name")).alias("name"))
    steps = nodes.select("file", "pos", F.posexplode("path").alias("i", "at"))
    named = steps.join(names.select("file", F.col("pos").alias("at"), "name"), ["file", "at"])
    text = named.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", F.lit("")).alias("n")))).alias("s"))
    text = text.select("file", "pos", F.array_join(F.transform("s", lambda x: x["n"]), "/").alias("path"))
    below = steps.where("at <> pos").groupBy("file", F.col("at").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    root = F.when(F.col("depth") == -1, -1).otherwise(F.try_element_at(nodes["path"], F.lit(1)))
    return nodes.select("file", "pos", "depth", root.alias("root_pos")).join(text, ["file", "pos"], "left").join(below, ["file", "pos"], "left").select("file", "pos", "path", "depth", "root_pos", F.coalesce("n", F.lit(0)).alias("n_descendants"))


def descendants(symbols: DataFrame) -> DataFrame:
    """(file, pos, descendant, distance): every symbol inside another, at whatever depth."""
    steps = _node_paths(symbols).select("file", F.col("pos").alias("descendant"), "depth", F.posexplode("path").alias("i", "pos"))
    return steps.where("pos <> descendant").select("file", "pos", "descendant", (F.col("depth") - F.col("i")).alias("distance"))
