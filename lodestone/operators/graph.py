"""Graph analytics: PageRank, betweenness, communities, cycles, topological order.

PageRank and the cores of cycles are DataFrame loops over the whole graph; every round is written to the shared
folder. A graph that is counted and found to have at most ``TASK_EDGES`` edges is ranked by one task instead, which
comes to the same ranks. Betweenness is spread over its sources. Communities and the paths of cycles depend on the
order of moves and run in one task, never in the driver, over a graph of at most ``MODULE_EDGES`` edges; a larger one
is refused.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import compiled
from ..functions import constants as K
from ..session import written

#: Edges of a module graph that one task may hold; edges of a graph that one task ranks.
MODULE_EDGES, TASK_EDGES = 5_000_000, 1_000_000
#: Tasks for each core that the sources of shortest paths are dealt to.
SHARES = 4


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = K.DAMPING, iterations: int = K.ITERATIONS, stop: float = K.L1_STOP, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, rank) of weighted PageRank scaled by the number of nodes. ``nodes``: id; ``edges``: src, dst, weight."""
    ids = written(nodes.select("id").distinct(), "ids")
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w"))
    e = written(e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"), "edges")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    if n <= task_edges and e.count() <= task_edges:
        return _ranked_in_one_task(ids, e, damping, iterations, stop)
    out = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("out"))
    e = written(e.join(out.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), "shares")
    links = F.coalesce("links", F.lit(False)).alias("links")
    state = ids.join(out.select("id", F.lit(True).alias("links")), "id", "left").select("id", links, F.lit(1.0 / n).alias("rank"), F.lit(1.0).alias("moved"))
    for turn in range(iterations + 1):
        seen = Observation()  # what the next round needs is summed while the round is written
        state = written(state.observe(seen, F.sum(F.when(~F.col("links"), F.col("rank"))).alias("loose"), F.sum("moved").alias("moved")), "rank")
        if turn == iterations or (seen.get["moved"] or 0.0) < stop:
            break
        base = (1 - damping + damping * (seen.get["loose"] or 0.0)) / n
        got = e.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        state = state.join(got, "id", "left").select("id", "links", new.alias("new"), F.abs(new - F.col("rank")).alias("moved")).withColumnRenamed("new", "rank")
    return state.select("id", (F.col("rank") * n).alias("rank"))


def _in_one_task(nodes: DataFrame, edges: DataFrame, schema: str, work: Callable[[list, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``work`` on the sorted ids and the edges (src, dst, w) of a graph whose size has been checked, in one task of an executor."""
    kind = dict(nodes.dtypes)["id"]
    both = nodes.select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("w")).unionByName(edges.select("src", "dst", F.col("w").cast("double").alias("w")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            every = pd.concat(rows)
            alone = every["dst"].isna()
            yield work(sorted(every["src"][alone].unique()), every[~alone].sort_values(["src", "dst"]))

    return both.coalesce(1).mapInPandas(run, schema)


def _ranked_in_one_task(ids: DataFrame, edges: DataFrame, damping: float, iterations: int, stop: float) -> DataFrame:
    def work(names: list, e: pd.DataFrame) -> pd.DataFrame:
        n = len(names)
        place = pd.Index(names)
        a, b = place.get_indexer(e["src"]), place.get_indexer(e["dst"])
        out = np.bincount(a, weights=e["w"], minlength=n)
        share = e["w"].to_numpy() / out[a]
        loose = np.bincount(a, minlength=n) == 0
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            new = (1 - damping + damping * rank[loose].sum()) / n + damping * np.bincount(b, weights=rank[a] * share, minlength=n)
            moved = np.abs(new - rank).sum()
            rank = new
            if moved < stop:
                break
        return pd.DataFrame({"id": names, "rank": rank * n})

    return _in_one_task(ids, edges, f"id {dict(ids.dtypes)['id']}, rank double", work)


def _checked(edges: DataFrame) -> DataFrame:
    kept = written(edges, "bounded")
    if kept.count() > MODULE_EDGES:
        raise ValueError(f"the module graph has more than {MODULE_EDGES} edges; lift to coarser modules")
    return kept


def betweenness(nodes: DataFrame, edges: DataFrame, most: int | None = K.BETWEENNESS_NODES) -> DataFrame:
    """(id, betweenness, computed), undirected and unweighted, normalised, 6 places; 0 below 3 nodes.

    Above ``most`` nodes (None: no guard) all are 0 and ``computed`` is false.

    One shortest-path sweep for each source in the JVM, spread over the tasks by source; each task sums up its own.
    """
    every = nodes.select("id").distinct().orderBy("id")
    ids = [r[0] for r in (every if most is None else every.limit(most + 1)).collect()]
    n = len(ids)
    if n < 3 or (most is not None and n > most):
        return nodes.select("id").distinct().withColumn("betweenness", F.lit(0.0)).withColumn("computed", F.lit(n < 3))
    spark = nodes.sparkSession
    place = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "id": ids}), "at bigint, id string")
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(place.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("at", f"{end}_at")
    pairs = _checked(pairs).toArrow()
    a, b = pairs["a_at"].to_numpy(), pairs["b_at"].to_numpy()
    tails, heads = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(tails, minlength=n)
    order = np.argsort(-degree, kind="stable")  # what is met most lies together in memory
    spot = np.empty(n, np.int64)
    spot[order] = np.arange(n)
    near = spot[heads][np.lexsort((spot[heads], spot[tails]))]
    graph = spark.createDataFrame([(bytearray(degree[order].astype("<i4").tobytes()), bytearray(near.astype("<i4").tobytes()))], "degree binary, near binary")
    shares = min(n, SHARES * spark.sparkContext.defaultParallelism)
    compiled.register(spark, "lodestone_dependencies", __package__, "Dependencies", "array<double>")
    swept = spark.range(0, shares, 1, shares).crossJoin(F.broadcast(graph)).select(F.call_function("lodestone_dependencies", F.col("id").cast("int"), F.lit(shares), "degree", "near").alias("x"))
    sums = swept.select(F.posexplode("x").alias("spot", "x")).where("x <> 0").groupBy("spot").agg(F.sum("x").alias("x"))
    named = spark.createDataFrame(pd.DataFrame({"spot": spot, "id": ids}), "spot int, id string")
    scale = (n - 1) * (n - 2) / 2
    return named.join(sums, "spot", "left").select("id", F.round(F.coalesce("x", F.lit(0.0)) / 2 / scale, 6).alias("betweenness"), F.lit(True).alias("computed"))


def _louvain(ids: list[str], near: dict[str, dict[str, float]]) -> dict[str, int]:
    """Communities by greedy moves in the order of ids, then of communities as nodes, until nothing moves."""
    home = {i: i for i in ids}
    level_ids, level = ids, near
    loops: dict[str, float] = defaultdict(float)
    for _ in range(K.PASSES):
        degree = {i: sum(level[i].values()) + 2 * loops[i] for i in level_ids}
        twice = sum(degree.values())
        if not twice:
            break
        where = {i: i for i in level_ids}
        mass = dict(degree)
        moved_at_all = False
        for _ in range(K.SWEEPS):
            moved = False
            for i in level_ids:
                links: dict[str, float] = defaultdict(float)
                for j, w in level[i].items():
                    links[where[j]] += w
                own = where[i]
                mass[own] -= degree[i]
                stay = links.get(own, 0.0) - mass[own] * degree[i] / twice
                best, gain = own, stay
                for c in sorted(links):
                    g = links[c] - mass[c] * degree[i] / twice
                    if g > gain + K.EPS:
                        best, gain = c, g
                mass[best] += degree[i]
                if best != own:
                    where[i] = best
                    moved = moved_at_all = True
            if not moved:
                break
        if not moved_at_all:
            break
        home = {i: where[c] for i, c in home.items()}
        fresh: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        inner: dict[str, float] = defaultdict(float)
        for i in level_ids:
            inner[where[i]] += loops[i]
            for j, w in level[i].items():
                if where[i] == where[j]:
                    inner[where[i]] += w / 2
                else:
                    fresh[where[i]][where[j]] += w
        level_ids = sorted(set(where.values()))
        level, loops = {i: dict(fresh[i]) for i in level_ids}, inner
    return _numbered(home)


def _numbered(home: dict[str, str]) -> dict[str, int]:
    groups: dict[str, list[str]] = defaultdict(list)
    for i, c in home.items():
        groups[c].append(i)
    order = sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g))
    return {i: n for n, g in enumerate(order) for i in g}


def communities(nodes: DataFrame, edges: DataFrame, previous: dict[str, int] | None = None) -> DataFrame:
    """(id, community) of the module graph; oversized communities are split once; ids of a previous build are kept
    where most members agree, within 0 to n-1."""
    pairs = _checked(edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").cast("double").alias("w")))
    before = dict(previous or {})

    def work(ids: list, e: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, dict[str, float]] = {i: {} for i in ids}
        for a, b, w in zip(e["src"], e["dst"], e["w"]):
            if a in near and b in near:
                near[a][b] = near[b][a] = w
        members: dict[int, list[str]] = defaultdict(list)
        for i, c in _louvain(ids, near).items():
            members[c].append(i)
        home: dict[str, str] = {}
        for c, own in members.items():
            if len(own) >= K.OVERSIZE_MIN and len(own) > K.OVERSIZE_SHARE * len(ids):
                inside = set(own)
                part = _louvain(sorted(own), {i: {j: w for j, w in near[i].items() if j in inside} for i in own})
                home.update({i: f"{c}/{p}" for i, p in part.items()})
            else:
                home.update({i: str(c) for i in own})
        of = _numbered(home)
        of = _kept(of, before) if before else of
        return pd.DataFrame({"id": ids, "community": [of[i] for i in ids]})

    return _in_one_task(nodes.select("id").distinct(), pairs, "id string, community int", work)


def _kept(now: dict[str, int], before: dict[str, int]) -> dict[str, int]:
    shared: dict[tuple[int, int], int] = defaultdict(int)
    for i, c in now.items():
        if i in before:
            shared[c, before[i]] += 1
    n = len(set(now.values()))
    name: dict[int, int] = {}
    for (c, old), _ in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
        if c not in name and old < n and old not in name.values():
            name[c] = old
    free = iter(sorted(set(range(n)) - set(name.values())))
    for c in sorted(set(now.values())):
        if c not in name:
            name[c] = next(free)
    return {i: name[c] for i, c in now.items()}


def _cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) among nodes that a cycle can hold: those without an edge in or out are trimmed away in rounds."""
    e = written(edges.where("src <> dst").select("src", "dst").distinct(), "cycle-edges")
    n = e.count()
    while n:
        core = e.select(F.col("src").alias("x")).intersect(e.select(F.col("dst").alias("x")))
        e2 = written(e.join(core.withColumnRenamed("x", "src"), "src", "left_semi").join(core.withColumnRenamed("x", "dst"), "dst", "left_semi"), "cycle-edges")
        m = e2.count()
        e, n, same = e2, m, m == n
        if same:
            break
    return e


def _neighbours(e: pd.DataFrame) -> dict[str, list[str]]:
    g: dict[str, list[str]] = defaultdict(list)
    for a, b in zip(e["src"], e["dst"]):
        g[a].append(b)
    return g


def strong_sets(edges: DataFrame) -> DataFrame:
    """(id, least) of each node on a cycle, with the least member of its strongly connected set."""

    def work(_: list, e: pd.DataFrame) -> pd.DataFrame:
        rows = [(v, min(part)) for part in _strong(_neighbours(e)) if len(part) > 1 for v in part]
        return pd.DataFrame(rows, columns=["id", "least"])

    e = _checked(_cyclic_core(edges))
    return _in_one_task(e.select(F.col("src").alias("id")).limit(0), e.withColumn("w", F.lit(1.0)), "id string, least string", work)


def cycle_rows(edges: DataFrame) -> DataFrame:
    """(least, length, path): for each strongly connected set of modules a shortest cycle through its least member."""

    def work(_: list, e: pd.DataFrame) -> pd.DataFrame:
        g = _neighbours(e)
        found = []
        for part in _strong(g):
            if len(part) > 1:
                start, inside = min(part), set(part)
                back = {start: ""}
                queue, end = deque([start]), None
                while queue and end is None:
                    v = queue.popleft()
                    for w in sorted(g[v]):
                        if w == start:
                            end = v
                            break
                        if w in inside and w not in back:
                            back[w] = v
                            queue.append(w)
                path = []
                while end:
                    path.append(end)
                    end = back[end]
                found.append((start, len(path), path[::-1]))
        return pd.DataFrame(found, columns=["least", "length", "path"])

    e = _checked(_cyclic_core(edges))
    return _in_one_task(e.select(F.col("src").alias("id")).limit(0), e.withColumn("w", F.lit(1.0)), "least string, length int, path array<string>", work)


def cycles(edges: DataFrame) -> list[list[str]]:
    """The paths of ``cycle_rows`` in order, for documents that are read whole."""
    return sorted(r["path"] for r in cycle_rows(edges).collect())


def _strong(g: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected sets by two searches, without recursion."""
    order, seen = [], set()
    for s in sorted(g):
        stack = [(s, iter(sorted(g[s])))] if s not in seen else []
        seen.add(s)
        while stack:
            v, it = stack[-1]
            w = next((x for x in it if x not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(sorted(g.get(w, [])))))
    back: dict[str, list[str]] = defaultdict(list)
    for a, bs in g.items():
        for b in bs:
            back[b].append(a)
    out, done = [], set()
    for s in reversed(order):
        if s not in done:
            part, todo = [], [s]
            done.add(s)
            while todo:
                v = todo.pop()
                part.append(v)
                for w in back[v]:
                    if w not in done:
                        done.add(w)
                        todo.append(w)
            out.append(part)
    return out


def topological(nodes: list[str], needs: dict[str, set[str]]) -> list[str]:
    """Layers of nodes whose needs are met, each in order of names; what lies on cycles comes last."""
    left, out = set(nodes), []
    while ready := sorted(v for v in left if not needs.get(v, set()) & left - {v}):
        out += ready
        left -= set(ready)
    return out + sorted(left)
