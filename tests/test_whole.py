"""Queries that do the whole of their job: no bound on names, every query vector, every module."""

import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import embed, extract, search
from lodestone.operators import graph as G
from lodestone.plans import building
from lodestone.plans.reference import nodes, symbols, vectors
from lodestone.sinks import artifacts
from lodestone.sources import walk

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.1"


def run(spark, name, d=SF):
    return entry.queries()[name](spark, d)


def test_the_symbol_index_keeps_hot_names(spark, tmp_path):
    rows = [(f"f{i:02}.ts", 0, "run", "function", 1, 2, None, "run()", True, "typescript") for i in range(30)]
    rows += [("f00.ts", 1, "run", "method", 5, 6, "Crane", "run()", False, "typescript"), ("f00.ts", 2, " ", "method", 7, 8, None, "", False, "typescript"), rows[0]]
    spark.createDataFrame(rows, "file string, pos int, name string, kind string, line int, end_line int, parent string, signature string, exported boolean, lang string").write.parquet(f"{tmp_path}/symbols.parquet")
    got = [(r["name"], r["file"], r["line"], r["kind"], r["parent"]) for r in run(spark, "sk2_symbol_index", str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([("run", f"f{i:02}.ts", 1, "function", None) for i in range(30)] + [("run", "f00.ts", 5, "method", "Crane")], key=str)


def test_vectors_and_words_over_the_tables(spark, tmp_path):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    packed = {(r["vec_id"], r["vec"]) for r in run(spark, "sk6_packed_vectors").collect()}
    assert len(packed) == n > 3 and packed == {(r["vec_id"], r["q"]) for r in run(spark, "a15_int8").collect()}
    s = symbols(spark, SF).where("name is not null")
    assert {r["file"] for r in run(spark, "sk7_scip_documents").collect()} == {r["file"] for r in s.select("file").distinct().collect()}
    names = {r["name"] for r in s.select("name").distinct().collect()}
    encoded = {r["text"]: r["vec"] for r in run(spark, "q5_encode_tables").collect()}
    assert names <= set(encoded) and all(encoded[x] == ",".join(map(str, embed.letter_model().encode(re.sub("([a-z0-9])([A-Z])", r"\1 \2", x)))) for x in sorted(names)[:50])
    listed = {r["rel"] for r in building.files(spark, SF).collect()}
    found = run(spark, "q8_semantic").collect()
    assert len(found) == 20 and {r["file"] for r in found} <= listed and {r["tier"] for r in found} == {"static"}
    assert {r["file"] for r in run(spark, "q16_degraded").collect()} <= listed


def test_small_packing_across_blocks(spark):
    v = spark.createDataFrame([(i, [i - 5, -i]) for i in range(10)], "vec_id bigint, q array<int>")
    blocks = artifacts.packed_blocks(v, "vec_id", "q", "m", per_block=4)
    assert blocks.count() == 3
    assert {(r[0], *r[1]) for r in artifacts.unpacked_blocks(blocks, "vec_id").collect()} == {(i, i - 5, -i) for i in range(10)}


def test_constant_cases_of_vectors(spark):
    tiny = building._MODEL
    t = building.tree(spark)
    lexical = search.bm25(building.texts(spark), "rel", F.col("content"), "crane driver", limit=50)
    index = embed.build_index(embed.units(t.select("rel", "title", "summary"), extract.child(t, "symbols")), tiny)
    assert {r["file"] for r in embed.semantic(index, tiny.encode("crane driver"), lexical).take(2)} == {"docs/crane.md", "web/src/crane.ts"}
    assert {(r["tier"], r["degraded_reason"]) for r in embed.semantic(None, None, lexical, reason="no model").collect()} == {("lexical", "no model")}
    head, vecs = artifacts.unpack_vectors(artifacts.pack_vectors([({"file": x}, tiny.encode(x)) for x in ("crane", "cargo", "log")], "tiny", 4))
    assert head["count"] == 3 and vecs == [tiny.encode(x) for x in ("crane", "cargo", "log")]
    occ = artifacts.occurrences(extract.child(t, "symbols"), extract.child(t, "calls").select("file", "name", "line"), building.texts(spark))
    docs = {r["file"]: bytes(r["document"]) for r in artifacts.scip_documents(occ, t.select("rel", "lang")).collect()}
    assert "web/src/crane.ts" in docs and b"emptyCargo" in docs["web/src/crane.test.ts"] and b"typescript" in docs["web/src/crane.ts"]


def test_every_query_vector_is_searched(spark):
    v = {r["vec_id"]: (r["label"], np.array(r["q"], dtype=np.int64)) for r in vectors(spark, SF01).collect()}
    asked = [i for i in v if i % 100 == 0]
    near, best = set(), set()
    for q in asked:
        dots = sorted((-int(x @ v[q][1]), i) for i, (_, x) in v.items())
        near |= {(q, i, -s) for s, i in dots[:20]}
        seen = {}
        for s, i in dots:
            seen.setdefault(v[i][0], (q, v[i][0], i, -s))
        best |= set(seen.values())
    assert len(asked) > 1
    assert {tuple(r) for r in run(spark, "q8_knn", SF01).select("query_id", "vec_id", "dot").collect()} == near
    assert {tuple(r) for r in run(spark, "a17_best_per_group", SF01).select("query_id", "label", "vec_id", "dot").collect()} == best


def test_query_blocks_are_joined(spark):
    v = spark.createDataFrame([(i, i % 2, [i, -1]) for i in range(7)], "vec_id bigint, label int, q array<int>")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(search.nearest_of_set(v, v, "vec_id", "q", most=3, block=2)) == rows(search.nearest_of_set(v, v, "vec_id", "q", most=3))
    assert rows(search.best_of_set(v, v, "label", "vec_id", "q", block=2)) == rows(search.best_of_set(v, v, "label", "vec_id", "q"))


def test_every_module_gets_a_community_and_a_betweenness(spark):
    modules = {r["module"] for r in nodes(spark, SF).where("module is not null").select("module").distinct().collect()}
    assert {r["id"] for r in run(spark, "g5_communities").collect()} == modules
    assert {r["id"] for r in run(spark, "g3_betweenness").collect()} == modules


def test_betweenness_against_all_shortest_paths(spark):
    rng = random.Random(3)
    ids = [f"n{i:02}" for i in range(14)]
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(20)})
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in ids}

    def shortest(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in p]
        return found

    want = dict.fromkeys(ids, 0.0)
    for s, t in itertools.combinations(ids, 2):
        found = shortest(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found) / (13 * 12 / 2)
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([*pairs, ("n00", "gone")], "src string, dst string")
    got = {r["id"]: r["betweenness"] for r in G.betweenness(n, e, most=None).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in ids) and max(want.values()) > 0
    assert {r["betweenness"] for r in G.betweenness(n, e, most=13).collect()} == {0.0}


def test_betweenness_of_hubs_and_parts(spark):
    """Levels are crossed from either side: hubs, long arms, parts without a link between them, nodes without any."""
    rng = random.Random(5)
    ids = [f"n{i:03}" for i in range(260)]
    pairs = {tuple(sorted((ids[h], ids[i]))) for h in (0, 1, 2) for i in range(3, 150) if rng.random() < 0.6}
    pairs |= {tuple(sorted(rng.sample(ids[3:150], 2))) for _ in range(200)}
    pairs |= {(ids[i], ids[i + 1]) for i in range(149, 190)} | {tuple(sorted(rng.sample(ids[200:250], 2))) for _ in range(120)}
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        far, count, before, queue = {s: 0}, {s: 1}, {s: []}, [s]
        for v in queue:
            for w in sorted(near[v]):
                if w not in far:
                    far[w], count[w], before[w] = far[v] + 1, 0, []
                    queue.append(w)
                if far[w] == far[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        share = dict.fromkeys(queue, 0.0)
        for w in reversed(queue):
            for v in before[w]:
                share[v] += count[v] / count[w] * (1 + share[w])
            want[w] += share[w] * (w != s) / 2
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = {r["id"]: r["betweenness"] for r in G.betweenness(n, e, most=None).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i] / (259 * 258 / 2)) < 6e-7 for i in ids)


def test_betweenness_costs_what_lies_in_reach(spark):
    """A hub with 20,000 leaves beside 25,000 rings of four: a sweep costs its own part, not the whole graph."""
    leaf = spark.range(20_000).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), "id").alias("dst"))
    corner = lambda k: F.concat(F.lit("ring"), "id", F.lit("-"), F.lit(k % 4))
    e = leaf.union(spark.range(25_000).select(F.explode(F.array(*[F.struct(corner(k).alias("src"), corner(k + 1).alias("dst")) for k in range(4)])).alias("x")).select("x.*"))
    began = time.monotonic()
    got = {r["id"]: r["betweenness"] for r in G.betweenness(e.select(F.col("src").alias("id")).union(e.select("dst")), e, most=None).collect()}
    took = time.monotonic() - began
    assert len(got) == 120_001 and {i for i, x in got.items() if x} == {"hub"}
    assert abs(got["hub"] - 20_000 * 19_999 / (120_000 * 119_999)) < 6e-7
    assert took < 60


def test_the_repository_source_lists_every_file(tmp_path):
    for i in range(20_005):
        (tmp_path / f"f{i}.ts").touch()
    listed = lambda **o: sum(len(p.files) for p in walk._Reader({"root": str(tmp_path), **o}).partitions())
    assert listed() == 20_005 and listed(maxfiles="7") == 7
