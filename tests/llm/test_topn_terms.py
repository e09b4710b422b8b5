"""Top items and term counts against brute force, with nulls, ties, repeats, hot groups and clashing names."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import terms as T
from lodestone.llm import topn


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot", f"i{i:05}", rng.choice([1.0, 2.0, 3.0, float(rng.randrange(500))]), rng.choice([None, 1, 2])) for i in range(3000)]
    rows += [(f"g{i % 400}", f"j{i:05}", float(rng.randrange(5)), rng.choice([None, 3])) for i in range(1500)]
    rows += [(None, "x", 9.0, 1), ("hot", "nan", float("nan"), 1), ("hot", "null", None, 1), ("only", "one", 0.0, None)]
    df = spark.createDataFrame(rows, "g string, item string, score double, d int").withColumn("rank_", F.lit("clash")).withColumns({c: F.lit("clash") for c in ("block", "hi", "lo", "n", "nth", "have", "r")})
    got = defaultdict(list)
    for r in topn.top_n(df, "g", "score", [F.col("d").desc_nulls_last(), F.col("item").asc()], 5, block_rows=300).collect():
        got[r["g"]].append((r["rank_no"], r["item"]))
    by = defaultdict(list)
    for g, i, s, d in rows:
        if g is not None and s is not None and s == s:
            by[g].append((-s, d is None, -(d or 0), i))
    assert {g: sorted(v) for g, v in got.items()} == {g: [(n + 1, x[3]) for n, x in enumerate(sorted(v)[:5])] for g, v in by.items()}


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, item string, score double")
    assert topn.top_n(df, "g", "score", [F.col("item").asc()], 3).count() == 0
    df = spark.createDataFrame([(None, "a", 1.0), ("g", "b", None)], "g string, item string, score double")
    assert topn.top_n(df, "g", "score", [F.col("item").asc()], 3).count() == 0


def test_top_n_with_all_scores_equal(spark):
    df = spark.createDataFrame([("g", f"i{i:03}", 1.0) for i in range(500)], "g string, item string, score double")
    got = topn.top_n(df, "g", "score", [F.col("item").asc()], 3, block_rows=50)
    assert sorted((r["rank_no"], r["item"]) for r in got.collect()) == [(1, "i000"), (2, "i001"), (3, "i002")]


def tables(spark, rng):
    files = [f"f{i}" for i in range(60)]
    idents = [(rng.choice(files), rng.choice(["hot", "hot", f"t{rng.randrange(80)}", " pad\t", "", None, "x" * 5000])) for _ in range(900)]
    symbols = [(f, p, rng.choice(["hot", "Größe", f"s{rng.randrange(90)}", None])) for f in files for p in range(8)] * 2
    headings = [(rng.choice(files), p, rng.choice(["Usage of X", "USAGE", "--- !", None, "größe 2a_b", "a" * 3000])) for p in range(120)]
    return (
        spark.createDataFrame(idents + idents[:50], "file string, ident string").withColumn("term", F.lit(1)),
        spark.createDataFrame(symbols, "file string, pos int, name string").withColumn("id", F.lit(1)),
        spark.createDataFrame(headings + headings[:9], "rel string, pos int, heading string"),
    ), (idents, symbols, headings)


def test_term_counts_against_brute_force(spark):
    import re

    dfs, (idents, symbols, headings) = tables(spark, random.Random(5))
    rows = set()
    for f, t in idents:
        rows.add((0, (t or "").strip(" \t"), f, None))
    for f, p, t in symbols:
        rows.add((1, (t or "").strip(" \t"), f, p))
    for f, p, h in headings:
        for i, w in enumerate(re.findall(r"[^\W_]+", (h or "").lower())):
            rows.add((2, w, f, (p, i)))
    rows = {r for r in rows if r[1]}
    occ, rec, holders = defaultdict(int), defaultdict(set), defaultdict(set)
    for k, t, f, _ in rows:
        occ[k, t] += 1
        rec[k, t].add(f)
        holders[k].add(f)
    mark = lambda k, t: "rare" if len(rec[k, t]) == 1 else "common" if len(rec[k, t]) > 0.05 * len(holders[k]) else None
    want = {(k, t): (n, len(rec[k, t]), mark(k, t)) for (k, t), n in occ.items()}
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in T.marked(T.index_rows(*dfs)).collect()}
    assert got == want


def test_terms_of_nothing(spark):
    rows = T.index_rows(spark.createDataFrame([], "file string, ident string"), spark.createDataFrame([(None, 1, "a")], "file string, pos int, name string"), spark.createDataFrame([("r", 1, None)], "rel string, pos int, heading string"))
    assert T.marked(rows).count() == 0


def test_long_headings_and_great_places(spark):
    long = " ".join(["usage"] * 1030)
    headings = [("r", 0, long), ("r", 1, " ".join(["usage"] * 10)), ("r", 1, "usage"), ("r", 2_097_152, "usage"), ("r", None, "usage"), ("r", 0, f" {long}\t")]
    none = spark.createDataFrame([], "file string, ident string"), spark.createDataFrame([], "file string, pos int, name string")
    got = T.marked(T.index_rows(*none, spark.createDataFrame(headings, "rel string, pos int, heading string"))).collect()
    assert [(r["term"], r["occurrences"], r["records"]) for r in got] == [("usage", 1043, 1)]


def test_blocks_go_on_over_batches(spark):
    rng = random.Random(7)
    idents = [(f"f{rng.randrange(20)}", rng.choice(["hot", "hot", "a", "b", "c"])) for _ in range(700)]
    rows = T.index_rows(spark.createDataFrame(idents, "file string, ident string"), spark.createDataFrame([], "file string, pos int, name string"), spark.createDataFrame([], "rel string, pos int, heading string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in T.marked(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(set)
    for f, t in idents:
        want[t].add(f)
    assert got == {t: (len(fs), len(fs)) for t, fs in want.items()}


def test_blocks_below_the_nth_score_are_skipped(spark):
    rows = [("hot", f"i{i:05}", float(i)) for i in range(4000)] + [(f"g{i % 30}", f"j{i}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, item string, score double")
    c = topn.Clustered(df, "g", "score", block_rows=200)
    got = {(r["g"], r["rank_no"]): r["item"] for r in c.top(3, [F.col("item").asc()]).collect()}
    assert {k: v for k, v in got.items() if k[0] == "hot"} == {("hot", 1): "i03999", ("hot", 2): "i03998", ("hot", 3): "i03997"} and len(got) == 63
    first, every = c.read
    assert c.blocks == 21 and len(every) <= 5 and set(first) <= set(every)
    assert c.top(1000, [F.col("item").asc()]).where("g = 'hot'").count() == 1000 and 5 < len(c.read[1]) < c.blocks
    assert topn.block_rows_for(10**6) == 4000 and topn.block_rows_for(10) == topn.LEAST_ROWS
