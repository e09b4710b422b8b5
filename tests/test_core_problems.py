"""Changed records, hot keys and hierarchies on small tables, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import hierarchy as H
from lodestone.operators import incremental as I
from lodestone.operators import skew


def changed(spark, now, was, partitions=16):
    a = spark.createDataFrame(now, "k string, c string, note string")
    b = spark.createDataFrame(was, "k string, c string, note string")
    return sorted(r[0] for r in I.changed_records(a, b, "k", "c", partitions).collect())


def test_changed_records_nulls_and_new(spark):
    now = [("a", "1", "x"), ("b", "2", None), ("c", None, None), ("d", "4", None), (None, "5", None), ("é", "6", None)]
    was = [("a", "1", "other"), ("b", "3", None), ("c", None, None), ("gone", "9", None), ("é", None, None)]
    assert changed(spark, now, was) == ["b", "c", "d", "é"]


def test_changed_records_empty(spark):
    assert changed(spark, [], []) == []
    assert changed(spark, [], [("a", "1", "")]) == []
    assert changed(spark, [("a", "1", "")], []) == ["a"]
    assert changed(spark, [("a", "1", "")], [("a", "1", "")]) == []


def test_only_changed_partitions_are_compared(spark):
    rows = [(f"k{i}", str(i), "") for i in range(200)]
    a = spark.createDataFrame(rows, "k string, c string, note string").withColumn("p", I.by_hash("k", 16))
    b = spark.createDataFrame([r if r[0] != "k7" else ("k7", "other", "") for r in rows], "k string, c string, note string").withColumn("p", I.by_hash("k", 16))
    got = I.changed_partitions(I.fingerprints(a, "p", ["k", "c"]), I.fingerprints(b, "p", ["k", "c"]), "p")
    assert [r[0] for r in got.collect()] == [a.where("k = 'k7'").first()["p"]]


def test_fingerprint_ignores_order_but_not_copies(spark):
    rows = [("a", "1"), ("b", "2"), ("a", "1")]
    f = lambda r: I.fingerprints(spark.createDataFrame(r, "k string, c string").withColumn("p", F.lit(0)), "p", ["k", "c"]).first()
    assert f(rows) == f(rows[::-1])
    assert f(rows) != f(rows[:2])
    assert f([("a", None)]) != f([("a", "")])
    assert f([("a", "b")]) != f([("b", "a")])


def test_store_survives_a_failed_run(spark, tmp_path):
    store = I.PartitionStore(spark, str(tmp_path / "store"), "k", ["c"], 8)
    one = spark.createDataFrame([(f"k{i}", "1") for i in range(40)], "k string, c string")
    two = spark.createDataFrame([(f"k{i}", "2" if i % 10 == 0 else "1") for i in range(30)] + [("new", "1")], "k string, c string")
    done = []
    work = lambda df: done.append(df.count()) or df.withColumn("size", F.length("k"))
    assert store.refresh(one, work)["partitions"] == 8
    want = sorted((r["k"], r["c"]) for r in two.collect())

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.refresh(two, work, before_commit=fail)
    assert store.runs() == [1]
    assert store.refresh(two, work)["run"] == 2
    assert sorted((r["k"], r["c"]) for r in store.rows().collect()) == want
    before = len(done)
    assert store.refresh(two, work) == {"run": 2, "partitions": 0}
    assert len(done) == before
    three = two.withColumn("c", F.when(F.col("k") == "k1", "7").otherwise(F.col("c")))
    assert store.refresh(three, work)["partitions"] == 1
    assert store.refresh(spark.createDataFrame([], "k string, c string"), work)["run"] == 4
    assert store.rows().count() == 0


def test_heavy_keys_count_distinct_rows(spark):
    rows = [("hot", i, "x") for i in range(50)] + [("hot", 0, "x")] * 500 + [(None, i, "x") for i in range(40)] + [(f"k{i}", i, None) for i in range(10)] + [("k1", 1, None)] * 300
    df = spark.createDataFrame(rows, "name string, n int, w string")
    got = {r["key_value"]: r["n_distinct"] for r in skew.heavy_keys(df, F.col("name"), 0.02).collect()}
    assert got == {"hot": 50}
    assert skew.heavy_keys(df.limit(0), F.col("name")).count() == 0


def test_modes_and_percentiles_from_weights(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice([1.0, 2.5, 2.5, 9.0, 1e6])) for _ in range(3000)] + [("one", 3.0)] + [("none", None)] * 3 + [("neg", float(-i)) for i in range(7)]
    freq = skew.weighted(spark.createDataFrame(rows, "k string, v double"), F.col("k"), [F.col("v")])
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    want = {k: [sorted(v)[max(1, -(-len(v) * q // 100)) - 1] for q in (10, 50, 90)] for k, v in by.items()}
    got = {r["key"]: [r["a"], r["b"], r["c"]] for r in skew.percentiles(freq, {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    assert got == want
    m = {r["key"]: (r["mode"], r["n"]) for r in skew.modes(freq).collect()}
    assert m["hot"][0] == min(v for v, n in Counter(by["hot"]).items() if n == max(Counter(by["hot"]).values()))
    assert m["none"] == (None, 3)


def brute_tree(rows):
    rows = {(f, p, (n or "").strip(" \t") or None, (u or "").strip(" \t") or None) for f, p, n, u in rows}
    by = defaultdict(list)
    for f, p, n, _ in rows:
        if n:
            by[f, n].append(p)
    up = {}
    for f, p, _, u in rows:
        if u and (ps := by.get((f, u))):
            low = [x for x in ps if x < p]
            up[f, p] = max(low) if low else min(ps)
    out = set()
    for f, p in up:
        seen, at, depth = {p}, p, 0
        while (f, at) in up:
            at, depth = up[f, at], depth + 1
            if at in seen:
                depth = -1
                break
            seen.add(at)
        if depth == -1:
            out.add((f, p, -1, -1))
        elif depth >= 2:
            out.add((f, p, at, depth))
    return out, up


@pytest.mark.parametrize("seed", [1])
def test_hierarchy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for f in range(10):
        names = [f"n{rng.randrange(14)}" for _ in range(30)]
        for p, n in enumerate(names):
            rows.append((f"f{f}", p, rng.choice([n, n, n, f" {n}\t", None, ""]), rng.choice([*names, *names, None, "missing", f"{names[0]} "])))
    rows += [("chain", i, f"c{i}", f"c{i - 1}" if i else None) for i in range(24)] + rows[:15]
    rows += [("cycle", i, f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("cycle", 20, "tail", "r3"), ("cycle", 21, "t2", "tail"), ("self", 1, "s", "s"), ("self", 2, "x", "s")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, pos int, name string, parent string").withColumn("up", F.lit("clash"))
    want, up = brute_tree(rows)
    assert {tuple(r) for r in H.deep_or_cyclic(df).collect()} == want
    full = {(r["file"], r["pos"]): r for r in H.hierarchy(df).collect()}
    assert {k: r["up"] for k, r in full.items()} == up
    assert {(r["file"], r["pos"], r["root_pos"], r["depth"]) for r in full.values() if r["depth"] == -1 or r["depth"] >= 2} == want


def test_hierarchy_of_nothing(spark):
    df = spark.createDataFrame([], "file string, pos int, name string, parent string")
    assert H.deep_or_cyclic(df).count() == 0
    df = spark.createDataFrame([(None, 1, "a", "a"), ("f", None, "a", "a"), ("f", 2, None, None)], "file string, pos int, name string, parent string")
    assert H.deep_or_cyclic(df).count() == 0


def test_paths_and_descendants(spark):
    rows = [("f", 0, "A", None), ("f", 1, "B", "A"), ("f", 2, "C", "B"), ("f", 3, "D", "A"), ("g", 0, "x", "y"), ("g", 1, "y", "x")]
    df = spark.createDataFrame(rows, "file string, pos int, name string, parent string")
    got = {(r["file"], r["pos"]): (r["path"], r["depth"], r["n_descendants"]) for r in H.paths(df).collect()}
    assert got == {("f", 0): ("A", 0, 3), ("f", 1): ("A/B", 1, 1), ("f", 2): ("A/B/C", 2, 0), ("f", 3): ("A/D", 1, 0), ("g", 0): (None, -1, 0), ("g", 1): (None, -1, 0)}
    below = {(r["file"], r["pos"], r["descendant"], r["distance"]) for r in H.descendants(df).collect()}
    assert below == {("f", 0, 1, 1), ("f", 0, 2, 2), ("f", 0, 3, 1), ("f", 1, 2, 1)}


def test_large_files_are_contracted_in_rounds(spark):
    rows = [("big", i, f"c{i}", f"c{i - 1}" if i % 7 else f"c{i // 2}") for i in range(60)] + [("big", 100 + i, f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("small", i, f"s{i}", f"s{i - 1}") for i in range(8)]
    df = spark.createDataFrame(rows, "file string, pos int, name string, parent string")
    key = lambda d: sorted((r["file"], r["pos"], r["up"], r["root_pos"], r["depth"], r["path"] and tuple(r["path"])) for r in d.collect())
    assert key(H.placed(df, True, file_rows=20)) == key(H.placed(df, True))
    assert {tuple(r) for r in H.deep_or_cyclic(df).collect()} == brute_tree(rows)[0]


def test_a_file_that_spans_batches_is_contracted_whole(spark, monkeypatch):
    rows = [(f"f{f:02}", i, f"c{i}", f"c{i - 1}" if i else None) for f in range(40) for i in range(f)]
    df = spark.createDataFrame(rows, "file string, pos int, name string, parent string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {tuple(r) for r in H.deep_or_cyclic(df).collect()} == brute_tree(rows)[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_failed_run_leaves_nothing_behind(spark, tmp_path):
    store = I.PartitionStore(spark, str(tmp_path / "store"), "k", ["c"], folder=I.folder_of)
    make = lambda tag, n=40: spark.createDataFrame([(f"d{i % 5}/k{i}", tag if i % 9 == 0 else "same") for i in range(n)], "k string, c string")
    keep = lambda df: df
    store.refresh(make("a"), keep)

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.refresh(make("b"), keep, before_commit=fail)
    assert store.refresh(make("a"), keep) == {"run": 1, "partitions": 0}
    assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, make("a").collect()))
    with pytest.raises(RuntimeError):
        store.refresh(make("c", 50), keep, before_commit=fail)
    seen = []
    store.refresh(make("b"), lambda df: seen.append(df.count()) or df)
    assert seen == [5] and sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, make("b").collect()))
    for tag in "def":
        store.refresh(make(tag), keep)
    assert len(store.runs()) == 2 and sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, make("f").collect()))


def test_only_folders_with_changes_are_replaced(spark, tmp_path):
    store = I.PartitionStore(spark, str(tmp_path / "store"), "k", ["c"], folder=I.folder_of)
    rows = [(f"p{d}/src/f{i}", "1") for d in range(300) for i in range(20)] + [(f"hot/f{i}", "1") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, c string")
    all_of_it = store.refresh(df, lambda d: d)["partitions"]
    near = F.col("k").rlike("^p(7|8)/") | (F.col("k") == "hot/f5")  # 41 of 9,000 records
    run = store.refresh(df.withColumn("c", F.when(near, "2").otherwise("1")), lambda d: d)
    assert run.pending.count() == 41 and run["partitions"] <= 3 < all_of_it / 40
    hot = store.rows().where("k like 'hot/%'").count()
    assert hot == 3000 and store.rows().where("c = '2'").count() == 41


def test_null_contents_are_processed_again_and_empty_inputs_are_no_records(spark, tmp_path):
    store = I.PartitionStore(spark, str(tmp_path / "store"), "k", ["c"], folder=I.folder_of)
    assert store.rows().count() == 0
    store.refresh(spark.createDataFrame([], "k string, c string"), lambda d: d)
    df = spark.createDataFrame([("a/1", None, 1), ("a/2", "x", 2), (None, "y", 3), ("a/2", "x", 2)], "k string, c string, _part int").drop("_part")
    store.refresh(df, lambda d: d.withColumn("extra", F.lit(1)))
    assert [r["k"] for r in store.refresh(df, lambda d: d.withColumn("extra", F.lit(2))).pending.collect()] == ["a/1"]
    assert sorted((r["k"], r["extra"]) for r in store.rows().collect()) == [("a/1", 2), ("a/2", 1)]


def test_late_rows_of_a_stream_change_nothing(spark, tmp_path):
    from lodestone.streaming import refresh

    store = I.PartitionStore(spark, str(tmp_path / "store"), "rel", ["hash"], folder=I.folder_of)
    batch = lambda rows, n: spark.createDataFrame(rows, "rel string, hash string, at int").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    schema = spark.createDataFrame([], "rel string, hash string, at int").schema
    take = lambda: refresh.follow(spark, f"{tmp_path}/in/*", schema, store, f"{tmp_path}/progress", "at")
    for n, rows in enumerate([[("a", "h1", 1), ("b/x", "u", 1)], [("a", "h1", 10)], [("a", "h2", 5), ("c", "v", 2)]]):
        batch(rows, n)
        take()
    assert sorted(map(tuple, store.rows().select("rel", "hash", "at").collect())) == [("a", "h1", 10), ("b/x", "u", 1), ("c", "v", 2)]


def test_percentiles_of_a_hot_key_and_of_text(spark):
    rows = [("hot", i) for i in range(1, 1001)] + [("k", 5)] + [(None, 3)]
    freq = skew.weighted(spark.createDataFrame(rows, "k string, v int"), F.col("k"), [F.col("v")])
    assert {r["key"]: (r["a"], r["b"]) for r in skew.percentiles(freq, {"a": 0.5, "b": 0.07}).collect()} == {"hot": (500, 70), "k": (5, 5)}
    words = skew.weighted(spark.createDataFrame([("k", w) for w in "abcde"], "k string, v string"), F.col("k"), [F.col("v")])
    assert skew.percentiles(words, {"m": 0.5}).first()["m"] == "c"


def test_the_store_gets_over_the_loss_of_its_small_files(spark, tmp_path):
    store = I.PartitionStore(spark, str(tmp_path / "store"), "k", ["c"], folder=I.folder_of)
    df = spark.createDataFrame([(f"d{i % 7}/k{i}", "1") for i in range(60)], "k string, c string")
    store.refresh(df, lambda d: d.withColumn("size", F.length("k")))
    for name in ("schema.json", "layout.json"):
        (tmp_path / "store" / name).unlink()
    assert store.rows().agg(F.count(F.lit(1)), F.min("size")).first()[:] == (60, 5)
    run = store.refresh(df.withColumn("c", F.when(F.col("k") == "d3/k3", "2").otherwise(F.col("c"))), lambda d: d.withColumn("size", F.length("k")))
    assert [r["k"] for r in run.pending.collect()] == ["d3/k3"] and sorted(r["c"] for r in store.rows().collect()) == ["1"] * 59 + ["2"]
