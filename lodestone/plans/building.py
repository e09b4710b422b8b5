"""Queries over a small tree that is built in full: extraction, resolution, callers, workspaces, diffs; artifacts and vectors over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P
from ..operators import embed, extract, relations, resolve, search, workspaces
from ..operators.incremental import PartitionStore, folder_of
from ..session import shared_dir, table, written
from ..sinks import artifacts
from ..sources import git
from ..streaming import refresh
from .fixture import DIFF, FILES
from .reference import IDS, LIFT_SQL, SYMS, VECTORS_SQL, bm25_sql, edges, files, idents, module_edges, nodes, symbols, vectors
from .reference import FILES as FILES_SQL
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
FOLDERS = {"/".join(p.split("/")[:i]) for p in FILES for i in range(1, p.count("/") + 1)}


def texts(spark: SparkSession) -> DataFrame:
    t = spark.createDataFrame(sorted(FILES.items()), "rel string, content string")
    return t.withColumn("ext", P.extension(F.col("rel")))


def tree(spark: SparkSession) -> DataFrame:
    return written(extract.extracted(texts(spark)), "extracted")


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "null" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + str(x).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


@query("ex6_symbols", _values([
    ("c/anchor.c", "drop", "function", 3, 5, None, True), ("c/include/anchor.h", "Anchor", "struct", 1, 1, None, True),
    ("dock/dock.go", "Open", "function", 8, 8, None, True), ("dock/dock.go", "shut", "function", 10, 10, None, False),
    ("dock/gate/gate.go", "Lock", "struct", 3, 3, None, True), ("dock/gate/gate.go", "Turn", "method", 5, 5, None, True), ("dock/gate/gate.go", "Key", "function", 7, 7, None, True),
    ("jv/src/main/java/org/quay/Berth.java", "Berth", "class", 5, 7, None, True), ("jv/src/main/java/org/quay/Berth.java", "depth", "method", 6, 6, "Berth", True),
    ("jv/src/main/java/org/quay/tide/Moon.java", "Moon", "class", 3, 5, None, True), ("jv/src/main/java/org/quay/tide/Moon.java", "pull", "method", 4, 4, "Moon", True),
    ("packages/log/src/index.ts", "log", "function", 1, 3, None, True), ("packages/ship/src/main.ts", "sail", "function", 2, 4, None, True),
    ("py/yard/crates.py", "Crate", "class", 1, 2, None, True), ("py/yard/crates.py", "measure_crate", "function", 5, 6, None, True),
    ("py/yard/stack.py", "Stack", "class", 7, 12, None, True), ("py/yard/stack.py", "push", "method", 8, 9, "Stack", True), ("py/yard/stack.py", "_hidden", "method", 11, 12, "Stack", False), ("py/yard/stack.py", "tower", "function", 15, 16, None, True),
    ("rs/src/lib.rs", "pull", "function", 4, 4, None, True), ("rs/src/rope.rs", "Knot", "struct", 1, 1, None, True), ("rs/src/rope.rs", "tie", "function", 3, 3, None, True),
    ("web/src/cargo.ts", "Cargo", "interface", 1, 4, None, True), ("web/src/cargo.ts", "emptyCargo", "function", 6, 6, None, True),
    ("web/src/crane.ts", "CraneDriver", "class", 5, 13, None, True), ("web/src/crane.ts", "weigh", "function", 15, 17, None, True),
    ("web/src/index.ts", "CraneDriver", "reexport", 1, 0, None, True), ("web/src/index.ts", "weigh", "reexport", 1, 0, None, True), ("web/src/index.ts", "@app/cargo", "reexport-all", 2, 0, None, True),
], "file, name, kind, line, end_line, parent, exported"))
def ex6_symbols(spark, d):
    return extract.child(tree(spark), "symbols").select("file", "name", "kind", "line", F.coalesce("end_line", F.lit(0)).alias("end_line"), "parent", "exported")


@query("ex21_markdown", _values([("README.md", "Harbour", "Tools that move cargo.", "Harbour,Parts"), ("docs/crane.md", "Crane guide", "How CraneDriver lifts. Back to [start](../README.md).", "Crane")], "rel, title, summary, headings"))
def ex21_markdown(spark, d):
    return tree(spark).where("lang = 'markdown'").select("rel", "title", "summary", F.array_join("headings", ",").alias("headings"))


@query("ex20_summaries", _values([("web/src/crane.ts", "Lifts cargo with care."), ("py/yard/stack.py", "Stacks of containers.")], "rel, summary"))
def ex20_summaries(spark, d):
    return tree(spark).where("lang <> 'markdown' and summary is not null").select("rel", "summary")


@query("ex15_calls", _values([
    ("packages/log/src/index.ts", "info", 2, "console"), ("packages/ship/src/main.ts", "log", 3, None), ("web/src/crane.test.ts", "emptyCargo", 4, None), ("web/src/crane.test.ts", "weigh", 4, None), ("web/src/crane.ts", "log", 10, None), ("web/src/crane.ts", "weigh", 8, None),
    ("py/yard/stack.py", "measure_crate", 9, None), ("py/yard/stack.py", "Stack", 16, None), ("py/yard/stack.py", "range", 16, None), ("dock/dock.go", "Println", 8, "fmt"), ("dock/dock.go", "Key", 8, "gate"),
    ("rs/src/lib.rs", "tie", 4, None), ("jv/src/main/java/org/quay/Berth.java", "Moon", 6, None), ("jv/src/main/java/org/quay/Berth.java", "pull", 6, None),
], "file, name, line, receiver"))
def ex15_calls(spark, d):
    return extract.child(tree(spark), "calls").select("file", "name", "line", "receiver")


def resolved(spark: SparkSession) -> DataFrame:
    t = tree(spark)
    refs = extract.child(t, "refs").join(t.select(F.col("rel").alias("file"), "lang"), "file")
    manifests = {p: x for p, x in FILES.items() if p.endswith((".json", ".toml", ".mod", ".xml"))}
    names = t.where("pkg is not null").select("pkg", "rel")
    return resolve.resolve(refs, texts(spark).select("rel"), resolve.context(manifests, FOLDERS), names)


@query("j2_resolutions", _values([
    ("README.md", "docs/crane.md", "resolved", "docs/crane.md", None), ("README.md", "docs/none.md", "dangling", None, "missing-target"), ("docs/crane.md", "../README.md", "resolved", "README.md", None),
    ("web/src/crane.ts", "./cargo.js", "resolved", "web/src/cargo.ts", None), ("web/src/crane.ts", "@harbour/log", "resolved", "packages/log/src/index.ts", None),
    ("web/src/index.ts", "./crane", "resolved", "web/src/crane.ts", None), ("web/src/index.ts", "@app/cargo", "resolved", "web/src/cargo.ts", None), ("web/src/index.ts", "./nowhere", "dangling", None, "missing-module"),
    ("web/src/crane.test.ts", "./crane", "resolved", "web/src/crane.ts", None), ("web/src/crane.test.ts", "@app/cargo", "resolved", "web/src/cargo.ts", None), ("packages/ship/src/main.ts", "@harbour/log", "resolved", "packages/log/src/index.ts", None),
    ("py/yard/stack.py", ".crates", "resolved", "py/yard/crates.py", None), ("py/yard/stack.py", ".", "resolved", "py/yard/__init__.py", None), ("py/yard/stack.py", "os", "external", None, None),
    ("dock/dock.go", "fmt", "external", None, None), ("dock/dock.go", "example.org/harbour/dock/gate", "resolved", "dock/gate/gate.go", None),
    ("rs/src/lib.rs", "rope", "resolved", "rs/src/rope.rs", None), ("rs/src/lib.rs", "crate::rope::Knot", "resolved", "rs/src/rope.rs", None), ("rs/src/lib.rs", "crate::rope::tie", "resolved", "rs/src/rope.rs", None),
    ("jv/src/main/java/org/quay/Berth.java", "org.quay.tide.Moon", "resolved", "jv/src/main/java/org/quay/tide/Moon.java", None), ("c/anchor.c", "anchor.h", "resolved", "c/include/anchor.h", None),
], "file, spec, state, target, reason"))
def j2_resolutions(spark, d):
    return resolved(spark).select("file", "spec", "state", "target", "reason")


@query("j17_import_pairs", _values([
    ("web/src/crane.ts", "web/src/cargo.ts"), ("web/src/crane.ts", "packages/log/src/index.ts"), ("web/src/index.ts", "web/src/crane.ts"), ("web/src/index.ts", "web/src/cargo.ts"), ("web/src/crane.test.ts", "web/src/crane.ts"), ("web/src/crane.test.ts", "web/src/cargo.ts"),
    ("packages/ship/src/main.ts", "packages/log/src/index.ts"), ("py/yard/stack.py", "py/yard/crates.py"), ("py/yard/stack.py", "py/yard/__init__.py"), ("dock/dock.go", "dock/gate/gate.go"), ("rs/src/lib.rs", "rs/src/rope.rs"),
    ("jv/src/main/java/org/quay/Berth.java", "jv/src/main/java/org/quay/tide/Moon.java"), ("c/anchor.c", "c/include/anchor.h"),
], "src, dst"))
def j17_import_pairs(spark, d):
    r = resolved(spark).where("kind = 'import' and state = 'resolved' and target <> file")
    return r.select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()


@query("g16_tree_callers", _values([
    ("log", "packages/log/src/index.ts", "packages/ship/src/main.ts"), ("log", "packages/log/src/index.ts", "web/src/crane.ts"), ("weigh", "web/src/crane.ts", "web/src/crane.test.ts"), ("weigh", "web/src/crane.ts", "web/src/crane.ts"), ("emptyCargo", "web/src/cargo.ts", "web/src/crane.test.ts"), ("measure_crate", "py/yard/crates.py", "py/yard/stack.py"), ("tie", "rs/src/rope.rs", "rs/src/lib.rs"),
    ("Moon", "jv/src/main/java/org/quay/tide/Moon.java", "jv/src/main/java/org/quay/Berth.java"), ("pull", "jv/src/main/java/org/quay/tide/Moon.java", "jv/src/main/java/org/quay/Berth.java"), ("Key", "dock/gate/gate.go", "dock/dock.go"),
    ("Stack", "py/yard/stack.py", "py/yard/stack.py"),
], "name, def_file, file"))
def g16_tree_callers(spark, d):
    """Who calls what in the tree: in the same file, through imports, or by nearness."""
    t = tree(spark)
    langs = t.select(F.col("rel").alias("src"), relations.family(F.col("lang")).alias("family"))
    calls = extract.child(t, "calls").groupBy(F.col("file").alias("src"), "name").agg(F.count(F.lit(1)).alias("n")).join(langs, "src")
    s = extract.child(t, "symbols").join(t.select(F.col("rel").alias("file"), "lang"), "file")
    r = resolved(spark).where("kind = 'import' and state = 'resolved'").select(F.col("file").alias("src"), F.col("target").alias("dst"))
    return relations.bindings(calls, s, r).select("name", F.col("dst").alias("def_file"), F.col("src").alias("file"))


@query("g21_workspaces", _values([("@harbour/log", "packages/log", "npm", 0), ("@harbour/ship", "packages/ship", "npm", 1)], "name, dir, kind, place"))
def g21_workspaces(spark, d):
    packages, _, order, _ = workspaces.workspaces(spark, FILES, FOLDERS)
    places = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, place int")
    return packages.join(places, "name").select("name", "dir", "kind", "place")


@query("j35_workspace_edges", _values([("@harbour/ship", "@harbour/log")], "src, dst"))
def j35_workspace_edges(spark, d):
    return workspaces.workspaces(spark, FILES, FOLDERS)[1]


@query("j36_package_of_file", _values([("packages/log/src/index.ts", "packages/log"), ("packages/log/package.json", "packages/log"), ("packages/ship/src/main.ts", "packages/ship"), ("packages/ship/package.json", "packages/ship")], "rel, scope"))
def j36_package_of_file(spark, d):
    packages = workspaces.workspaces(spark, FILES, FOLDERS)[0]
    return relations.nearest_scope(texts(spark).select("rel"), packages.select(F.col("dir").alias("scope")))


@query("sc17_diff_hunks", _values([("docs/crane.md", 7, 7, False), ("web/src/crane.ts", 1, 5, False), ("web/src/crane.ts", 24, 24, True)], "path, start, stop, approx"))
def sc17_diff_hunks(spark, d):
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(DIFF.split("\n"))], "change int, line_no int, text string")
    return git.hunks(lines).select("path", "start", "stop", "approx")


@query("sc16_diff_files", _values([("a.ts", "M", None, 3, 1, False), ("b.png", "A", None, -1, -1, True), ("d.ts", "R", "c.ts", 0, 0, False)], "path, status, old_path, added, deleted, is_binary"))
def sc16_diff_files(spark, d):
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    return git.diff_files(rows(["M\ta.ts", "A\tb.png", "R100\tc.ts\td.ts"]), rows(["3\t1\ta.ts", "-\t-\tb.png", "0\t0\td.ts"])).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("added", "deleted")})


# artifacts over the tables


@query("sk1_graph_lines", """select src, dst, kind, weight from (select src, dst, kind, sum(weight)::bigint weight from (select distinct src, dst, kind, weight, coalesce(dangling, false) dangling, nullif(trim(reason, E' \\t'), '') reason, nullif(trim(confidence, E' \\t'), '') confidence from edges where src is not null and dst is not null) group by src, dst, kind)""")
def sk1_graph_lines(spark, d):
    """The edges of the graph document, read back from its lines."""
    lines = artifacts.graph_lines(relations.dedupe_edges(edges(spark, d)))
    j = F.from_json("line", "`from` string, `to` string, kind string, weight bigint")
    return lines.select(j.alias("j")).select(F.col("j.from").alias("src"), F.col("j.to").alias("dst"), "j.kind", "j.weight")


_PLAIN = "regexp_matches({0}, '^[A-Za-z0-9_+$-]+$')"
_QUOTED = f"case when {_PLAIN} then {{0}} else '`' || replace({{0}}, '`', '``') || '`' end"


_IDS = f"""with x as (select file, pos, name, line, array_to_string(list_transform(string_split(file, '/'), lambda p: case when {_PLAIN.format('p')} then p else '`' || p || '`' end), '/') || '/' || coalesce({_QUOTED.format('parent')} || '#', '') || {_QUOTED.format('name')}
        || case when kind in ('class', 'interface', 'struct', 'enum', 'type', 'trait') then '#' when kind in ('function', 'method') then '().' when kind in ('module', 'namespace') then '/' else '.' end base from {SYMS} where name is not null),
    n as (select *, row_number() over (partition by file, base, line order by pos) n, count(*) over (partition by file, base) same from x)
"""


@query("sk8_symbol_ids", _IDS + """    select file, pos, name, line, base || case when same = 1 then '' when n = 1 then '(' || line || ')' else '(' || line || '_' || n || ')' end symbol from n""")
def sk8_symbol_ids(spark, d):
    return artifacts.symbol_ids(symbols(spark, d))


@query("sk7_occurrences", _IDS + """
    select distinct file, (line - 1)::int line, 0 "start", length(name)::int stop, base || case when same = 1 then '' when n = 1 then '(' || line || ')' else '(' || line || '_' || n || ')' end symbol, 1 role from n where line is not null""")
def sk7_occurrences(spark, d):
    """The definitions that the documents of all files hold, read back from their bytes."""
    docs = artifacts.scip_documents(artifacts.occurrences(symbols(spark, d, by_file=True)), files(spark, d).select("rel", "lang"))
    return artifacts.scip_occurrences(docs)


@query("sk7_scip_documents")
def sk7_scip_documents(spark, d):
    """Definitions of all files of the table; it tells no lines of names in use, so calls are placed in trees only."""
    return artifacts.scip_documents(artifacts.occurrences(symbols(spark, d, by_file=True)), files(spark, d).select("rel", "lang")).select("file", F.length("document").alias("bytes"))


_MODEL = embed.Model("tiny", ["[UNK]", "crane", "driver", "cargo", "weigh", "log", "stack", "##s", "tow", "##er", "empty"], [[1.0, 0, 0, 0], [0, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 0], [0, 0, 1, 1], [1, 0, 0, 1], [0, 0, 0, 1], [0.5, 0, 0, 0], [0, 0, 0, 2], [0, 1, 0, 1], [1, 0, 1, 0]])


@query("q5_encode", _values([("crane driver", "0,114,57,0"), ("stacks", "57,0,0,114"), ("zzz", "127,0,0,0"), ("", "0,0,0,0")], "text, vec"))
def q5_encode(spark, d):
    """Vectors of a small model: (0,1,0.5,0), (0.25,0,0,0.5), the unknown piece and no piece, at unit length."""
    rows = [(t, ",".join(map(str, _MODEL.encode(t)))) for t in ("crane driver", "stacks", "zzz", "")]
    return spark.createDataFrame(rows, "text string, vec string")


def _encoded(spark, d):
    """(text, vec) of all texts of files and symbols that get a vector, each text once."""
    t = embed.units(files(spark, d), symbols(spark, d)).select(F.lit("").alias("file"), F.col("text").alias("symbol"), F.lit(None).cast("int").alias("line"), "text").distinct()
    return embed.build_index(t, embed.letter_model()).select(F.col("symbol").alias("text"), "vec")


@query("q5_encode_tables")
def q5_encode_tables(spark, d):
    return _encoded(spark, d).select("text", F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("vec"))


def _units(spark, d):
    s = written(symbols(spark, d, by_file=True), "symbols")
    return written(embed.units(files(spark, d), s), "units")


def _lexical(spark, d, units):
    """What the tables tell of a file in words: path, title, first comment, each name defined and used. Once gathered by file, postings need no shuffle."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), " ").alias("content")
    f = files(spark, d).select("rel", F.concat_ws(" ", "rel", "title", "summary").alias("content"))
    s = units.where("symbol is not null").groupBy(F.col("file").alias("rel")).agg(joined("symbol"))
    i = idents(spark, d, by_file=True).groupBy(F.col("file").alias("rel")).agg(joined("ident"))
    words = written(f.unionByName(s).unionByName(i), "words")
    return search.bm25(words, "rel", F.col("content"), "crane driver", limit=50)


@query("q8_semantic")
def q8_semantic(spark, d):
    """The question against the vectors and the words of all files and symbols."""
    model, u = embed.letter_model(), _units(spark, d)
    return embed.semantic(embed.build_index(u, model), model.encode("crane driver"), _lexical(spark, d, u))


_TEXTS = f"(select rel doc_id, rel || ' ' || coalesce(title, '') || ' ' || coalesce(summary, '') text from {FILES_SQL} union all select distinct file, name from {SYMS} where name is not null union all select file, ident from {IDS})"


@query("q16_degraded", f"select doc file, score, 'lexical' tier, 'no model' degraded_reason from ({bm25_sql(['crane', 'driver'], True, _TEXTS)}) order by score desc, file limit 20")
def q16_degraded(spark, d):
    return embed.semantic(None, None, _lexical(spark, d, _units(spark, d)), reason="no model")


@query("sk6_packed_vectors", f"select vec_id, array_to_string(q, ',') vec from {VECTORS_SQL}")
def sk6_packed_vectors(spark, d):
    """All vectors packed into files of some thousand each, and read back from them."""
    blocks = written(artifacts.packed_blocks(vectors(spark, d), "vec_id", "q", "embeddings"), "packed")
    return artifacts.unpacked_blocks(blocks, "vec_id").select("vec_id", F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("vec"))


@query("sk11_diagram", f"""with l as (select *, count(*) over () total, row_number() over (order by weight desc, src_module, dst_module) r from {LIFT_SQL}), t as (select * from l where r <= {K.MERMAID_EDGES}),
    n as (select name, row_number() over (order by name) - 1 i from (select src_module name from t union select dst_module from t)),
    x as (select 0 g, 0 o, 'graph LR' text union all select 1, i, '  n' || i || '["' || replace(name, '"', '#quot;') || '"]' from n
      union all select 2, r, '  n' || a.i || ' -->|' || kind || ' ' || weight || '| n' || b.i from t join n a on a.name = src_module join n b on b.name = dst_module
      union all select distinct 3, 0, '  %% ' || (total - {K.MERMAID_EDGES}) || ' more edges' from l where total > {K.MERMAID_EDGES})
    select (row_number() over (order by g, o) - 1)::int line, text from x""")
def sk11_diagram(spark, d):
    text = artifacts.mermaid(module_edges(spark, d))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


@query("sk4_saved_index", REGISTRY.sql["sk1_graph_lines"])
def sk4_saved_index(spark, d):
    """The edges of an index that was saved and read back."""
    path = f"{shared_dir(spark)}/stores/index-{uuid.uuid4().hex}"
    artifacts.save_index(path, {"edges": relations.dedupe_edges(edges(spark, d))}, "c0")
    return artifacts.load_index(spark, path, "c0")["edges"].select("src", "dst", "kind", "weight")


@query("st1_stream_refresh", r"select trim(rel, E' \t') rel, lower(nullif(trim(hash, E' \t'), '')) hash from (select *, row_number() over (partition by trim(rel, E' \t') order by seen_at desc) n from files where nullif(trim(rel, E' \t'), '') is not null) where n = 1")
def st1_stream_refresh(spark, d):
    """The listing files taken up as a stream: the store holds the current hash of each file."""
    base = f"{shared_dir(spark)}/stores/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "files").select("rel", "hash", "seen_at").where("rel is not null")
    tidy = source.select(F.btrim("rel", F.lit(" \t")).alias("rel"), F.lower(F.nullif(F.btrim("hash", F.lit(" \t")), F.lit(""))).alias("hash"), "seen_at")
    tidy.write.parquet(f"{base}/in")
    store = PartitionStore(spark, f"{base}/store", "rel", ["hash", "seen_at"], folder=folder_of)
    refresh.follow(spark, f"{base}/in", tidy.schema, store, f"{base}/progress", "seen_at")
    return store.rows().select("rel", "hash")
