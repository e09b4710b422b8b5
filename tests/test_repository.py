"""A small tree built end to end, graph algorithms with known answers, walking, decoding, edits, artifacts."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.functions.paths import glob_regex, ignore_rules, is_ignored
from lodestone.operators import graph as G
from lodestone.operators.extract import use_group
from lodestone.operators.resolve import exports, jsonc
from lodestone.plans.fixture import FILES
from lodestone.plans.repository import Repository
from lodestone.sinks import artifacts, edits
from lodestone.sources import walk
from lodestone.sources.decode import decoded


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    more = {"node_modules/x/index.js": "nope", ".gitignore": "*.log\n!keep.log\ntmpdir/\n", "a.log": "x", "keep.log": "x", "tmpdir/b.ts": "x", "_private/c.py": "def f():\n    pass\n", "big.min.js": "x", "yarn.lock": "x", "bin.png": "x"}
    for p, t in {**FILES, **more}.items():
        os.makedirs(os.path.dirname(top / p) or top, exist_ok=True)
        (top / p).write_text(t)
    run = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    return str(top)


@pytest.fixture(scope="module")
def repo(spark, root):
    return Repository(spark, root)


def test_walk(root):
    w = walk.walk(root)
    names = {f[0] for f in w.files}
    assert set(FILES) <= names and {"keep.log", "_private/c.py", ".gitignore"} <= names
    assert not names & {"a.log", "tmpdir/b.ts", "big.min.js", "yarn.lock", "bin.png", "node_modules/x/index.js"}
    assert w.excluded >= 4 and not w.capped
    few = walk.walk(root, max_files=3)
    assert few.capped and len(few.files) == 3
    assert "node_modules/x/index.js" in {f[0] for f in walk.walk(root, ignored=[".git"]).files}


def test_graph_of_the_tree(repo):
    e = {(r["src"], r["dst"], r["kind"]) for r in repo.edges.collect()}
    assert ("web/src/crane.ts", "web/src/cargo.ts", "import") in e
    assert ("README.md", "docs/none.md", "doc-link") in e
    assert ("docs/crane.md", "web/src/crane.ts", "mention") in e
    assert ("py/yard/stack.py", "py/yard/crates.py", "call") in e
    dangling = {r["dst"]: r["reason"] for r in repo.edges.where("dangling").collect()}
    assert dangling == {"docs/none.md": "missing-target", "./nowhere": "missing-module"}
    assert repo.file_nodes.count() == repo.files.count()
    assert {r["rel"] for r in repo.tests_map().collect()} == {"web/src/crane.ts", "web/src/cargo.ts"}


def test_questions(repo):
    assert repo.search("crane driver").first()["doc"].startswith(("web/src/crane", "docs/crane", "web/src/index"))
    assert [(r["rel"], r["line"]) for r in repo.grep(r"c\.mass > 10").collect()] == [("web/src/crane.ts", 7)]
    assert repo.find_symbol("Stack/push").first()["line"] == 8
    assert [r["name"] for r in repo.overview("py/yard/crates.py").collect()] == ["Crate", "measure_crate"]
    inside = {(r["file"], r["name"]): r["enclosing"] for r in repo.raw_callers().collect()}
    assert inside["web/src/crane.ts", "weigh"] == "CraneDriver"
    assert {(r["name"], r["file"]) for r in repo.dead_code().collect()} & {("tower", "py/yard/stack.py"), ("sail", "packages/ship/src/main.ts")}
    assert {r["rule"] for r in repo.check_rules([{"name": "o", "builtin": "orphans"}, {"name": "c", "builtin": "cycles"}, {"name": "w", "from": ["web/**"], "to": ["packages/**"]}]).collect()} >= {"w"}
    assert repo.hotspots().count() > 0
    assert repo.complexity().first()["complexity"] >= 3


KNOWN = [("docs", "root", 1), ("docs", "src", 1), ("gopkg", "gopkg-sub", 2), ("root", "docs", 2), ("root", "src", 1)]


def test_known_graph(spark):
    e = spark.createDataFrame(KNOWN, "src string, dst string, weight int")
    n = spark.createDataFrame([(x,) for x in ("docs", "gopkg", "gopkg-sub", "pkg", "root", "src")], "id string")
    rank = {r["id"]: round(r["rank"], 4) for r in G.pagerank(n, e).collect()}
    assert rank == {"docs": 1.214, "gopkg": 0.5883, "gopkg-sub": 1.0883, "pkg": 0.5883, "root": 1.1042, "src": 1.417}
    assert {r["betweenness"] for r in G.betweenness(n, e).collect()} == {0.0}
    of = {r["id"]: r["community"] for r in G.communities(n, e).collect()}
    assert len(set(of.values())) == 3 and of["docs"] == of["root"] == of["src"] and of["gopkg"] == of["gopkg-sub"] != of["pkg"]
    again = {r["id"]: r["community"] for r in G.communities(n, e, previous={"pkg": 0, "docs": 2, "root": 2}).collect()}
    assert again["pkg"] == 0 and again["docs"] == 2
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight int")
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r["id"]: r["betweenness"] for r in G.betweenness(three, path).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_cycles_and_order(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "e"), ("g", "g")], "src string, dst string")
    assert G.cycles(e) == [["a", "b", "c"], ["e", "f"]]
    assert G.topological(["x", "y", "z", "p", "q"], {"x": {"y"}, "y": {"z"}, "p": {"q"}, "q": {"p"}}) == ["z", "y", "x", "p", "q"]


@pytest.mark.parametrize(
    ("line", "path", "is_dir", "want"),
    [("*.log", "a/b.log", False, True), ("/a", "b/a", False, False), ("/a", "a", False, True), ("build/", "x/build", True, True), ("build/", "x/build", False, False), ("a/**/b", "a/x/y/b", False, True), ("a/**/b", "a/b", False, True), ("**/c", "x/c", False, True), ("d/**", "d/e/f", False, True), ("[!a].x", "b.x", False, True), ("[!a].x", "a.x", False, False), (r"\!k", "!k", False, True), ("#c", "#c", False, False), ("sp ", "sp", False, True)],
)
def test_ignore_lines(line, path, is_dir, want):
    assert is_ignored(ignore_rules(line), path, is_dir) is want


def test_small_functions():
    import re

    assert re.match(glob_regex("src/**/*.ts"), "src/a.ts") and not re.match(glob_regex("*.ts"), "a/b.ts")
    assert decoded("ä".encode("utf-16")) == "ä" and decoded(b"\xe4") == "ä" and decoded(b"a\0b") == "" and decoded(b"\xef\xbb\xbfx") == "x" and decoded(None) == ""
    assert use_group("a::{b, c::{d, e}}") == ["a::b", "a::c::d", "a::c::e"]
    assert jsonc('{"a": "// no", /* x */ "b": [1, 2,],}') == {"a": "// no", "b": [1, 2]}
    assert exports({"exports": {".": {"import": "./e.mjs", "types": "./e.d.ts"}, "./f/*": "./src/f/*.js"}}, "./f/x") == ["./src/f/x.js"]
    text = "a\nb\nc"
    assert edits.replaced(text, 2, 2, "x\ny") == "a\nx\ny\nc"
    assert edits.inserted(text, 2, 2, "n", after=True) == "a\nb\n\nn\n\nc"
    head, vecs = artifacts.unpack_vectors(artifacts.pack_vectors([({"file": "f"}, [1, -127])], "m", 2))
    assert head["count"] == 1 and vecs == [[1, -127]]
    with pytest.raises(ValueError):
        artifacts.unpack_vectors(b"nope")


def test_notes(tmp_path):
    edits.write_note(str(tmp_path), "../up/note", "x")
    assert os.listdir(tmp_path) == ["up-note.md"] and edits.read_note(str(tmp_path), "up-note") == "x"
    assert edits.list_notes(str(tmp_path)) == ["up-note"] and edits.delete_note(str(tmp_path), "up-note") and edits.read_note(str(tmp_path), "up-note") is None


def test_saved_index_counts_only_whole(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("x"))
    artifacts.save_index(str(tmp_path / "i"), {"t": df}, "c")
    assert artifacts.load_index(spark, str(tmp_path / "i"), "c")["t"].count() == 5
    assert artifacts.load_index(spark, str(tmp_path / "i"), "other") is None
    assert artifacts.load_index(spark, str(tmp_path / "none")) is None
