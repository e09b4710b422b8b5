"""Search, calls, extraction and walking: the cases that an index has to get right."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.paths import ignore_rules, is_ignored
from lodestone.operators import extract as E
from lodestone.operators import graph as G
from lodestone.operators import relations as R
from lodestone.operators import search as S
from lodestone.sources import walk


def test_search_folds_marks_counts_fields_and_names_symbols(spark):
    rows = [("a.ts", ["créerÉquipe", "createTeam", "a.ts", "Gérer une équipe"]), ("b.ts", ["teamOf", "team", "b.ts", None]), ("c.md", ["c.md", "team team team"]), ("e.ts", [])]
    docs = spark.createDataFrame(rows, "rel string, parts array<string>")
    names = spark.createDataFrame([("a.ts", "créerÉquipe"), ("a.ts", "createTeam"), ("b.ts", "teamOf"), ("b.ts", "team")], "doc string, name string")
    built = S.index(docs, "rel", F.col("parts"), fields=True)
    tf = {(r["doc"], r["term"]): r["tf"] for r in built.post.collect()}
    assert tf["a.ts", "equipe"] == 2 and tf["c.md", "team"] == 1 and tf["b.ts", "team"] == 2
    got = {r["doc"]: r["top_symbols"] for r in S.ask(built, "equipe", symbols=names).collect()}
    assert got == {"a.ts": ["créerÉquipe"]}
    assert {r["doc"]: r["top_symbols"] for r in S.ask(built, "équipe team", symbols=names).collect()} == {"a.ts": ["createTeam", "créerÉquipe"], "b.ts": ["team", "teamOf"], "c.md": []}
    near = S.ask(built, "equipr", symbols=names).first()
    assert (near["doc"], near["fuzzy"], near["top_symbols"]) == ("a.ts", "equipr", ["créerÉquipe"])
    assert S.ask(built, "").count() == 0


@pytest.mark.parametrize(("raw", "want"), [("HTTPServerÉtat", ["httpserveretat", "http", "server", "etat"]), ("ﬁnd_x²y", ["find_x2y", "find", "x2y"]), ("naïve text", ["naive", "text"]), ("Å", []), ("", [])])
def test_subtokens(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(T.subtokens(F.col("s")).alias("t")).first()["t"] == want


def calls_and_symbols(spark, calls, symbols):
    c = spark.createDataFrame(calls, "src string, name string, family string, n int")
    s = spark.createDataFrame(symbols, "file string, pos int, name string, kind string, line int, end_line int, exported boolean, lang string")
    return c, s


def test_calls_bind_by_import_then_by_nearness(spark):
    c, s = calls_and_symbols(
        spark,
        [("a/x.py", "f", "python", 2), ("a/y.py", "f", "python", 1), ("z.py", "f", "python", 1), ("a/b/w.py", "g", "python", 1), ("s.ts", "h", "js", 1), ("t.ts", "h", "js", 1), ("a/x.py", "own", "python", 3), ("a/x.py", "none", "python", 1)],
        [("a/d.py", 0, "f", "function", 1, 2, True, "python"), ("b/d.py", 0, "f", "function", 1, 2, True, "python"), ("c/d.rb", 0, "f", "function", 1, 2, True, "ruby"), ("a/b/c/q.py", 0, "g", "function", 1, 2, True, "python"), ("a/b/q.py", 0, "g", "function", 1, 2, True, "python"), ("lib.ts", 0, "h", "function", 1, 2, True, "typescript"), ("a/x.py", 0, "own", "function", 5, 6, False, "python"), ("b/o.py", 0, "own", "function", 1, 2, True, "python")],
    )
    imports = spark.createDataFrame([("z.py", "b/d.py"), ("t.ts", "lib.ts"), ("t.ts", "none.ts")], "src string, dst string")
    got = {(r["src"], r["name"]): (r["dst"], r["imported"]) for r in R.nearest_target(c, s, imports).collect()}
    assert got == {("a/x.py", "f"): ("a/d.py", False), ("a/y.py", "f"): ("a/d.py", False), ("z.py", "f"): ("b/d.py", True), ("t.ts", "h"): ("lib.ts", True)}  # g has two as near
    b = {(r["src"], r["name"]): (r["dst"], r["confidence"]) for r in R.bindings(c, s, imports, recall=True).collect()}
    assert b["s.ts", "h"] == ("lib.ts", "unique-name") and b["a/x.py", "own"] == ("a/x.py", "corroborated")
    index = {r["key"]: (r["def_file"], r["callers"], r["sites"]) for r in R.caller_index(R.bindings(c, s, imports)).collect()}
    assert index == {"f": ("a/d.py", 2, 3), "f@b/d.py": ("b/d.py", 1, 1), "h": ("lib.ts", 1, 1), "own": ("a/x.py", 1, 3)}
    sites = spark.createDataFrame([("a/x.py", "own", 5), ("a/x.py", "own", 9), ("z.py", "f", 3)], "file string, name string, line int")
    assert {tuple(r) for r in R.caller_sites(sites, R.bindings(c, s, imports), s).collect()} == {("own", "a/x.py", "a/x.py", 9, "corroborated"), ("f", "b/d.py", "z.py", 3, "corroborated")}


def test_one_name_defined_and_called_in_ten_thousand_files(spark):
    n = 10_000
    ids = spark.range(n)
    s = ids.selectExpr("concat('d', id % 100, '/def', id, '.py') file", "0 pos", "'run' name", "'function' kind", "1 line", "2 end_line", "true exported", "'python' lang")
    c = ids.selectExpr("concat('c/call', id, '.py') src", "'run' name", "'python' family", "1 n")
    imports = ids.where("id < 50").selectExpr("concat('c/call', id, '.py') src", "concat('d', id % 100, '/def', id, '.py') dst")
    assert R.nearest_target(c, s, imports).count() == 50
    assert R.call_candidates(c, s, imports).agg(F.max("candidates"), F.count(F.lit(1))).first()[:] == (n, n)


def test_enclosing_symbols(spark):
    s = spark.createDataFrame([("f", 0, "C", "class", 1, 20, True, "x"), ("f", 1, "m", "method", 2, 5, True, "x"), ("f", 2, "n", "method", 8, 9, True, "x"), ("f", 3, "r", "reexport", 8, 30, True, "x"), ("f", 4, "open", "function", 40, None, True, "x"), ("g", 0, "solo", "function", 3, 3, True, "x"), ("f", 9, "m2", "method", 2, 5, True, "x")], "file string, pos int, name string, kind string, line int, end_line int, exported boolean, lang string")
    sites = spark.createDataFrame([("f", "a", x) for x in (1, 2, 5, 6, 8, 10, 20, 21, 40, 99)] + [("g", "b", 2), ("g", "b", 3), ("h", "c", 1), ("f", None, 6), ("f", "null", None)], "file string, name string, line int")
    got = {(r["file"], r["line"]): (r["enclosing"], r["enclosing_line"]) for r in R.enclosing(sites, s).collect()}
    assert got == {("f", 1): ("C", 1), ("f", 2): ("m2", 2), ("f", 5): ("m2", 2), ("f", 6): ("C", 1), ("f", 8): ("n", 8), ("f", 10): ("C", 1), ("f", 20): ("C", 1), ("f", 21): (None, None), ("f", 40): ("open", 40), ("f", 99): ("open", 40), ("g", 2): (None, None), ("g", 3): ("solo", 3), ("h", 1): (None, None), ("f", None): (None, None)}


JS = """// log("no") in a comment
const { a } = require("./a");
import { b as c, type D } from "./b";
exports.one = 1;
module.exports.two = function () {};
function hidden() { return helper("say(x)"); }
function helper(t) { /* gone(1) */ return t; }
module.exports = { hidden, three: helper };
export default () => hidden();
"""


def test_scripts():
    tier, found = E.symbols("javascript", ".js", JS, "src/tools.js")
    by = {s["name"]: (s["kind"], s["exported"]) for s in found}
    assert tier == "regex" and by["one"] == ("const", True) and by["hidden"] == ("function", True) and by["helper"] == ("function", True) and by["tools"] == ("default", True)
    assert {c["name"] for c in E.calls("javascript", JS, found)} == {"require", "helper", "hidden"}
    assert E.imported_names("javascript", JS) == ["D", "b"]
    named = E.symbols("javascript", ".js", "class Foo {}\nexport default Foo;\n", "x.js")[1]
    assert [(s["name"], s["kind"], s["exported"]) for s in named] == [("Foo", "class", True), ("Foo", "default", True)]


@pytest.mark.parametrize(
    ("lang", "code", "want"),
    [
        ("ruby", "module M\n  class C\n    def go?\n    end\n  end\nend\n", {("M", "module"), ("C", "class"), ("go?", "method")}),
        ("csharp", "namespace N;\npublic class C {\n    public void Go() { }\n}\n", {("C", "class"), ("Go", "method")}),
        ("php", "<?php\nfinal class C {\n    private function go() {}\n}\nfunction f() {}\n", {("C", "class"), ("go", "method"), ("f", "function")}),
        ("swift", "struct S {\n  func go() {}\n}\nprotocol P {}\n", {("S", "struct"), ("go", "function"), ("P", "protocol")}),
        ("kotlin", "object O {\n  fun go() {}\n}\ninterface I\n", {("O", "object"), ("go", "function"), ("I", "interface")}),
        ("lua", "local function f() end\nfunction M.go() end\n", {("f", "function"), ("go", "function")}),
        ("shell", "function a {\n:\n}\nb() {\n:\n}\n", {("a", "function"), ("b", "function")}),
        ("elixir", "defmodule A.B do\n  def go(x), do: x\n  defp no, do: 1\nend\n", {("A.B", "module"), ("go", "function"), ("no", "function")}),
        ("scala", "object O {\n  def go = 1\n}\ntrait T\n", {("O", "object"), ("go", "function"), ("T", "trait")}),
    ],
)
def test_rules_of_other_languages(lang, code, want):
    assert {(s["name"], s["kind"]) for s in E.symbols(lang, "", code)[1]} == want


def test_methods_that_a_script_declares_are_no_calls():
    code = "export class A {\n  static async go(x: number): Promise<void> {\n    if (x) {\n      run(x, () => {\n      });\n    }\n  }\n  empty() {}\n}\nfunction f() {\n  loop(1) \n}\n"
    found = E.symbols("typescript", ".ts", code)[1]
    assert [(s["name"], s["line"], s["end_line"]) for s in found] == [("A", 1, 9), ("f", 10, 12)]
    assert [(c["name"], c["line"]) for c in E.calls("typescript", code, found)] == [("run", 4), ("loop", 11)]


def test_python_calls_come_from_its_grammar():
    code = "import os\n\ndef f(x):\n    # g(1)\n    return os.path.join(hop(x), 'k(2)')\n"
    assert [(c["name"], c["line"], c["receiver"]) for c in E.calls("python", code, [])] == [("hop", 5, None), ("join", 5, "path")]
    assert E.identifiers("python", code + "'hidden_name' # other_name\nreal_name\n", []) == ["import", "real_name", "return"]


def test_declarations_in_c_are_no_calls():
    assert [c["name"] for c in E.calls("c", "int drop(struct A a);\nstatic void *get(int);\nint main() {\n  drop(a);\n}\n", [{"name": "main", "line": 3}])] == ["drop"]


def test_caps_say_what_they_cut(spark):
    code = "".join(f"def f{i}():\n    call_{i}()\n" for i in range(9))
    full, few = E.extract("a.py", ".py", code), E.extract("a.py", ".py", code, E.Caps(symbols=4, calls=5))
    assert len(full["symbols"]) == 9 and full["cut"] == []
    assert len(few["symbols"]) == 4 and len(few["calls"]) == 5 and few["cut"] == ["symbols", "calls"]
    E.register_extractor(".zz", lambda content: [{"name": content.strip(), "kind": "thing", "line": 1, "end_line": 1, "parent": None, "signature": "", "exported": True}])
    try:
        got = E.extracted(spark.createDataFrame([("a.zz", ".zz", "hello"), ("b.py", ".py", None)], "rel string, ext string, content string")).collect()
    finally:
        E.EXTRA.clear()
    assert {r["rel"]: (r["tier"], [s["name"] for s in r["symbols"]]) for r in got} == {"a.zz": ("extra", ["hello"]), "b.py": ("ast", [])}


def test_lines_that_are_no_patterns_ignore_nothing():
    rules = ignore_rules("[z-a]\n*.log\n")
    assert is_ignored(rules, "a.log") and not is_ignored(rules, "z-a")


def test_the_walk_says_what_it_left_out(spark, tmp_path):
    for name, text in {"a.py": "x", "big.py": "x" * 50, "yarn.lock": "", "p.png": "", "a.min.js": "", ".gitignore": "no.txt", "no.txt": "", "skip/b.py": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = lambda **o: {r["what"]: r["files"] for r in walk.left_out(spark, str(tmp_path), **o).collect()}
    assert rows() == {"kept": 4, "capped": 0, "lockfile": 1, "binary": 1, "minified": 1, "ignored": 1}
    assert rows(maxfilebytes="20", ignoreddirs="skip")["size"] == 1 and rows(maxfiles="1")["capped"] == 1


def test_ranks_do_not_depend_on_the_way(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + j) % 30}", j + 1) for i in range(25) for j in range(3)], "src string, dst string, weight int")
    n = spark.createDataFrame([(f"n{i}",) for i in range(31)], "id string")
    ranks = lambda **o: {r["id"]: round(r["rank"], 6) for r in G.pagerank(n, e, iterations=9, **o).collect()}
    assert ranks() == ranks(task_edges=0) and len(ranks()) == 31
    assert {r["id"]: r["least"] for r in G.strong_sets(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "y"), ("y", "x")], "src string, dst string")).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
