"""Layouts of source texts and of what an index keeps of them."""

import random

import pytest

from lodestone.llm import handwritten as H
from lodestone.llm import lexing as L

HAND = '''import os
from x import y


class A(B):
    """Doc."""

    def f(self, a, b=1):
        # note
        if a and b:
            return {"k": [1, 2, a]}
        return self.g(a)[0]


def h(x):
    for i in range(10):
        print(i,x)
'''
MINIFIED = "".join(f"function a{i}(b,c){{if(b>c){{return b.d(c)}}for(var e=0;e<c;e++){{b.f[e]=c}}return b}}" for i in range(60))
DATA = "const D = [" + ",".join(str(i * 7919 % 100003) for i in range(4000)) + "];\n"
TABLE = "TABLE = {\n" + "".join(f'    "k{i}": "{i * 37}",\n' for i in range(900)) + "}\n"
GENERATED = "package pb\n" + "".join(f"func (m *Msg{i}) GetId() int64 {{\n  return m.id;\n}}\n" for i in range(40))


@pytest.mark.parametrize("text", [HAND, MINIFIED, DATA, TABLE, GENERATED, "", "\n", "'open", "/* open", '"""open', "a\r\nb\rc", "é = '日本' # ü", "}})]", "`a\nb`;x"])
def test_tokens_make_up_the_text(text):
    for lang in ("python", "javascript", "php"):
        assert "".join(t for _, t in L.tokens(text, lang)) == text


def test_random_texts_are_lexed_whole():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("ab1 \t\n\r(){}[];,.'\"`/*#\\=+-é") for _ in range(rng.randrange(80)))
        assert "".join(x for _, x in L.tokens(t)) == t
        emitted = [x for _, line in L.canonical(L.tokens(t)) for x in line]
        assert emitted == [x for x in L.tokens(t) if x[0] not in ("blank", "line")]


def test_canonical_layout():
    lines = L.canonical(L.tokens("function f(a,b){if(a){return g( a , b )}for(;;){x=1;}}"))
    assert [" " * 4 * n + L.spaced(x) for n, x in lines] == ["function f(a, b) {", "    if(a) {", "        return g(a, b)", "    }", "    for(;;) {", "        x = 1;", "    }", "}"]


def test_layouts_of_contents(spark):
    rows = [("hand.py", HAND, "python"), ("m.js", MINIFIED, "javascript"), ("d.js", DATA, "javascript"), ("t.py", TABLE, "python"), ("g.go", GENERATED, "go"), ("none", None, None), ("empty", "", "python"), ("m.js", MINIFIED, "javascript")]
    df = spark.createDataFrame(rows, "rel string, content string, lang string").withColumnRenamed("lang", "language")
    got = [(r["rel"], r["reason"]) for r in H.of_contents(df, lang="language").collect()]
    assert sorted(got, key=str) == sorted([("hand.py", None), ("m.js", "minified"), ("d.js", "data"), ("t.py", "data"), ("g.go", "generated"), ("none", None), ("empty", None), ("m.js", "minified")], key=str)


def test_copies_and_uniform_signatures(spark):
    cols = "rel string, size bigint, lines int, kind string, summary string, hash string, seen_at int"
    rows = [("a/vendor/lib/x.js", 3000, 90, "code", None, "AB", 1), ("b/own.js", 3000, 90, "code", None, " ab ", 1), ("b/other.js", 3000, 90, "code", None, "cd", 1), ("b/null.js", 3000, 90, "code", None, None, 1)]
    rows += [("a/vendor/lib/init.py", 10, 1, "code", None, "ee", 1), ("b/init.py", 10, 1, "code", None, "ee", 1), ("b/alike.js", 3000, 90, "code", None, "f", 1), ("b/nearly.js", 3000, 90, "code", None, "g", 1), ("b/row.js", 700, 2, "code", None, "h", 1)]
    s = [("b/alike.js", i, 3 * i, 3 * i + 2, f"get(a{i})") for i in range(9)] * 2 + [("b/nearly.js", i, 3 * i, 3 * i + 2 + i % 2, f"get(a{i})") for i in range(9)]
    s += [("b/row.js", i, 1, 1, "function f(a){return a}") for i in range(40)] + [(None, 1, 1, 1, None), ("b/other.js", None, 1, 1, None), ("b/other.js", 3, None, None, None)]
    f, symbols = spark.createDataFrame(rows, cols), spark.createDataFrame(s, "file string, pos int, line int, end_line int, signature string")
    assert {r["rel"]: r["reason"] for r in H.found(f, symbols).collect()} == {"a/vendor/lib/x.js": "vendored", "b/own.js": "copy", "a/vendor/lib/init.py": "vendored", "b/alike.js": "generated", "b/row.js": "minified"}
