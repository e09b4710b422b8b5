"""Commands, the line server, sessions and edits over a small tree."""

import io
import json
import os
import subprocess
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import pytest

from lodestone import tools
from lodestone.operators import embed
from lodestone.operators.relations import valid_rules
from lodestone.plans.fixture import FILES


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for p, t in FILES.items():
        os.makedirs(os.path.dirname(top / p) or top, exist_ok=True)
        (top / p).write_text(t)
    run = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    return str(top)


@pytest.fixture(scope="module")
def session(spark):
    return tools.Session(spark)


def rows(session, root, tool, **a):
    return [json.loads(x) for x in tools.lines_of(tools.call(session, tool, root, a))]


def test_every_command_answers(session, root, tmp_path):
    given = {
        "index": {"out_dir": str(tmp_path / "index")}, "search": {"query": "crane driver"}, "grep": {"pattern": "mass"}, "find_symbol": {"name_path": "Stack/push"}, "references": {"name": "weigh"}, "overview": {"rel": "py/yard/crates.py"},
        "tests_of": {"module": "web-src"}, "community": {"module": "web-src"}, "rules": {"rules": [{"name": "w", "from": ["web/**"], "to": ["packages/**"]}]}, "mermaid": {"module": "web-src"}, "callers": {"recall": True},
        "write_note": {"folder": str(tmp_path / "n"), "name": "a/b", "text": "x"}, "read_note": {"folder": str(tmp_path / "n"), "name": "a/b"}, "notes": {"folder": str(tmp_path / "n")}, "delete_note": {"folder": str(tmp_path / "n"), "name": "a/b"},
    }
    edits = {"replace_symbol", "insert_after", "insert_before"}
    for tool in [t for t in tools.TOOLS if t not in edits]:
        answer = list(tools.lines_of(tools.call(session, tool, root, given.get(tool, {}))))
        assert all(answer) and (tool != "mermaid" or answer[0].startswith("graph LR")), tool
    whole = json.loads("\n".join(tools.lines_of(tools.call(session, "graph", root, {"json": True}))))
    assert whole["fileCount"] == len(whole["files"]) == len(FILES) and {(e["src"], e["dst"]) for e in whole["fileEdges"]} >= {("web/src/crane.ts", "web/src/cargo.ts")} and whole["commit"]
    assert rows(session, root, "index", out_dir=str(tmp_path / "index"))[0]["written"] is False
    assert {r["enclosing"] for r in rows(session, root, "raw_callers") if r["name"] == "weigh" and r["file"] == "web/src/crane.ts"} == {"CraneDriver"}
    assert [(r["file"], r["line"]) for r in rows(session, root, "callers") if r["name"] == "weigh"] == [("web/src/crane.test.ts", 4), ("web/src/crane.ts", 8)]
    assert {r["doc"]: r["top_symbols"] for r in rows(session, root, "search", query="crane driver")}["web/src/crane.ts"] == ["CraneDriver"]
    assert rows(session, root, "tests_of", module="web-src") == [{"test": "web/src/crane.test.ts"}]
    assert {r["test"] for r in rows(session, root, "tests_map")} == {"web/src/crane.test.ts"}
    assert rows(session, root, "search", query="crane", semantic=True, model="/none")[0]["degraded_reason"] == "there is no model at /none"


def test_edits_are_seen_and_only_what_changed_is_read_again(session, root):
    before = session.repository(root)
    assert session.repository(root) is before
    assert rows(session, root, "insert_after", symbol="tower", body="def spire():\n    return tower(3)\n") == [{"file": "py/yard/stack.py", "line": 15, "done": "after"}]
    after = session.repository(root)
    assert after is not before and after.reused == len(FILES) - 1
    assert rows(session, root, "find_symbol", name_path="spire")[0]["file"] == "py/yard/stack.py"
    assert {(r["name"], r["file"]) for r in rows(session, root, "callers")} >= {("tower", "py/yard/stack.py")}
    rows(session, root, "replace_symbol", symbol="spire", body="def spire():\n    return 0")
    rows(session, root, "insert_before", symbol="spire", body="def base():\n    return 1")
    text = open(os.path.join(root, "py/yard/stack.py")).read()
    assert text.endswith("def base():\n    return 1\n\ndef spire():\n    return 0\n")
    with pytest.raises(LookupError):
        rows(session, root, "replace_symbol", symbol="nothing", body="")


def test_line_server(session, root):
    asked = [json.dumps({"id": 1, "tool": "overview", "arguments": {"rel": "py/yard/crates.py"}}), "", "no json", json.dumps([{"id": 2, "tool": "none"}, {"id": 3, "tool": "embed_status"}, 7])]
    out = io.StringIO()
    tools.serve(session, root, asked, out)
    one, two, three = map(json.loads, out.getvalue().splitlines())
    assert one["id"] == 1 and [r["name"] for r in one["result"]] == ["Crate", "measure_crate"]
    assert "no JSON" in two["error"] and "there is no tool none" in three[0]["error"] and three[1]["result"]["tier"] == "lexical" and "error" in three[2]


def test_command_line(spark, root, tmp_path):
    assert tools.parsed(["callers", "/x", "--recall", "--limit=5", "--a-b", "c"]) == ("callers", "/x", {"recall": True, "limit": 5, "a_b": "c"})
    with pytest.raises(SystemExit):
        tools.parsed([])
    out = tmp_path / "o.jsonl"
    assert tools.main(["scan", root, "--out", str(out)], spark) == 0 and {json.loads(x)["lang"] for x in out.read_text().splitlines()} >= {"python", "go"}
    rules = tmp_path / "r.json"
    rules.write_text(json.dumps([{"name": "w", "from": ["web/**"], "to": ["packages/**"]}]))
    assert tools.main(["rules", root, "--rules", str(rules), "--out", str(out)], spark) == 1


@pytest.mark.parametrize("rules", [{}, [1], [{}], [{"name": "a", "from": ["x"], "to": []}], [{"name": "a", "from": "x", "to": ["y"]}], [{"name": "a", "builtin": "none"}], [{"name": "a", "builtin": "cycles"}] * 2, [{"name": "a", "builtin": "cycles", "severity": "fatal"}], [{"name": "a", "from": ["x"], "to": ["y"], "kinds": ["", "x"]}]])
def test_rules_that_are_no_rules(rules):
    with pytest.raises(ValueError):
        valid_rules(rules)


def test_vectors_of_an_endpoint(spark, session, root):
    class Vectors(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["content-length"])))["texts"]
            body = json.dumps({"vectors": [[float("crane" in t.lower()), 0.5] for t in texts]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Vectors)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert embed.tier(None, url) == ("endpoint", None)
        found = rows(session, root, "search", query="crane", semantic=True, endpoint=url)
        assert {r["tier"] for r in found} == {"endpoint"} and "web/src/crane.ts" in [r["file"] for r in found[:3]]
    finally:
        server.shutdown()
    assert embed.tier(None, "http://127.0.0.1:9")[0] == "lexical"
