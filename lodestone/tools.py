"""The engine as commands and as a line-by-line server: ``python -m lodestone COMMAND [ROOT] [--name value ...]``.

A command answers with rows (one JSON object a line), with one JSON object or with a text, on the standard output or
in the file of ``--out``. ``serve`` reads requests, one JSON object or a list of them a line, {"id", "tool",
"arguments"}, and answers each line with one line. A session keeps the index of each tree; a tree whose listing has
changed is indexed again, reusing what has not, and so is one after an edit.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embed
from .plans.repository import Repository
from .sinks import artifacts, edits
from .sources import git, walk

Answer = DataFrame | dict | list | str | Iterator[str] | None


class Session:
    """Indexes of trees by root and options, each as fresh as its tree."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: dict[tuple, tuple[str, Repository]] = {}

    @staticmethod
    def _key(root: str, options: dict) -> tuple:
        return os.path.realpath(root), json.dumps(options, sort_keys=True)

    def repository(self, root: str, **options) -> Repository:
        key = self._key(root, options)
        limits = walk._limits({k: str(v) for k, v in options.items() if isinstance(v, (str, int))})
        state = hashlib.sha1(repr(walk.walk(root, **limits).files).encode()).hexdigest()
        held = self._held.get(key)
        if held and held[0] == state:
            return held[1]
        repo = Repository(self.spark, root, previous=held[1].saved if held else None, **options)
        self._held[key] = (state, repo)
        return repo

    def forget(self, root: str) -> None:
        """What is derived from a tree is dropped after an edit; its extracted rows serve the next index."""
        for key in [k for k in self._held if k[0] == os.path.realpath(root)]:
            self._held[key] = ("", self._held[key][1])


def _edit(kind: str) -> Callable[[Session, str, dict], Answer]:
    def run(session: Session, root: str, a: dict) -> Answer:
        found = edits.unique_symbol(session.repository(root).symbols, a["symbol"], a.get("file"))
        path = os.path.join(root, found["file"])
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if kind == "replace":
            new = edits.replaced(text, found["line"], found["end_line"], a["body"])
        else:
            new = edits.inserted(text, found["line"], found["end_line"], a["body"], after=kind == "after")
        with open(path, "w", encoding="utf-8") as f:
            f.write(new)
        session.forget(root)
        return {"file": found["file"], "line": found["line"], "done": kind}

    return run


def _rules(session: Session, root: str, a: dict) -> Answer:
    rules = a.get("rules")
    if isinstance(rules, str):
        with open(rules, encoding="utf-8") as f:
            rules = json.load(f)
    return session.repository(root).check_rules(rules)


def _index(session: Session, root: str, a: dict) -> Answer:
    """Saves the tables of an index; one that is there and whole, of this commit and these contents, is left alone."""
    out, commit = a["out_dir"], git.head(root)
    inside = os.path.relpath(os.path.realpath(out), os.path.realpath(root))
    if inside == ".":
        raise ValueError("the index would lie where the tree is")
    repo = session.repository(root, **({} if inside.startswith("..") else {"out_dirs": [inside]}))
    old = artifacts.load_index(session.spark, out, commit)
    now = repo.files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("rel", "hash").cast("decimal(38,0)"))).first()
    if old and tuple(old["files"].agg(F.count(F.lit(1)), F.sum(F.xxhash64("rel", "hash").cast("decimal(38,0)"))).first()) == tuple(now):
        return {"out_dir": out, "files": now[0], "written": False}
    artifacts.save_index(out, {**repo.saved, "edges": repo.edges, "symbols": repo.symbols, "file_nodes": repo.file_nodes}, commit)
    return {"out_dir": out, "files": now[0], "written": True, "reused": repo.reused}


def _semantic(session: Session, root: str, a: dict) -> Answer:
    repo, limit = session.repository(root), int(a.get("limit", 20))
    if a.get("semantic"):
        return repo.semantic(a["query"], a.get("model"), a.get("endpoint"), limit)
    return repo.search(a["query"], limit, not a.get("no_fuzzy"))


def _graph(session: Session, root: str, a: dict) -> Answer:
    """The whole document with ``--json``, else a line for each edge."""
    if a.get("json"):
        return session.repository(root).graph_json()
    return artifacts.graph_lines(session.repository(root).edges).orderBy("src", "dst", "kind").select(F.col("line").alias("edge"))


def _workspaces(session: Session, root: str, a: dict) -> Answer:
    packages, links, order, cycle = session.repository(root).workspaces()
    return {"packages": [r.asDict() for r in packages.orderBy("dir").collect()], "edges": [r.asDict() for r in links.orderBy("src", "dst").collect()], "order": order, "cycle": cycle}


def _of(name: str, *arguments: str) -> Callable[[Session, str, dict], Answer]:
    """A method of the repository with some of its arguments."""
    return lambda s, root, a: getattr(s.repository(root), name)(**{k: a[k] for k in arguments if k in a})


TOOLS: dict[str, Callable[[Session, str, dict], Answer]] = {
    "index": _index,
    "scan": _of("scan_summary"),
    "left_out": _of("left_out"),
    "graph": _graph,
    "modules": _of("module_nodes"),
    "symbols": _of("symbol_index"),
    "scip": lambda s, root, a: s.repository(root).scip().select("file", F.base64("document").alias("document")).orderBy("file"),
    "callers": _of("callers", "recall"),
    "caller_index": _of("caller_index", "recall"),
    "raw_callers": _of("raw_callers"),
    "search": _semantic,
    "embed_status": lambda s, root, a: dict(zip(("tier", "reason"), embed.tier(a.get("model"), a.get("endpoint")))),
    "grep": _of("grep", "pattern", "limit"),
    "find_symbol": _of("find_symbol", "name_path", "substring"),
    "references": _of("references", "name"),
    "overview": _of("overview", "rel"),
    "dead_code": _of("dead_code"),
    "complexity": _of("complexity", "limit"),
    "risk": _of("risk", "since"),
    "hotspots": _of("hotspots", "since"),
    "churn": _of("churn", "since"),
    "coupling": _of("coupling", "since"),
    "tests_map": _of("tests_map"),
    "tests_of": _of("tests_of", "module"),
    "community": lambda s, root, a: {"module": a["module"], "community": s.repository(root).community_of(a["module"])},
    "rules": _rules,
    "repo_map": _of("repo_map"),
    "mermaid": _of("mermaid", "module"),
    "workspaces": _workspaces,
    "changed": lambda s, root, a: sorted(git.changed_since(root, a.get("ref") or git.base_ref(root)[0])),
    "replace_symbol": _edit("replace"),
    "insert_after": _edit("after"),
    "insert_before": _edit("before"),
    "write_note": lambda s, root, a: {"path": edits.write_note(a["folder"], a["name"], a["text"])},
    "read_note": lambda s, root, a: {"text": edits.read_note(a["folder"], a["name"])},
    "delete_note": lambda s, root, a: {"deleted": edits.delete_note(a["folder"], a["name"])},
    "notes": lambda s, root, a: edits.list_notes(a["folder"]),
}


def call(session: Session, tool: str, root: str, arguments: dict) -> Answer:
    if tool not in TOOLS:
        raise LookupError(f"there is no tool {tool}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[tool](session, root, arguments)


def lines_of(answer: Answer) -> Iterable[str]:
    """An answer line by line; rows come one after another and are never all held."""
    if isinstance(answer, DataFrame):
        yield from (json.dumps({k: v for k, v in r.asDict(True).items() if v is not None}, ensure_ascii=False, default=str) for r in answer.toLocalIterator())
    elif isinstance(answer, str):
        yield answer.rstrip("\n")
    elif isinstance(answer, Iterator):
        part = ""
        for piece in answer:
            *whole, part = (part + piece).split("\n")
            yield from whole
        if part:
            yield part
    else:
        yield json.dumps(answer, ensure_ascii=False, default=str)


def emit(answer: Answer, out: str | None = None) -> None:
    to: IO[str] = open(out, "w", encoding="utf-8") if out else sys.stdout
    try:
        for line in lines_of(answer):
            to.write(line + "\n")
    finally:
        if out:
            to.close()


def parsed(argv: list[str]) -> tuple[str, str, dict]:
    """(command, root, arguments) of a command line; a flag without a value is true, dashes in names are underlines."""
    plain: list[str] = []
    named: dict[str, object] = {}
    i = 0
    while i < len(argv):
        if argv[i].startswith("--"):
            name, eq, value = argv[i][2:].partition("=")
            if not eq and i + 1 < len(argv) and not argv[i + 1].startswith("--"):
                i, value, eq = i + 1, argv[i + 1], "="
            named[name.replace("-", "_")] = (int(value) if value.isdigit() else value) if eq else True
        else:
            plain.append(argv[i])
        i += 1
    if not plain:
        raise SystemExit(f"usage: lodestone COMMAND [ROOT] [--name value ...]\ncommands: serve {' '.join(TOOLS)}")
    return plain[0], plain[1] if len(plain) > 1 else ".", named


def serve(session: Session, root: str, requests: Iterable[str], to: IO[str]) -> None:
    """Answers each line of requests with one line; what fails is answered with its error."""

    def answered(r: object) -> dict:
        if not isinstance(r, dict):
            return {"id": None, "error": "a request is an object"}
        try:
            answer = call(session, str(r.get("tool")), r.get("root") or root, r.get("arguments") or {})
            rows = list(lines_of(answer))
            result = [json.loads(x) for x in rows] if isinstance(answer, DataFrame) else json.loads("\n".join(rows)) if isinstance(answer, Iterator) else answer
            return {"id": r.get("id"), "result": result}
        except Exception as e:  # noqa: BLE001 the loop goes on
            return {"id": r.get("id"), "error": f"{type(e).__name__}: {e}"}

    for line in requests:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
        except ValueError as e:
            out: object = {"id": None, "error": f"no JSON: {e}"}
        else:
            out = [answered(r) for r in asked] if isinstance(asked, list) else answered(asked)
        to.write(json.dumps(out, ensure_ascii=False, default=str) + "\n")
        to.flush()


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """The exit code: 1 where rules are broken by errors."""
    from .session import session

    command, root, named = parsed(argv)
    s = Session(spark or session())
    if command == "serve":
        serve(s, root, sys.stdin, sys.stdout)
        return 0
    out = named.pop("out", None)
    answer = call(s, command, root, named)
    emit(answer, out)
    return int(command == "rules" and isinstance(answer, DataFrame) and answer.where("severity = 'error'").limit(1).count() > 0)
