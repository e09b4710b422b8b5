"""Per-file extraction: symbols, imports, calls, identifiers, headings, summary, in one pass over the texts.

Python files are parsed; the other languages are read by rules, one line at a time, the first rule that fits
giving the line's symbol. The end of a symbol follows from braces or indentation.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

_ID = r"([A-Za-z_$][\w$]*)"
#: Rules of each language: pattern with the name as its last group, kind. Visibility is decided by VISIBLE.
RULES: dict[str, list[tuple[str, str]]] = {
    "js": [
        (rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+{_ID}", "class"),
        (rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*{_ID}", "function"),
        (rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+{_ID}", "interface"),
        (rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{_ID}\s*(?:<[^=]*>)?\s*=", "type"),
        (rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{_ID}", "enum"),
        (rf"^\s*(?:export\s+)?(?:declare\s+)?namespace\s+{_ID}", "namespace"),
        (rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>", "function"),
        (rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}", "const"),
        (r"^\s*(?:module\.)?exports\.([\w$]+)\s*=(?!=)", "const"),
        (rf"^\s*export\s+default\s+(?!(?:async|function|class|abstract|new)\b){_ID}\s*;?\s*$", "default"),
    ],
    "go": [(r"^func\s+\([^)]*\)\s*(\w+)\s*[(\[]", "method"), (r"^func\s+(\w+)\s*[(\[]", "function"), (r"^type\s+(\w+)\s+struct\b", "struct"), (r"^type\s+(\w+)\s+interface\b", "interface"), (r"^type\s+(\w+)\b", "type")],
    "ruby": [(r"^\s*class\s+([A-Z]\w*)", "class"), (r"^\s*module\s+([A-Z]\w*)", "module"), (r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", "method")],
    "java": [(r"^\s*(?:[\w@]+\s+)*(?:class|record)\s+(\w+)", "class"), (r"^\s*(?:[\w@]+\s+)*interface\s+(\w+)", "interface"), (r"^\s*(?:[\w@]+\s+)*enum\s+(\w+)", "enum"), (r"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\(", "method")],
    "rust": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{", "module")],
    "csharp": [(r"^\s*(?:\w+\s+)*(?:class|record)\s+(\w+)", "class"), (r"^\s*(?:\w+\s+)*interface\s+(\w+)", "interface"), (r"^\s*(?:\w+\s+)*struct\s+(\w+)", "struct"), (r"^\s*(?:\w+\s+)*enum\s+(\w+)", "enum"), (r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|sealed)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\(", "method")],
    "php": [(r"^\s*(?:(?:abstract|final|readonly)\s+)*class\s+(\w+)", "class"), (r"^\s*interface\s+(\w+)", "interface"), (r"^\s*trait\s+(\w+)", "trait"), (r"^\s+(?:(?:public|protected|private|static|abstract|final)\s+)+function\s+&?(\w+)", "method"), (r"^\s*function\s+&?(\w+)", "function")],
    "swift": [(r"^\s*(?:\w+\s+)*(?:class|actor)\s+(?!func\b|var\b)(\w+)", "class"), (r"^\s*(?:\w+\s+)*struct\s+(\w+)", "struct"), (r"^\s*(?:\w+\s+)*protocol\s+(\w+)", "protocol"), (r"^\s*(?:\w+\s+)*enum\s+(\w+)", "enum"), (r"^\s*(?:\w+\s+)*func\s+(\w+)", "function")],
    "kotlin": [(r"^\s*(?:\w+\s+)*class\s+(\w+)", "class"), (r"^\s*(?:\w+\s+)*interface\s+(\w+)", "interface"), (r"^\s*(?:\w+\s+)*object\s+(\w+)", "object"), (r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", "function")],
    "c": [(r"^\s*(?:typedef\s+)?(?:struct|class|union)\s+(\w+)\s*[{:]", "struct"), (r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)", "enum"), (r"^\s*namespace\s+(\w+)", "namespace"), (r"^[A-Za-z_][\w\s*&:<>,]*?[\s*&](?:\w+::)?(\w+)\s*\([^;]*$", "function")],
    "lua": [(r"^\s*local\s+function\s+(\w+)", "function"), (r"^\s*function\s+(?:\w+[.:])*(\w+)", "function"), (r"^\s*(?:local\s+)?(\w+)\s*=\s*function\b", "function")],
    "shell": [(r"^\s*function\s+([\w-]+)", "function"), (r"^\s*([\w-]+)\s*\(\)\s*\{?", "function")],
    "elixir": [(r"^\s*defmodule\s+([\w.]+)", "module"), (r"^\s*defp?\s+(\w+[?!]?)", "function"), (r"^\s*defmacrop?\s+(\w+)", "macro"), (r"^\s*defprotocol\s+([\w.]+)", "protocol")],
    "scala": [(r"^\s*(?:\w+\s+)*class\s+(\w+)", "class"), (r"^\s*(?:\w+\s+)*object\s+(\w+)", "object"), (r"^\s*(?:\w+\s+)*trait\s+(\w+)", "trait"), (r"^\s*(?:\w+\s+)*def\s+(\w+)", "function")],
    "python": [(r"^\s*class\s+(\w+)", "class"), (r"^\s*(?:async\s+)?def\s+(\w+)", "function")],
}
GROUP = {"typescript": "js", "javascript": "js", "cpp": "c"}
VISIBLE: dict[str, Callable[[str, str], bool]] = {
    "js": lambda line, name: re.match(r"\s*(?:export\b|(?:module\.)?exports\.)", line) is not None,
    "go": lambda line, name: name[:1].isupper(),
    "python": lambda line, name: not name.startswith("_") or name.startswith("__"),
    "rust": lambda line, name: re.search(r"\bpub\b", line) is not None,
    "java": lambda line, name: re.search(r"\bpublic\b", line) is not None,
    "csharp": lambda line, name: re.search(r"\b(?:public|internal)\b", line) is not None,
    "kotlin": lambda line, name: re.search(r"\bprivate\b", line) is None,
    "swift": lambda line, name: re.search(r"\b(?:private|fileprivate)\b", line) is None,
    "php": lambda line, name: re.search(r"\bprivate\b", line) is None,
    "scala": lambda line, name: re.search(r"\bprivate\b", line) is None,
    "elixir": lambda line, name: re.match(r"\s*def(?:macro)?p\b", line) is None,
    "lua": lambda line, name: re.match(r"\s*local\b", line) is None,
}
#: A method that a script's class declares: a name and a list in brackets before the opening brace, and no callback.
_JS_METHOD = re.compile(rf"^\s+(?!(?:if|for|while|switch|catch|function|return|with|else|do|try)\b)(?:(?:public|private|protected|static|async|override|get|set)\s+)*[*#]?{_ID}\s*(?:<[^>]*>)?\((?!.*(?:=>|\bfunction\b)).*\)\s*(?::\s*[^{{]+)?\{{\s*\}}?\s*$")
_COMPILED = {g: [(re.compile(p), k) for p, k in rules] for g, rules in RULES.items()}
_BRACES = {"js", "go", "java", "rust", "csharp", "php", "swift", "kotlin", "c", "scala"}
#: Languages that other packages have added: extension to a function from content to symbols.
EXTRA: dict[str, Callable[[str], list[dict]]] = {}


def register_extractor(ext: str, extractor: Callable[[str], list[dict]]) -> None:
    """``extracted`` sends the function to the workers with the job."""
    EXTRA[ext] = extractor


@dataclass(frozen=True)
class Caps:
    """The most that is kept of one file; None keeps all. What a cap has cut is named in the row's column ``cut``."""

    symbols: int | None = None
    reexports: int | None = None
    calls: int | None = None
    idents: int | None = None
    imported: int | None = None


#: The caps of an index that is to have them.
CAPPED = Caps(K.MAX_SYMBOLS, K.MAX_REEXPORTS, K.MAX_CALLS, K.MAX_IDENTS, K.MAX_IDENTS)

_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_BLOCK = r"/\*.*?(?:\*/|\Z)|//[^\n]*"
#: What is no code, by language group: comments and strings.
_NO_CODE = {
    "js": re.compile(_BLOCK + "|" + _QUOTED, re.S),
    "python": re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|#[^\n]*|" + _QUOTED, re.S),
    "hash": re.compile("#[^\n]*|" + _QUOTED, re.S),
    "lua": re.compile(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*|" + _QUOTED, re.S),
    "quote": re.compile(_BLOCK + r"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S),
}
_COMMENTS = {"js": "js", "python": "python", "ruby": "hash", "shell": "hash", "elixir": "hash", "lua": "lua", "php": "js"}


def code_only(content: str, group: str) -> str:
    """The content with comments and strings blanked out, every line and column where it was."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    return _NO_CODE[_COMMENTS.get(group, "quote")].sub(blank, content)


def _end(lines: list[str], i: int, group: str) -> int | None:
    if group in _BRACES:
        depth = 0
        for j in range(i, len(lines)):
            for c in lines[j]:
                depth += (c == "{") - (c == "}")
                if c == "}" and depth == 0:
                    return j + 1
            if depth == 0 and (lines[j].rstrip().endswith(";") or j > i + 2):
                return i + 1
        return None
    own = len(lines[i]) - len(lines[i].lstrip())
    last = i
    for j in range(i + 1, len(lines)):
        if lines[j].strip():
            if len(lines[j]) - len(lines[j].lstrip()) <= own:
                return j + 1 if group in ("ruby", "lua", "elixir") and lines[j].strip() == "end" else last + 1
            last = j
    return last + 1


def _python(content: str) -> list[dict]:
    lines = content.split("\n")
    out: list[dict] = []

    def visit(body: list[ast.stmt], parent: str | None, depth: int) -> None:
        for n in body:
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if parent else "function"
                out.append({"name": n.name, "kind": kind, "line": n.lineno, "end_line": n.end_lineno, "parent": parent, "signature": lines[n.lineno - 1].strip()[: K.SIGNATURE], "exported": VISIBLE["python"]("", n.name)})
                if isinstance(n, ast.ClassDef) and depth == 0:
                    visit(n.body, n.name, 1)

    visit(ast.parse(content).body, None, 0)
    return out


def symbols(lang: str, ext: str, content: str, rel: str = "", extra: dict[str, Callable[[str], list[dict]]] | None = None) -> tuple[str, list[dict]]:
    """The tier that read the file and its symbols in order of lines."""
    try:
        extra = EXTRA if extra is None else extra
        if ext in extra:
            return "extra", extra[ext](content)
        if lang == "python":
            try:
                return "ast", _python(content)
            except (SyntaxError, ValueError, RecursionError):
                pass
        group = GROUP.get(lang, lang)
        rules = _COMPILED.get(group)
        if not rules:
            return "none", []
        lines = re.split(r"\r?\n", content)
        visible = VISIBLE.get(group, lambda line, name: True)
        out: list[dict] = []
        around: list[dict] = []
        for i, line in enumerate(lines):
            around = [x for x in around if i + 1 <= x["end_line"]]
            for p, kind in rules:
                if m := p.match(line):
                    name = m.group(m.lastindex or 0)
                    end = _end(lines, i, group)
                    out.append({"name": name, "kind": kind, "line": i + 1, "end_line": end, "parent": around[-1]["name"] if around else None, "signature": line.strip()[: K.SIGNATURE], "exported": visible(line, name)})
                    if end and kind in ("class", "struct", "module", "interface", "trait", "object", "namespace"):
                        around.append(out[-1])
                    break
        if group == "js":
            out = _js_exports(content, out, rel)
        return "regex", out
    except Exception:  # noqa: BLE001 a file that cannot be read has no symbols
        return "failed", []


def _names(listed: str) -> list[tuple[str, str]]:
    """(local name, name outside) of a list such as ``a, b as c`` or ``a, b: c``."""
    out = []
    for item in filter(None, (x.strip() for x in listed.split(","))):
        if ":" in item:
            new, _, old = (x.strip() for x in item.partition(":"))
        else:
            old, _, new = (x.strip().removeprefix("type ") for x in item.partition(" as "))
        out.append((old, new or old))
    return out


def _js_exports(content: str, out: list[dict], rel: str) -> list[dict]:
    """Marks what export lists and exported objects name, and adds re-exports and default exports without a name."""
    names: set[str] = set()
    more: list[dict] = []
    local = {s["name"]: s for s in out}
    line_of = lambda m: content.count("\n", 0, m.start()) + 1
    entry = lambda m, name, kind: {"name": name, "kind": kind, "line": line_of(m), "end_line": None, "parent": None, "signature": m.group().strip()[: K.SIGNATURE], "exported": True}
    for m in re.finditer(r"export\s*(?:type\s*)?\{([^}]*)\}\s*(from\s*['\"]([^'\"]+)['\"])?", content):
        for old, new in _names(m.group(1)):
            if m.group(2):
                more.append(entry(m, new, "reexport"))
            elif new == old or old not in local:
                names.add(old)
            else:
                more.append(local[old] | {"name": new, "exported": True})
    for m in re.finditer(r"export\s*\*\s*(?:as\s+([\w$]+)\s+)?from\s*['\"]([^'\"]+)['\"]", content):
        more.append(entry(m, m.group(1) or m.group(2), "reexport-all"))
    for m in re.finditer(r"\bmodule\.exports\s*=\s*\{([^}]*)\}", content):
        names.update(x for pair in _names(m.group(1)) for x in pair)
    if m := re.search(r"\bmodule\.exports\s*=\s*([A-Za-z_$][\w$]*)\s*;?\s*$", content, re.M):
        names.add(m.group(1))
    for m in re.finditer(r"(?m)^\s*export\s+default\s+(?:(?:async\s+)?(?:function|class)\b\s*\*?\s*(?=[({]|extends\b)|[({\[]|async\s*\(|[\w$]+\s*=>)", content):
        more.append(entry(m, re.sub(r"\.[^.]+$", "", rel.split("/")[-1]) or "default", "default"))
    names |= {s["name"] for s in out if s["kind"] == "default"}
    out = [s | {"exported": s["exported"] or s["name"] in names} for s in out]
    return out + [m for m in more if m["name"] not in local or m["kind"] != "reexport"]


def use_group(path: str, most: int = 16) -> list[str]:
    """a::{b, c::{d, e}} as single paths."""
    open_at = path.find("{")
    if open_at < 0:
        return [path.strip()]
    depth, parts, start = 0, [], open_at + 1
    for i in range(open_at, len(path)):
        if path[i] == "{":
            depth += 1
        elif path[i] == "}":
            depth -= 1
            if depth == 0:
                parts.append(path[start:i])
                break
        elif path[i] == "," and depth == 1:
            parts.append(path[start:i])
            start = i + 1
    head = path[:open_at].strip()
    inner = [head.removesuffix("::") if part.strip() == "self" else p for part in parts if part.strip() for p in use_group(head + part.strip(), most)]
    return inner[:most]


def imports(lang: str, content: str) -> list[str]:
    """The specifiers a file imports, once each, in order."""
    found: list[str] = []
    add = lambda pattern, text=content, group=1: found.extend(m.group(group) for m in re.finditer(pattern, text, re.M))
    group = GROUP.get(lang, lang)
    if group == "js":
        add(r"""(?:import|export)\s[^'"`;]*?from\s*['"]([^'"]+)['"]""")
        add(r"""^\s*import\s*['"]([^'"]+)['"]""")
        add(r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)""")
        add(r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""")
    elif group == "python":
        add(r"^\s*from\s+(\.*[\w.]*)\s+import\b")
        for m in re.finditer(r"^\s*import\s+([\w., ]+?)(?:\s*#.*)?$", content, re.M):
            found += [x.split(" as ")[0].strip() for x in m.group(1).split(",")]
    elif group == "go":
        add(r"""^import\s+(?:[\w.]+\s+)?"([^"]+)\"""")
        for m in re.finditer(r"^import\s*\(([^)]*)\)", content, re.M):
            add(r'"([^"]+)"', m.group(1))
    elif group == "rust":
        add(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;")
        for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", content, re.M):
            found += [p.split(" as ")[0].strip() for p in use_group(" ".join(m.group(1).split()))]
    elif group in ("java", "kotlin", "scala"):
        add(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)")
    elif group == "ruby":
        add(r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]""")
    elif group == "c":
        add(r"""^\s*#\s*include\s*"([^"]+)\"""")
    elif group == "php":
        add(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)")
        add(r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""")
    elif group == "csharp":
        add(r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;")
    return list(dict.fromkeys(x for x in found if x))


_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(?:\.|::|->)\s*)?([A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = set("default import defer go select if for while switch catch return function func def fn class new typeof sizeof await elif else in not and or with assert match when until unless foreach lambda print".split())
_INTRODUCES = re.compile(r"\b(?:function|func|def|fn|class|fun|sub)\s*\*?\s*$")
#: In C a name behind a type at the left margin, with nothing but a list in brackets before the semicolon, is declared.
_DECLARES = re.compile(r"^(?!return\b|else\b|goto\b|case\b)[A-Za-z_][\w\s*&:<>,]*[\s*&]([A-Za-z_]\w*)\s*\([^{}]*\)\s*(?:const\s*)?;\s*$")


def _python_calls(content: str) -> list[tuple[str, int, str | None]]:
    out = []
    for n in ast.walk(ast.parse(content)):
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.append((f.id, n.lineno, None))
            elif isinstance(f, ast.Attribute):
                v = f.value
                out.append((f.attr, n.lineno, v.id if isinstance(v, ast.Name) else v.attr if isinstance(v, ast.Attribute) else None))
    return out


def calls(lang: str, content: str, defined: list[dict]) -> list[dict]:
    """Call sites (name, line, receiver), a name once a line, in order of lines; keywords, definitions and what is no code are left out."""
    seen: dict[tuple[str, int], str | None] = {}
    group = GROUP.get(lang, lang)
    if lang == "python":
        try:
            for name, i, receiver in _python_calls(content):
                if len(name) >= 2:
                    seen.setdefault((name, i), receiver)
            return [{"name": n, "line": i, "receiver": r} for (n, i), r in sorted(seen.items(), key=lambda x: (x[0][1], x[0][0]))]
        except (SyntaxError, ValueError, RecursionError):
            seen.clear()
    own = {(s["name"], s["line"]) for s in defined}
    for i, line in enumerate(re.split(r"\r?\n", code_only(content, group)), 1):
        declared = _DECLARES.match(line) if group == "c" else _JS_METHOD.match(line) if group == "js" else None
        for m in _CALL.finditer(line):
            name = m.group(2)
            if len(name) >= 2 and name not in _NO_CALL and (name, i) not in own and not _INTRODUCES.search(line[: m.start(2)]) and not (declared and declared.group(1) == name):
                seen.setdefault((name, i), m.group(1))
    rows = [{"name": n, "line": i, "receiver": r} for (n, i), r in seen.items()]
    return sorted(rows, key=lambda c: (c["line"], c["name"]))


def identifiers(lang: str, content: str, defined: list[dict]) -> list[str]:
    """Names of five letters and more that the file's code uses and does not define, sorted."""
    own = {s["name"] for s in defined}
    return sorted({x for x in re.findall(r"[A-Za-z_$][\w$]{4,}", code_only(content, GROUP.get(lang, lang))) if x not in own})


def imported_names(lang: str, content: str) -> list[str]:
    """What a script or a Python file imports by name, under the name it has there, sorted."""
    found: set[str] = set()
    if GROUP.get(lang, lang) == "js":
        for m in re.finditer(r"\bimport\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\b", content):
            found |= {old for old, _ in _names(m.group(1))}
    elif lang == "python":
        for m in re.finditer(r"(?m)^\s*from\s+[\w.]+\s+import\s+(?:\(([^)]*)\)|([^\n#]+))", content):
            found |= {x.split(" as ")[0].strip() for x in (m.group(1) or m.group(2)).split(",")} - {"", "*"}
    return sorted(found)


def summary(content: str) -> str | None:
    """The first sentence of the first comment in the first 40 lines, without directives and licences."""
    words: list[str] = []
    for line in content.split("\n")[:40]:
        s = line.strip()
        m = re.match(r"^(?:///?|#(?!!|\s*(?:include|define|undef|if|ifdef|ifndef|else|endif|pragma|import)\b)|/\*\*?|\*(?!/)|--|\"\"\"|''')\s?(.*)$", s)
        if not m:
            if words or s and not s.startswith(("#!", "'use", '"use', "package ", "<?php")):
                break
            continue
        t = re.sub(r"\*/$|\"\"\"$|'''$", "", m.group(1)).strip()
        if re.match(r"(?i)^(?:eslint|tslint|prettier|@ts-|@flow|jshint|pylint|noqa|type:|go:build|\+build|pragma|copyright|license|licensed|spdx|@license|all rights reserved|-\*-)", t):
            if words:
                break
            continue
        if not t:
            if words:
                break
            continue
        words.append(t)
    text = " ".join(words)
    first = re.match(r"(.+?[.!?])(?:\s|$)", text)
    text = (first.group(1) if first else text)[:200].strip()
    return text if len(text) >= 8 else None


def markdown(content: str) -> dict:
    """Title, headings, summary and local links of a markdown text; fenced code counts for nothing."""
    title, lines = None, content.split("\n")
    if lines and lines[0].strip() == "---" and (end := next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)):
        for x in lines[1:end]:
            if m := re.match(r"title:\s*[\"']?(.*?)[\"']?\s*$", x):
                title = m.group(1)
        lines = lines[end + 1 :]
    fence, plain = None, []
    for x in lines:
        m = re.match(r"^\s{0,3}(`{3,}|~{3,})", x)
        if m and (fence is None or m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence)):
            fence = m.group(1) if fence is None else None
            plain.append("")
        else:
            plain.append("" if fence else x)
    headings, said, second = [], None, False
    for x in plain:
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", x):
            headings.append(m.group(2))
            title = title or (m.group(2) if len(m.group(1)) == 1 else None)
            second = second or len(m.group(1)) == 2
        elif not said and not second and x.strip() and not re.match(r"^\s*(?:[-*+>|<!\[]|\d+\.)", x):
            said = x.strip()[:200]
    links = [m.group(1).split("#")[0] for m in re.finditer(r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+)", "\n".join(plain))]
    local = [x for x in dict.fromkeys(links) if x and not re.match(r"^(?:[a-z][a-z0-9+.-]*:|//|#)", x, re.I)]
    return {"title": title, "headings": headings, "summary": said, "links": local}


SCHEMA = (
    "rel string, lang string, tier string, title string, summary string, pkg string, "
    "symbols array<struct<name:string,kind:string,line:int,end_line:int,parent:string,signature:string,exported:boolean>>, "
    "refs array<struct<kind:string,spec:string>>, calls array<struct<name:string,line:int,receiver:string>>, idents array<string>, imported array<string>, headings array<string>, cut array<string>"
)


_COLUMNS = ["rel", "lang", "tier", "title", "summary", "pkg", "symbols", "refs", "calls", "idents", "imported", "headings", "cut"]


def extract(rel: str, ext: str, content: str, caps: Caps = Caps(), extra: dict[str, Callable[[str], list[dict]]] | None = None) -> dict:
    """All that is taken from one file; ``cut`` names the lists of which ``caps`` has left something out."""
    lang = K.LANGUAGE_OF.get(ext, "other")
    row = dict.fromkeys(_COLUMNS) | {"rel": rel, "lang": lang, "tier": "none"} | {c: [] for c in _COLUMNS[6:]}
    if lang == "markdown":
        m = markdown(content)
        return row | {"title": m["title"], "summary": m["summary"], "headings": m["headings"], "refs": [{"kind": "doc-link", "spec": x} for x in m["links"]]}
    if lang in K.NOT_CODE and ext not in (EXTRA if extra is None else extra):
        return row
    tier, own = symbols(lang, ext, content, rel, extra)
    pkg = re.search(r"(?m)^\s*(?:package|namespace)\s+([\w.]+)\s*[;{]?", content) if lang in ("java", "csharp", "kotlin") else None
    again = [s for s in own if s["kind"] in ("reexport", "reexport-all")]
    first = [s for s in own if s["kind"] not in ("reexport", "reexport-all")]
    lists = {"symbols": first, "reexports": again, "calls": calls(lang, content, own), "idents": identifiers(lang, content, own), "imported": imported_names(lang, content)}
    kept = {k: v if getattr(caps, k) is None else v[: getattr(caps, k)] for k, v in lists.items()}
    kept["symbols"] = kept["symbols"] + kept.pop("reexports")
    cut = [k for k, v in lists.items() if getattr(caps, k) is not None and len(v) > getattr(caps, k)]
    return row | kept | {"tier": tier, "summary": summary(content), "pkg": pkg.group(1) if pkg else None, "refs": [{"kind": "import", "spec": x} for x in imports(lang, content)], "cut": cut}


def extracted(texts: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """One row for each text (rel, ext, content) with all that is taken from it."""
    extra = dict(EXTRA)  # goes to the workers with the function below

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([extract(r, e or "", c or "", caps, extra) for r, e, c in zip(b["rel"], b["ext"], b["content"])], columns=_COLUMNS)

    return texts.select("rel", "ext", "content").mapInPandas(run, SCHEMA)


def child(rows: DataFrame, column: str) -> DataFrame:
    """A child table (file, pos, ...) of an array column."""
    x = rows.select(F.col("rel").alias("file"), F.posexplode(column).alias("pos", "v"))
    return x.select("file", "pos", "v.*") if "struct" in dict(rows.dtypes)[column] else x
