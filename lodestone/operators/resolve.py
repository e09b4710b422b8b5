"""Imports and document links to files: candidate paths in order of priority, then one equi-join with the files.

What the manifests of a tree say is small and bounded by their number; it is gathered on the driver into a Context
and sent with the function that makes candidates. Which candidates exist is found by the join alone.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

#: What is tried, in order, for a path without an ending, for a folder, for a built file; where built
#: files lie; and the conditions of a package's exports in order of preference.
JS_ENDINGS = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".json"]
JS_INDEX = ["index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.d.ts"]
JS_OUTPUT = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
BUILT = ["dist", "build", "lib", "out", "output", "esm", "cjs", "umd"]
CONDITIONS = ["types", "import", "module", "default", "require", "node"]


def jsonc(text: str) -> dict:
    """JSON with comments and trailing commas, which strings may contain; {} if it cannot be read."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else n
        elif c == "," and re.match(r",\s*[}\]]", re.sub(r"//[^\n]*|/\*.*?\*/", "", text[i : i + 400], flags=re.S)):
            i += 1
        else:
            out.append(c)
            i += 1
    try:
        got = json.loads("".join(out))
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def toml(text: str) -> dict[str, dict[str, object]]:
    """Sections of a TOML text with their strings and lists of strings."""
    out: dict[str, dict[str, object]] = {"": {}}
    section = ""
    for line in re.sub(r"\[\s*((?:\"[^\"]*\"\s*,?\s*)*)\]", lambda m: "[" + " ".join(m.group(1).split()) + "]", text).split("\n"):
        if m := re.match(r"^\s*\[+([^\]]+)\]+\s*$", line):
            section = m.group(1).strip()
            out.setdefault(section, {})
        elif m := re.match(r"^\s*\"?([\w.-]+)\"?\s*=\s*(.+?)\s*$", line):
            v = m.group(2)
            out[section][m.group(1)] = re.findall(r'"([^"]*)"', v) if v.startswith("[") else (re.findall(r'"([^"]*)"', v) or [v])[0] if not v.startswith("{") else dict(re.findall(r'([\w-]+)\s*=\s*"([^"]*)"', v))
    return out


@dataclass
class Context:
    """What manifests say: aliases by folder, packages by name, modules, crates, roots, namespaces."""

    aliases: list[tuple[str, str, str, list[str]]] = field(default_factory=list)  # folder, prefix, suffix, targets
    packages: dict[str, tuple[str, dict]] = field(default_factory=dict)  # name: folder, manifest
    go: list[tuple[str, str]] = field(default_factory=list)  # module path, folder
    crates: dict[str, str] = field(default_factory=dict)  # name: folder of src
    java: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)
    ruby: list[str] = field(default_factory=list)
    psr4: list[tuple[str, str]] = field(default_factory=list)


#: Folders by whose name a path in an import may begin there.
ROOTS = r"(^|/)src/(main|test)/(java|kotlin|scala)$|(^|/)(include|inc|src|lib)$"


def context(manifests: dict[str, str], folders: set[str] | None = None) -> Context:
    """The context of a tree from the contents of its manifests (path: text) and its folders."""
    c = Context()
    read: dict[str, dict] = {p: jsonc(t) for p, t in manifests.items() if p.endswith(".json")}
    for p, t in manifests.items():
        name, folder = posixpath.basename(p), posixpath.dirname(p)
        if re.fullmatch(r"[tj]sconfig[\w.-]*\.json", name):
            at, seen = p, set()
            base = targets = None
            while at in read and at not in seen:
                seen.add(at)
                o = read[at].get("compilerOptions", {})
                if targets is None and "paths" in o:
                    targets = (posixpath.normpath(posixpath.join(posixpath.dirname(at), o.get("baseUrl", "."))), o["paths"])
                if base is None and "baseUrl" in o:
                    base = posixpath.normpath(posixpath.join(posixpath.dirname(at), o["baseUrl"]))
                up = read[at].get("extends")
                at = posixpath.normpath(posixpath.join(posixpath.dirname(at), up if str(up).endswith(".json") else f"{up}.json")) if isinstance(up, str) and up.startswith(".") else ""
            if targets:
                root = "" if targets[0] == "." else targets[0]
                for key, goals in targets[1].items():
                    pre, star, post = key.partition("*")
                    c.aliases.append((folder, pre, post if star else "\0", [posixpath.join(root, g) for g in goals]))
            elif base is not None:
                c.aliases.append((folder, "", "", [posixpath.join("" if base == "." else base, "*")]))
        elif name == "package.json" and read[p].get("name"):
            c.packages[read[p]["name"]] = (folder, read[p])
        elif name == "go.mod" and (m := re.search(r"(?m)^module\s+(\S+)", t)):
            c.go.append((m.group(1), folder))
            for old, new in re.findall(r"(?m)^(?:replace\s+)?\s*(\S+)(?:\s+v\S+)?\s+=>\s+(\.\S*)", t):
                c.go.append((old, posixpath.normpath(posixpath.join(folder, new))))
        elif name == "Cargo.toml" and (crate := toml(t).get("package", {}).get("name")):
            c.crates[str(crate).replace("-", "_")] = posixpath.join(folder, "src")
        elif name == "composer.json":
            for part in ("autoload", "autoload-dev"):
                for ns, d in (read[p].get(part, {}).get("psr-4", {}) or {}).items():
                    c.psr4 += [(ns, posixpath.join(folder, x).rstrip("/")) for x in ([d] if isinstance(d, str) else d)]
    for d in sorted(folders or (), key=len):
        if re.search(r"(^|/)src/(main|test)/(java|kotlin|scala)$", d):
            c.java.append(d)
        if posixpath.basename(d) in ("include", "inc", "src"):
            c.includes.append(d)
        if posixpath.basename(d) == "lib":
            c.ruby.append(d)
    c.aliases.sort(key=lambda a: (-len(a[0]), -len(a[1])))
    c.go.sort(key=lambda g: -len(g[0]))
    c.psr4.sort(key=lambda x: -len(x[0]))
    return c


def _js_probes(path: str) -> list[str]:
    out = [path + e for e in JS_ENDINGS] + [f"{path}/{i}" for i in JS_INDEX]
    stem, ext = posixpath.splitext(path)
    return out + [stem + e for e in JS_OUTPUT.get(ext, [])]


def _sources(path: str) -> list[str]:
    """Where the source of a built file may lie."""
    parts = path.split("/")
    out = [path]
    for i, p in enumerate(parts):
        if p in BUILT:
            rest = "/".join(parts[i + 1 :])
            out += ["/".join([*parts[:i], "src", rest]), "/".join([*parts[:i], rest])]
    return [q for p in out for q in (p, re.sub(r"(\.d)?\.[cm]?[jt]sx?$", "", p))]


def exports(manifest: dict, sub: str, most: int = 8) -> list[str]:
    """The files that a package's manifest gives for a path inside it (. for the package itself)."""

    def leaves(x: object) -> list[str]:
        if isinstance(x, str):
            return [x]
        if isinstance(x, list):
            return [y for v in x for y in leaves(v)]
        if isinstance(x, dict):
            keys = [k for k in CONDITIONS if k in x] + [k for k in x if k not in CONDITIONS]
            return [y for k in keys for y in leaves(x[k])]
        return []

    e = manifest.get("exports")
    if isinstance(e, dict) and any(k.startswith(".") for k in e):
        if sub in e:
            return leaves(e[sub])[:most]
        for key in sorted((k for k in e if "*" in k), key=len, reverse=True):
            pre, _, post = key.partition("*")
            if sub.startswith(pre) and sub.endswith(post) and len(sub) >= len(pre) + len(post):
                return [x.replace("*", sub[len(pre) : len(sub) - len(post) or None]) for x in leaves(e[key])][:most]
        return []
    if sub == ".":
        return (leaves(e) + [manifest[k] for k in ("types", "module", "main") if isinstance(manifest.get(k), str)])[:most]
    return []


def _join(base: str, rest: str) -> str | None:
    p = posixpath.normpath(posixpath.join(base, rest))
    return None if p.startswith("..") else "" if p == "." else p


def candidates(lang: str, kind: str, file: str, spec: str, c: Context) -> tuple[list[str], str, str | None]:
    """Paths to try in order, and what a miss means: external, or dangling with a reason."""
    here = posixpath.dirname(file)
    if kind == "doc-link":
        p = _join("" if spec.startswith("/") else here, spec.lstrip("/"))
        if p is None:
            return [], "dangling", "escapes-repo-root"
        return [p, f"{p}.md", f"{p}.mdx", f"{p}/README.md", f"{p}/readme.md", f"{p}/index.md", f"{p}/index.mdx"], "dangling", "missing-target"
    if lang in ("javascript", "typescript", "vue", "svelte"):
        if spec.startswith("."):
            p = _join(here, spec)
            return ([], "dangling", "escapes-repo-root") if p is None else (_js_probes(p), "dangling", "missing-module")
        out: list[str] = []
        hit = False
        for folder, pre, post, targets in c.aliases:
            if folder and not (here + "/").startswith(folder + "/"):
                continue
            exact = post == "\0"
            if spec == pre if exact else spec.startswith(pre) and spec.endswith(post) and len(spec) >= len(pre) + len(post):
                star = "" if exact else spec[len(pre) : len(spec) - len(post) or None]
                for t in targets:
                    out += _js_probes(t.replace("*", star))
                hit = hit or bool(pre)
                break
        for name in sorted(c.packages, key=len, reverse=True):
            if spec == name or spec.startswith(name + "/"):
                folder, manifest = c.packages[name]
                rest = spec[len(name) + 1 :]
                goals = exports(manifest, f"./{rest}" if rest else ".")
                for g in goals:
                    for s in _sources(g.removeprefix("./")):
                        out += _js_probes(posixpath.join(folder, s))
                out += [q for s in ([rest, f"src/{rest}"] if rest else ["src/index", "index"]) for q in _js_probes(posixpath.join(folder, s))]
                return out, "dangling", "missing-package"
        return out, "dangling" if hit else "external", "alias-unresolved" if hit else None
    if lang == "python":
        dots = len(spec) - len(spec.lstrip("."))
        rest = spec[dots:].replace(".", "/")
        base = here
        for _ in range(dots - 1):
            base = posixpath.dirname(base)
        p = posixpath.join(base if dots else "", rest).rstrip("/")
        probes = [f"{p}.py", f"{p}.pyi", f"{p}/__init__.py"] if rest else [f"{p}/__init__.py" if p else "__init__.py"]
        if dots:
            return probes, "dangling", "missing-module"
        return [*probes, *(f"src/{x}" for x in probes), *(posixpath.join(here, x) for x in probes)], "external", None
    if lang == "go":
        for module, folder in c.go:
            if spec == module or spec.startswith(module + "/"):
                return [f"\0dir:{posixpath.normpath(posixpath.join(folder, spec[len(module) + 1 :]))}:.go"], "dangling", "missing-package"
        return [], "external", None
    if lang == "rust":
        parts = spec.split("::")
        crate = next((s for s in c.crates.values() if (here + "/").startswith(s + "/")), here)
        stem = posixpath.splitext(posixpath.basename(file))[0]
        own = here if stem in ("mod", "lib", "main") else posixpath.join(here, stem)
        if len(parts) == 1 and parts[0] not in ("crate", "self", "super"):
            roots, rest = [own], parts
        elif parts[0] == "crate":
            roots, rest = [crate], parts[1:]
        elif parts[0] == "self":
            roots, rest = [own], parts[1:]
        elif parts[0] == "super":
            up = own
            while parts and parts[0] == "super":
                up, parts = posixpath.dirname(up), parts[1:]
            roots, rest = [up], parts
        elif parts[0] in c.crates:
            roots, rest = [c.crates[parts[0]]], parts[1:]
        else:
            return [], "external", None
        out = []
        for r in roots:
            for n in range(len(rest), 0, -1):
                p = posixpath.join(r, *rest[:n])
                out += [f"{p}.rs", f"{p}/mod.rs"]
            out += [f"{r}/lib.rs", f"{r}/main.rs", f"{r}/mod.rs", f"{r}.rs"]
        return out, "dangling", "missing-module"
    if lang in ("java", "kotlin", "scala"):
        parts = spec.split(".")
        roots = [*c.java, ""]
        if parts[-1] == "*":
            return [f"\0dir:{posixpath.join(r, *parts[:-1])}:.{e}" for r in roots for e in ("java", "kt")], "external", None
        return [posixpath.join(r, *parts[:n]) + e for n in range(len(parts), 1, -1) for r in roots for e in (".java", ".kt", ".scala")], "external", None
    if lang in ("c", "cpp"):
        return [p for b in [here, *c.includes, ""] if (p := _join(b, spec))], "dangling", "missing-include"
    if lang == "ruby":
        s = spec if spec.endswith(".rb") else f"{spec}.rb"
        return [p for b in [here, *c.ruby, ""] if (p := _join(b, s))], "dangling" if spec.startswith(".") else "external", "missing-module" if spec.startswith(".") else None
    if lang == "php":
        if "\\" not in spec and ("/" in spec or spec.endswith(".php")):
            return [p for b in (here, "") if (p := _join(b, spec))], "dangling", "missing-include"
        for ns, folder in c.psr4:
            if spec.startswith(ns):
                return [posixpath.join(folder, spec[len(ns) :].replace("\\", "/")) + ".php"], "dangling", "missing-module"
        return [], "external", None
    if lang == "csharp":
        return [f"\0ns:{spec}", f"\0under:{spec}"], "external", None
    return [], "external", None


def resolve(refs: DataFrame, files: DataFrame, manifests: Context, namespaces: DataFrame | None = None) -> DataFrame:
    """Each ref (file, pos, lang, kind, spec) with its resolution: resolved and a target, external, or dangling and a reason.

    ``files``: rel. A package of a folder is the first file of it by name; a namespace (namespaces: pkg, rel) the
    first file that declares it, or one under it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, p, lang, k, s in zip(b["file"], b["pos"], b["lang"], b["kind"], b["spec"]):
                paths, miss, reason = candidates(lang, k, f, s, manifests)
                rows.append((f, p, k, s, list(dict.fromkeys(paths)), miss, reason))
            yield pd.DataFrame(rows, columns=["file", "pos", "kind", "spec", "paths", "miss", "reason"])

    made = refs.select("file", "pos", "lang", "kind", "spec").mapInPandas(run, "file string, pos int, kind string, spec string, paths array<string>, miss string, reason string")
    tried = made.select("file", "pos", "kind", F.posexplode("paths").alias("prio", "path"))
    exact = files.select(F.col("rel").alias("path"), F.col("rel").alias("target")).distinct()
    folder = F.regexp_extract("rel", "^(.*)/[^/]*$", 1)
    firsts = files.select("rel", F.concat(F.lit("\0dir:"), F.when(folder == "", ".").otherwise(folder), F.lit(":"), F.regexp_extract("rel", r"(\.[^./]+)$", 1)).alias("path")).groupBy("path").agg(F.min("rel").alias("target"))
    known = exact.unionByName(firsts)
    if namespaces is not None:
        known = known.unionByName(namespaces.groupBy(F.concat(F.lit("\0ns:"), F.col("pkg")).alias("path")).agg(F.min("rel").alias("target")))
        parts = F.split("pkg", r"\.")
        above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")))
        under = namespaces.select("rel", above.alias("ns"))
        known = known.unionByName(under.groupBy(F.concat(F.lit("\0under:"), F.col("ns")).alias("path")).agg(F.min("rel").alias("target")))
    best = tried.join(known, "path").groupBy("file", "pos", "kind").agg(F.min_by("target", "prio").alias("target"))
    out = made.join(best, ["file", "pos", "kind"], "left")
    state = F.when(F.col("target").isNotNull(), "resolved").otherwise(F.col("miss"))
    return out.select("file", "pos", "kind", "spec", state.alias("state"), "target", F.when(state == "dangling", F.col("reason")).alias("reason"))
