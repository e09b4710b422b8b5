"""Packages of a monorepo from its manifests, their dependencies, cycles and order. Bounded by the number of manifests."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .graph import topological
from .resolve import jsonc, toml

SKIP = re.compile(r"(^|/)(\.[^/]+|node_modules|dist|build|target|vendor)(/|$)")
DEPTH = 4


def _matches(pattern: str, folders: Iterable[str]) -> set[str]:
    deep = "**" in pattern
    regex = re.escape(pattern.strip("/").removeprefix("./")).replace(r"\*\*", ".+").replace(r"\*", "[^/]+").replace(r"\?", "[^/]")
    return {f for f in folders if re.fullmatch(regex, f) and not SKIP.search(f) and (not deep or f.count("/") <= DEPTH + pattern.count("/"))}


def _patterns(manifests: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, pattern) of all members that the root manifests name; a leading ! takes away."""
    out: list[tuple[str, str]] = []
    add = lambda kind, values: out.extend((kind, v) for v in values or [] if isinstance(v, str))
    root = jsonc(manifests.get("package.json", ""))
    ws = root.get("workspaces")
    add("npm", ws.get("packages") if isinstance(ws, dict) else ws)
    if t := manifests.get("pnpm-workspace.yaml"):
        block = re.search(r"(?ms)^packages:\s*\n((?:\s+-.*\n?|\s*#.*\n?)+)", t)
        add("pnpm", re.findall(r"""-\s*['"]?([^'"\n#]+?)['"]?\s*(?:#.*)?$""", block.group(1), re.M) if block else [])
    if not out:
        add("lerna", jsonc(manifests.get("lerna.json", "")).get("packages"))
    if not out and "nx.json" in manifests:
        add("nx", [posixpath.dirname(p) for p in manifests if posixpath.basename(p) == "project.json" and posixpath.dirname(p)])
    add("cargo", toml(manifests.get("Cargo.toml", "")).get("workspace", {}).get("members"))
    if t := manifests.get("go.work"):
        add("go", [x.removeprefix("./") for x in re.findall(r"(?m)^\s*(?:use\s+)?(\./[\w./-]+)", t)])
    if t := manifests.get("pom.xml"):
        add("maven", re.findall(r"<module>\s*([^<]+?)\s*</module>", t))
    add("uv", toml(manifests.get("pyproject.toml", "")).get("tool.uv.workspace", {}).get("members"))
    add("composer", [r.get("url") for r in jsonc(manifests.get("composer.json", "")).get("repositories", []) if isinstance(r, dict) and r.get("type") == "path"])
    for name in ("settings.gradle", "settings.gradle.kts"):
        add("gradle", [x.strip(":").replace(":", "/") for x in re.findall(r"""['"](:?[\w:./-]+)['"]""", " ".join(re.findall(r"include\s*\(?([^)\n]+)", manifests.get(name, ""))))])
    return out


def _probe(folder: str, manifests: dict[str, str]) -> dict | None:
    """Name, kind and needs of the package in a folder, by the first manifest found there."""
    at = lambda n: manifests.get(posixpath.join(folder, n))
    if (t := at("package.json")) is not None:
        m = jsonc(t)
        needs = {k for f in ("dependencies", "devDependencies", "peerDependencies") for k in m.get(f, {})}
        return {"name": m.get("name") or folder, "kind": "npm", "manifest": "package.json", "needs": needs, "description": m.get("description")}
    if (t := at("Cargo.toml")) is not None:
        s = toml(t)
        needs = {k for f in ("dependencies", "dev-dependencies", "build-dependencies") for k in s.get(f, {})}
        return {"name": s.get("package", {}).get("name") or folder, "kind": "cargo", "manifest": "Cargo.toml", "needs": needs, "description": s.get("package", {}).get("description")}
    if (t := at("go.mod")) is not None:
        m = re.search(r"(?m)^module\s+(\S+)", t)
        return {"name": m.group(1) if m else folder, "kind": "go", "manifest": "go.mod", "needs": set(re.findall(r"(?m)^\s*(?:require\s+)?([\w./-]+)\s+v\S+", t)), "description": None}
    if (t := at("pyproject.toml")) is not None:
        s = toml(t)
        deps = s.get("project", {}).get("dependencies") or []
        return {"name": s.get("project", {}).get("name") or folder, "kind": "uv", "manifest": "pyproject.toml", "needs": {re.split(r"[\s\[<>=!~;]", d)[0] for d in deps}, "description": s.get("project", {}).get("description")}
    if (t := at("pom.xml")) is not None:
        own = re.sub(r"(?s)<(parent|dependencies|build)>.*?</\1>", "", t)
        m = re.search(r"<artifactId>\s*([^<]+?)\s*</artifactId>", own)
        return {"name": m.group(1) if m else folder, "kind": "maven", "manifest": "pom.xml", "needs": set(re.findall(r"(?s)<dependency>.*?<artifactId>\s*([^<]+?)\s*</artifactId>", t)), "description": None}
    if (t := at("composer.json")) is not None:
        m = jsonc(t)
        return {"name": m.get("name") or folder, "kind": "composer", "manifest": "composer.json", "needs": {k for f in ("require", "require-dev") for k in m.get(f, {})}, "description": m.get("description")}
    for n in ("build.gradle", "build.gradle.kts"):
        if (t := at(n)) is not None:
            needs = {x.strip(":").replace(":", "/") for x in re.findall(r"""project\s*\(\s*(?:path\s*:\s*)?['"]([^'"]+)['"]""", t)}
            return {"name": folder, "kind": "gradle", "manifest": n, "needs": needs, "description": None}
    return None


def workspaces(spark: SparkSession, manifests: dict[str, str], folders: set[str]) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Packages (name, dir, kind, manifest, description), their edges (src, dst), the order of building, a cycle or []."""
    dirs: set[str] = set()
    patterns = _patterns(manifests)
    for _, p in patterns:
        if not p.startswith("!"):
            dirs |= _matches(p, folders)
    for _, p in patterns:
        if p.startswith("!"):
            dirs -= _matches(p[1:], folders)
    found = {d: m for d in sorted(dirs) if (m := _probe(d, manifests))}
    by_name = {str(m["name"]): d for d, m in found.items()} | {d: d for d in found}
    needs = {str(m["name"]): {str(found[by_name[n]]["name"]) for n in m["needs"] if n in by_name} - {str(m["name"])} for m in found.values()}
    packages = spark.createDataFrame([(str(m["name"]), d, m["kind"], m["manifest"], m["description"]) for d, m in found.items()], "name string, dir string, kind string, manifest string, description string")
    links = spark.createDataFrame(sorted((a, b) for a, bs in needs.items() for b in bs), "src string, dst string")
    return packages, links, topological(sorted(needs), needs), first_cycle(needs)


def first_cycle(needs: dict[str, set[str]]) -> list[str]:
    """The first cycle that a search in order of names meets."""
    done: set[str] = set()
    for start in sorted(needs):
        path, stack = [], [(start, iter(sorted(needs.get(start, ()))))]
        path.append(start)
        while stack:
            v, it = stack[-1]
            w = next(it, None)
            if w is None:
                done.add(v)
                stack.pop()
                path.pop()
            elif w in path:
                return path[path.index(w) :] + [w]
            elif w not in done:
                path.append(w)
                stack.append((w, iter(sorted(needs.get(w, ())))))
    return []
