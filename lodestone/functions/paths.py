"""Columns over paths: parts, kinds, roles, tests, tiers, entry points, globs and ignore rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def base(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def directory(rel: Column) -> Column:
    return F.when(rel.contains("/"), F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(K.ROOT))


def extension(rel: Column) -> Column:
    """The last dot and what follows in the base name, in lower case; empty for none and for dot files."""
    return F.lower(F.regexp_extract(base(rel), r"[^.](\.[^.]*)$", 1))


def ancestors(rel: Column) -> Column:
    """All folders above a path, the nearest first, the root as an empty string last."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def normal(path: Column) -> Column:
    """A path without . and .. parts; null if it leaves the root."""
    step = lambda acc, p: (
        F.when(acc.isNull() | (p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step, lambda acc: F.array_join(acc, "/"))


def language(ext: Column) -> Column:
    pairs = [F.lit(x) for e, lang in K.LANGUAGE_OF.items() for x in (e, lang)]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("other"))


def is_code(ext: Column) -> Column:
    return ~language(ext).isin(K.NOT_CODE)


def classify(rel: Column, ext: Column) -> Column:
    name = F.lower(base(rel))
    doc = ext.isin(K.DOC_EXTENSIONS) | name.rlike(K.DOC_BASENAME) | rel.rlike(K.DOC_DIR)
    return F.when(is_code(ext), "code").when(doc, "doc").when(name.isin(K.CONFIG_NAMES) | ext.isin(K.CONFIG_EXTENSIONS), "config").otherwise("other")


def role(rel: Column, ext: Column) -> Column:
    low = F.lower(rel)
    name, parts = base(low), F.split(low, "/")
    within = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(within(K.I18N_DIRS) & ext.isin(K.I18N_EXTENSIONS), "i18n")
        .when(ext.isin(K.SCHEMA_EXTENSIONS) | name.startswith("schema.") | (name == "models.py") | within(K.SCHEMA_DIRS), "schema")
        .when(low.contains(".test.") | low.contains(".spec.") | within(K.TEST_DIRS), "test")
        .when(name.isin(K.CONFIG_ROLE) | name.rlike(r"\.config\.(js|ts|mjs)$|^\.eslintrc|^\.prettierrc|^\.env|^docker-compose"), "config")
        .when(ext.isin(K.DOC_EXTENSIONS), "doc")
        .when(ext.isin(K.STYLE_ROLE), "style")
        .when(ext.isin(K.CODE_ROLE), "code")
        .when(ext.isin(K.ASSET_ROLE), "asset")
        .when(ext.isin(K.DATA_ROLE), "data")
        .otherwise("other")
    )


def is_test(rel: Column) -> Column:
    return reduce(Column.__or__, [rel.rlike(p) for p in (K.TEST_DIR, K.TEST_FILE, *K.TEST_NAMES)])


def tier(path: Column) -> Column:
    """0 foundation, 2 tail, null where the path alone does not tell."""
    return F.when(path == K.ROOT, 0).when(path.rlike(K.TIER2_ANY) | path.rlike(K.TIER2_LEAF), 2).when(path.rlike(K.TIER0), 0)


def is_entry_path(rel: Column) -> Column:
    return rel.rlike(K.ENTRY_PATH)


def is_entry_stem(rel: Column) -> Column:
    return F.lower(F.substring_index(base(rel), ".", 1)).isin(K.ENTRY_STEMS)


def rejected(rel: Column, ext: Column, size: Column, max_bytes: int = K.MAX_FILE_BYTES) -> Column:
    """Why the walk leaves a file out: size, lockfile, binary or minified; null if it does not."""
    name = F.lower(base(rel))
    return F.when(size > max_bytes, "size").when(name.isin(K.LOCKFILES), "lockfile").when(ext.isin(K.BINARY_EXTENSIONS), "binary").when(name.rlike(r"\.min\.(js|css)$"), "minified")


def in_ignored_dir(rel: Column, names: list[str] | None = None) -> Column:
    """Whether a folder above the file is in the set; a given set replaces the usual one."""
    parts = F.split(rel, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names or K.IGNORED_DIRS)))


def glob_regex(glob: str) -> str:
    """An anchored pattern: ** over folders, * and ? within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def any_glob(rel: Column, globs: list[str]) -> Column:
    return rel.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def glob_filter(rel: Column, globs: list[str]) -> Column:
    """Patterns that begin with ! exclude, whatever their place; without others everything is included."""
    yes, no = [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")]
    return (any_glob(rel, yes) if yes else F.lit(True)) & ~any_glob(rel, no)


class IgnoreRule:
    """One line of an ignore file as a pattern over paths from the root."""

    def __init__(self, regex: str, negated: bool, dir_only: bool):
        self.regex, self.negated, self.dir_only = regex, negated, dir_only
        self.compiled = re.compile(regex)


def _segment(s: str) -> str:
    out, i = "", 0
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s):
            out, i = out + re.escape(s[i + 1]), i + 2
            continue
        if c == "[":
            end = s.find("]", i + 2 if s[i + 1 : i + 2] in "!^]" else i + 1)
            if end > 0:
                body = s[i + 1 : end].replace("\\", "\\\\")
                out, i = out + f"[{'^' + body[1:] if body[:1] in ('!', '^') else body}]", end + 1
                continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def ignore_rules(content: str, folder: str = "") -> list[IgnoreRule]:
    """The rules of an ignore file that lies in ``folder``, in order."""
    rules = []
    for line in content.splitlines():
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        dir_only = line.endswith("/")
        line = line.rstrip("/") if dir_only else line
        anchored = "/" in line
        parts = line.lstrip("/").split("/")
        body = ""
        for i, p in enumerate(parts):
            last = i == len(parts) - 1
            if p == "**":
                body += ".*" if last else "(?:.*/)?"
            else:
                body += _segment(p) + ("" if last else "/")
        prefix = re.escape(folder.rstrip("/") + "/") if folder else ""
        try:
            rules.append(IgnoreRule(f"^{prefix}{'' if anchored else '(?:.*/)?'}{body}$", negated, dir_only))
        except re.error:
            continue  # a line that is no pattern ignores nothing
    return rules


def is_ignored(rules: list[IgnoreRule], rel: str, is_dir: bool = False) -> bool:
    """The last rule that matches decides."""
    for r in reversed(rules):
        if (is_dir or not r.dir_only) and r.compiled.match(rel):
            return not r.negated
    return False


def ignored(rel: Column, rules: list[IgnoreRule]) -> Column:
    """Whether a file or a folder above it is ignored; the rules are literals, so each pattern is compiled once."""

    def decided(path: Column, is_dir: bool) -> Column:
        c = F.lit(False)
        for r in rules:
            if is_dir or not r.dir_only:
                c = F.when(path.rlike(r.regex), F.lit(not r.negated)).otherwise(c)
        return c

    return decided(rel, False) | F.exists(F.filter(ancestors(rel), lambda d: d != ""), lambda d: decided(d, True))
