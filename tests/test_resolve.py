"""Imports of the languages that the small tree does not have, and workspaces of every kind."""

import pytest

from lodestone.operators import resolve as R
from lodestone.operators import workspaces as W


def resolved(spark, refs, files, manifests=None, folders=(), namespaces=None):
    """(spec: (state, target)) of refs (file, lang, spec)."""
    rows = [(f, i, lang, "import", s) for i, (f, lang, s) in enumerate(refs)]
    r = spark.createDataFrame(rows, "file string, pos int, lang string, kind string, spec string")
    have = spark.createDataFrame([(f,) for f in files], "rel string")
    names = spark.createDataFrame(namespaces, "pkg string, rel string") if namespaces else None
    out = R.resolve(r, have, R.context(manifests or {}, set(folders)), names).collect()
    return {x["spec"]: (x["state"], x["target"]) for x in out}


def test_other_languages(spark):
    refs = [
        ("app/a.cs", "csharp", "Acme.Core"), ("app/a.cs", "csharp", "Acme"), ("app/a.cs", "csharp", "System.Text"),
        ("lib/a.rb", "ruby", "tools/saw"), ("lib/a.rb", "ruby", "./near"), ("lib/a.rb", "ruby", "json"), ("lib/a.rb", "ruby", "./gone"),
        ("web/i.php", "php", "Acme\\Web\\Page"), ("web/i.php", "php", "inc/head.php"), ("web/i.php", "php", "Other\\Thing"),
        ("j/src/main/java/a/B.java", "java", "a.util.*"), ("j/src/main/java/a/B.java", "java", "a.C.inner"), ("j/src/main/java/a/B.java", "java", "java.util.List"),
        ("r/src/deep/mod.rs", "rust", "super::top::go"), ("r/src/deep/mod.rs", "rust", "self::low"), ("r/src/deep/mod.rs", "rust", "serde::de"), ("r/src/lib.rs", "rust", "crate::gone"),
        ("c/m.cpp", "cpp", "lib/x.hpp"), ("c/m.cpp", "cpp", "gone.h"), ("g/m.go", "go", "old.example/dep/sub"), ("g/m.go", "go", "example.org/g/none"), ("k.py", "python", "pkg.mod"), ("pkg/n.py", "python", "..up"),
    ]
    files = ["app/a.cs", "lib/core.cs", "lib/core2.cs", "lib/tools/saw.rb", "lib/near.rb", "src/Page.php", "web/inc/head.php", "j/src/main/java/a/util/U.java", "j/src/main/java/a/C.java", "r/src/top.rs", "r/src/deep/low.rs", "r/src/lib.rs", "c/include/lib/x.hpp", "dep/sub/s.go", "src/pkg/mod.py", "up.py"]
    manifests = {"composer.json": '{"autoload": {"psr-4": {"Acme\\\\Web\\\\": "src/"}}}', "r/Cargo.toml": '[package]\nname = "r-x"\n', "g/go.mod": "module example.org/g\n\nreplace old.example/dep v1.0.0 => ../dep\n"}
    folders = ["lib", "j/src/main/java", "c/include"]
    got = resolved(spark, refs, files, manifests, folders, [("Acme.Core.Deep", "lib/core2.cs"), ("Acme.Core", "lib/core.cs")])
    assert got == {
        "Acme.Core": ("resolved", "lib/core.cs"), "Acme": ("resolved", "lib/core.cs"), "System.Text": ("external", None),
        "tools/saw": ("resolved", "lib/tools/saw.rb"), "./near": ("resolved", "lib/near.rb"), "json": ("external", None), "./gone": ("dangling", None),
        "Acme\\Web\\Page": ("resolved", "src/Page.php"), "inc/head.php": ("resolved", "web/inc/head.php"), "Other\\Thing": ("external", None),
        "a.util.*": ("resolved", "j/src/main/java/a/util/U.java"), "a.C.inner": ("resolved", "j/src/main/java/a/C.java"), "java.util.List": ("external", None),
        "super::top::go": ("resolved", "r/src/top.rs"), "self::low": ("resolved", "r/src/deep/low.rs"), "serde::de": ("external", None), "crate::gone": ("resolved", "r/src/lib.rs"),
        "lib/x.hpp": ("resolved", "c/include/lib/x.hpp"), "gone.h": ("dangling", None), "old.example/dep/sub": ("resolved", "dep/sub/s.go"), "example.org/g/none": ("dangling", None), "pkg.mod": ("resolved", "src/pkg/mod.py"), "..up": ("resolved", "up.py"),
    }


def test_scripts_resolve_through_configs_and_packages(spark):
    manifests = {
        "tsconfig.base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@lib/*": ["lib/*"], "exact": ["one.ts"]}}}',
        "app/tsconfig.json": '{"extends": "../tsconfig.base", /* more */ "compilerOptions": {}}',
        "packages/kit/package.json": '{"name": "@x/kit", "exports": {".": {"import": "./dist/index.mjs", "types": "./dist/index.d.ts"}, "./feat/*": "./dist/feat/*.js"}}',
        "packages/old/package.json": '{"name": "old", "main": "umd/main.js"}',
    }
    files = ["src/lib/a.ts", "src/one.ts", "packages/kit/src/index.ts", "packages/kit/src/feat/f.tsx", "packages/old/src/main.js", "app/x.vue", "app/dir/index.ts"]
    refs = [("app/m.ts", "typescript", s) for s in ("@lib/a", "exact", "@lib/none", "@x/kit", "@x/kit/feat/f", "@x/kit/none", "old", "react", "./x.vue", "./dir", "../../out")]
    assert resolved(spark, refs, files, manifests) == {
        "@lib/a": ("resolved", "src/lib/a.ts"), "exact": ("resolved", "src/one.ts"), "@lib/none": ("dangling", None), "@x/kit": ("resolved", "packages/kit/src/index.ts"), "@x/kit/feat/f": ("resolved", "packages/kit/src/feat/f.tsx"),
        "@x/kit/none": ("dangling", None), "old": ("resolved", "packages/old/src/main.js"), "react": ("external", None), "./x.vue": ("resolved", "app/x.vue"), "./dir": ("resolved", "app/dir/index.ts"), "../../out": ("dangling", None),
    }


KINDS = {
    "npm": ({"package.json": '{"workspaces": {"packages": ["pk/*", "!pk/no"]}}', "pk/a/package.json": '{"name": "a", "dependencies": {"b": "*"}}', "pk/b/package.json": '{"name": "b"}', "pk/no/package.json": '{"name": "no"}'}, {"a": {"b"}, "b": set()}),
    "pnpm": ({"pnpm-workspace.yaml": "packages:\n  - 'pk/**' # all\n", "pk/a/package.json": '{"name": "a", "devDependencies": {"b": "*"}}', "pk/x/b/package.json": '{"name": "b"}'}, {"a": {"b"}, "b": set()}),
    "lerna": ({"lerna.json": '{"packages": ["m/*"]}', "m/a/package.json": '{"name": "a"}'}, {"a": set()}),
    "nx": ({"nx.json": "{}", "apps/a/project.json": "{}", "apps/a/package.json": '{"name": "a"}'}, {"a": set()}),
    "cargo": ({"Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n', "crates/a/Cargo.toml": '[package]\nname = "a"\n[dependencies]\nb = { path = "../b" }\n', "crates/b/Cargo.toml": '[package]\nname = "b"\n'}, {"a": {"b"}, "b": set()}),
    "go": ({"go.work": "go 1.22\nuse (\n\t./a\n\t./b\n)\n", "a/go.mod": "module ex.org/a\nrequire ex.org/b v0.0.0\n", "b/go.mod": "module ex.org/b\n"}, {"ex.org/a": {"ex.org/b"}, "ex.org/b": set()}),
    "maven": ({"pom.xml": "<project><artifactId>p</artifactId><modules><module>core</module><module>web</module></modules></project>", "core/pom.xml": "<project><artifactId>core</artifactId></project>", "web/pom.xml": "<project><artifactId>web</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>core</artifactId></dependency></dependencies></project>"}, {"core": set(), "web": {"core"}}),
    "uv": ({"pyproject.toml": '[tool.uv.workspace]\nmembers = ["py/*"]\n', "py/a/pyproject.toml": '[project]\nname = "a"\ndependencies = ["b>=1", "numpy"]\n', "py/b/pyproject.toml": '[project]\nname = "b"\n'}, {"a": {"b"}, "b": set()}),
    "composer": ({"composer.json": '{"repositories": [{"type": "path", "url": "libs/*"}]}', "libs/a/composer.json": '{"name": "v/a", "require": {"v/b": "*"}}', "libs/b/composer.json": '{"name": "v/b"}'}, {"v/a": {"v/b"}, "v/b": set()}),
    "gradle": ({"settings.gradle": "include ':app', ':lib:core'\n", "app/build.gradle": "dependencies { implementation project(':lib:core') }", "lib/core/build.gradle": ""}, {"app": {"lib/core"}, "lib/core": set()}),
}


@pytest.mark.parametrize("kind", KINDS)
def test_workspaces_of_every_kind(spark, kind):
    manifests, want = KINDS[kind]
    folders = {"/".join(p.split("/")[:i]) for p in manifests for i in range(1, p.count("/") + 1)}
    packages, links, order, cycle = W.workspaces(spark, manifests, folders)
    needs = {r["name"]: set() for r in packages.collect()}
    for r in links.collect():
        needs[r["src"]].add(r["dst"])
    assert needs == want and cycle == [] and all(order.index(b) < order.index(a) for a, bs in want.items() for b in bs)


def test_a_cycle_of_packages_is_reported(spark):
    manifests = {"package.json": '{"workspaces": ["p/*"]}', "p/a/package.json": '{"name": "a", "dependencies": {"b": "*"}}', "p/b/package.json": '{"name": "b", "dependencies": {"a": "*"}}', "p/c/package.json": '{"name": "c", "dependencies": {"a": "*"}}'}
    *_, order, cycle = W.workspaces(spark, manifests, {"p", "p/a", "p/b", "p/c"})
    assert cycle == ["a", "b", "a"] and sorted(order) == ["a", "b", "c"]
