"""A small tree of several languages, for queries over extraction and resolution."""

FILES = {
    "package.json": '{"name": "harbour", "private": true, "workspaces": ["packages/*"]}',
    "tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["web/src/*"],}},\n}',
    "README.md": "# Harbour\n\nTools that move cargo.\n\n## Parts\n\nSee [the crane](docs/crane.md), [gone](docs/none.md) and [site](https://example.org).\n\n```\n# not a heading\n```\n",
    "docs/crane.md": "---\ntitle: Crane guide\n---\n# Crane\n\nHow CraneDriver lifts. Back to [start](../README.md).\n",
    "web/src/crane.ts": '// Lifts cargo with care.\nimport { Cargo } from "./cargo.js";\nimport { log } from "@harbour/log";\n\nexport class CraneDriver {\n  lift(c: Cargo): number {\n    if (c.mass > 10 && c.ready) {\n      return weigh(c) * 2;\n    }\n    log("light");\n    return 0;\n  }\n}\n\nexport function weigh(c: Cargo): number {\n  return c.mass ? c.mass : 1;\n}\n',
    "web/src/cargo.ts": 'export interface Cargo {\n  mass: number;\n  ready: boolean;\n}\n\nexport const emptyCargo = (): Cargo => ({ mass: 0, ready: false });\n',
    "web/src/index.ts": 'export { CraneDriver, weigh } from "./crane";\nexport * from "@app/cargo";\nimport missing from "./nowhere";\n',
    "web/src/crane.test.ts": 'import { weigh } from "./crane";\nimport { emptyCargo } from "@app/cargo";\n\nweigh(emptyCargo());\n',
    "packages/log/package.json": '{"name": "@harbour/log", "main": "dist/index.js", "dependencies": {}}',
    "packages/log/src/index.ts": 'export function log(text: string): void {\n  console.info(text);\n}\n',
    "packages/ship/package.json": '{"name": "@harbour/ship", "exports": {".": "./dist/main.js"}, "dependencies": {"@harbour/log": "*"}}',
    "packages/ship/src/main.ts": 'import { log } from "@harbour/log";\nexport function sail(): void {\n  log("sailing");\n}\n',
    "py/yard/__init__.py": "",
    "py/yard/stack.py": '"""Stacks of containers."""\nfrom .crates import Crate\nfrom . import crates\nimport os\n\n\nclass Stack:\n    def push(self, c):\n        return measure_crate(c)\n\n    def _hidden(self):\n        pass\n\n\ndef tower(n):\n    return [Stack() for _ in range(n)]\n',
    "py/yard/crates.py": "class Crate:\n    pass\n\n\ndef measure_crate(c):\n    return 1\n",
    "go.mod": "module example.org/harbour\n\ngo 1.22\n",
    "dock/dock.go": 'package dock\n\nimport (\n\t"fmt"\n\t"example.org/harbour/dock/gate"\n)\n\nfunc Open() { fmt.Println(gate.Key()) }\n\nfunc shut() {}\n',
    "dock/gate/gate.go": "package gate\n\ntype Lock struct{}\n\nfunc (l Lock) Turn() {}\n\nfunc Key() string { return \"k\" }\n",
    "rs/Cargo.toml": '[package]\nname = "tug-boat"\n',
    "rs/src/lib.rs": "pub mod rope;\nuse crate::rope::{Knot, tie};\n\npub fn pull() { tie(Knot) }\n",
    "rs/src/rope.rs": "pub struct Knot;\n\npub fn tie(_k: Knot) {}\n",
    "jv/src/main/java/org/quay/Berth.java": "package org.quay;\n\nimport org.quay.tide.Moon;\n\npublic class Berth {\n    public int depth() { return new Moon().pull(); }\n}\n",
    "jv/src/main/java/org/quay/tide/Moon.java": "package org.quay.tide;\n\npublic class Moon {\n    public int pull() { return 1; }\n}\n",
    "c/include/anchor.h": "struct Anchor { int mass; };\nint drop(struct Anchor a);\n",
    "c/anchor.c": '#include "anchor.h"\n\nint drop(struct Anchor a) {\n  return a.mass;\n}\n',
}

DIFF = """diff --git a/web/src/crane.ts b/web/src/crane.ts
--- a/web/src/crane.ts
+++ b/web/src/crane.ts
@@ -1,3 +1,5 @@
+// one
@@ -20,2 +24,0 @@ gone
diff --git a/docs/crane.md b/docs/crane.md
--- a/docs/crane.md
+++ b/docs/crane.md
@@ -7 +7 @@
-old
+new"""
