"""A source tree indexed end to end: walk, extract, resolve, link, group, rank; and the questions asked of it.

The base tables are written once to the shared folder; everything else is lazy and derived from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P
from ..functions import text as T
from ..operators import embed, extract, graph, history, relations, resolve, search, snapshot, workspaces
from ..session import written
from ..sinks import artifacts
from ..sources import git, walk

MANIFESTS = r"(^|/)(package\.json|[tj]sconfig[\w.-]*\.json|pnpm-workspace\.yaml|lerna\.json|nx\.json|project\.json|Cargo\.toml|go\.(mod|work)|pom\.xml|pyproject\.toml|composer\.json|(build|settings)\.gradle(\.kts)?)$"


class Repository:
    """``scope`` and ``globs`` restrict the files by path before any content is read twice.

    ``out_dirs``: folders of the tree that hold what the engine itself writes; they are never indexed.
    ``previous``: files and rows of an earlier index (``saved`` of it): what has not changed is taken from there.
    """

    def __init__(self, spark: SparkSession, root: str, scope: str | None = None, globs: list[str] | None = None, out_dirs: list[str] | None = None, previous: dict[str, DataFrame] | None = None, caps: extract.Caps = extract.Caps(), **options: str):
        walk.register(spark)
        self.spark, self.root = spark, root
        listing = spark.read.format("repository").options(root=root, **options).load()
        wanted = [*(globs or []), *([f"{scope.rstrip('/')}/**"] if scope else []), *(f"!{d.strip('/')}/**" for d in out_dirs or [])]
        self.options = options
        self.texts = written(listing.where(P.glob_filter(F.col("rel"), wanted)) if wanted else listing, "texts")
        self.reused = 0
        if previous:
            now = self.texts.select("rel", F.sha1("content").alias("hash"))
            same = written(now.join(previous["files"].select("rel", "hash"), ["rel", "hash"], "left_semi").select("rel"), "unchanged")
            self.reused = same.count()
            kept = previous["rows"].join(same, "rel", "left_semi")
            fresh = extract.extracted(self.texts.join(same, "rel", "left_anti"), caps)
            self.rows = written(fresh.unionByName(kept), "extracted")
        else:
            self.rows = written(extract.extracted(self.texts, caps), "extracted")

    @property
    def saved(self) -> dict[str, DataFrame]:
        """What ``previous`` of the next index takes; ``artifacts.save_index`` keeps it."""
        return {"files": self.files, "rows": self.rows}

    def left_out(self) -> DataFrame:
        """(what, files): how many files the walk kept, left out for each reason, and whether its list was cut."""
        return walk.left_out(self.spark, self.root, **self.options)

    @cached_property
    def files(self) -> DataFrame:
        """rel, ext, size, mtime_ms, lines, hash, kind, lang, title, summary, pkg, tier."""
        own = self.texts.select("rel", "ext", "size", "mtime_ms", T.line_count(F.col("content")).alias("lines"), F.sha1("content").alias("hash"), P.classify(F.col("rel"), F.col("ext")).alias("kind"))
        return own.join(self.rows.select("rel", "lang", "title", "summary", "pkg", "tier"), "rel")

    @cached_property
    def symbols(self) -> DataFrame:
        return extract.child(self.rows, "symbols").join(self.rows.select(F.col("rel").alias("file"), "lang"), "file")

    @cached_property
    def calls(self) -> DataFrame:
        return extract.child(self.rows, "calls")

    @cached_property
    def idents(self) -> DataFrame:
        return extract.child(self.rows, "idents").select("file", F.col("v").alias("ident"))

    @cached_property
    def manifests(self) -> dict[str, str]:
        """Contents of the manifests: as many as there are packages."""
        return {r["rel"]: r["content"] for r in self.texts.where(F.col("rel").rlike(MANIFESTS)).select("rel", "content").collect()}

    @cached_property
    def _all_folders(self) -> DataFrame:
        return self.texts.select(F.explode(P.ancestors(F.col("rel"))).alias("d")).where("d <> ''").distinct()

    @cached_property
    def folders(self) -> set[str]:
        """The folders that members of a workspace may be: those with a manifest."""
        return {p.rsplit("/", 1)[0] for p in self.manifests if "/" in p}

    @cached_property
    def roots(self) -> set[str]:
        """The folders that a path in an import may begin at, by their names."""
        return {r["d"] for r in self._all_folders.where(F.col("d").rlike(resolve.ROOTS)).collect()}

    @cached_property
    def resolutions(self) -> DataFrame:
        refs = extract.child(self.rows, "refs").join(self.rows.select(F.col("rel").alias("file"), "lang"), "file")
        out = resolve.resolve(refs, self.texts.select("rel"), resolve.context(self.manifests, self.roots), self.rows.where("pkg is not null").select("pkg", "rel"))
        folders = self._all_folders.select(F.col("d").alias("spec_dir")).union(self.spark.createDataFrame([("",)], "d string")).withColumn("is_dir", F.lit(True))
        at = F.concat_ws("/", F.when(F.col("file").contains("/"), P.directory(F.col("file"))), F.col("spec"))
        out = out.withColumn("spec_dir", P.normal(at)).join(folders, "spec_dir", "left")
        real = (F.col("kind") == "doc-link") & (F.col("state") == "dangling") & F.col("is_dir")
        return out.select("file", "pos", "kind", "spec", F.when(real, "external").otherwise(F.col("state")).alias("state"), "target", F.when(~F.coalesce(real, F.lit(False)), F.col("reason")).alias("reason"))

    @cached_property
    def import_pairs(self) -> DataFrame:
        r = self.resolutions.where("kind = 'import' and state = 'resolved' and target <> file")
        return r.select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()

    @cached_property
    def bound_calls(self) -> DataFrame:
        return written(relations.nearest_target(self._counted_calls(), self.symbols, self.import_pairs), "bound")

    def _counted_calls(self) -> DataFrame:
        langs = self.rows.select(F.col("rel").alias("src"), relations.family(F.col("lang")).alias("family"))
        return self.calls.groupBy(F.col("file").alias("src"), "name").agg(F.count(F.lit(1)).alias("n")).join(langs, "src")

    def bindings(self, recall: bool = False) -> DataFrame:
        """src, name, n, dst, confidence: calls and what they bind to, definitions of the same file first."""
        return relations.bindings(self._counted_calls(), self.symbols, self.import_pairs, recall)

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, kind, weight, dangling, reason, confidence: imports, links, calls, uses, mentions."""
        null = F.lit(None).cast("string")
        r = self.resolutions.where("state <> 'external' and coalesce(target, '') <> file")
        linked = r.select(F.col("file").alias("src"), F.coalesce("target", "spec").alias("dst"), "kind", F.lit(1).alias("weight"), (F.col("state") == "dangling").alias("dangling"), "reason", null.alias("confidence"))
        conf = F.when(F.max("imported"), "extracted").otherwise("inferred")
        called = self.bound_calls.groupBy("src", "dst").agg(F.least(F.sum("n"), F.lit(K.WEIGHT_CAP)).cast("int").alias("weight"), conf.alias("confidence"))
        called = called.select("src", "dst", F.lit("call").alias("kind"), "weight", F.lit(False).alias("dangling"), null.alias("reason"), "confidence")
        unique = relations.unique_defs(self.symbols)
        covered = self.import_pairs.unionByName(called.select("src", "dst"))
        plain = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("kind"), F.col("weight").cast("int").alias("weight"), F.lit(False).alias("dangling"), null.alias("reason"), null.alias("confidence"))
        used = plain(relations.use_edges(self.idents, unique, covered), "use")
        tokens = self.texts.join(self.files.where("kind = 'doc'").select("rel"), "rel").select("rel", F.explode(F.split("content", "[^A-Za-z0-9_]+")).alias("token"))
        mentioned = plain(relations.mention_edges(tokens, unique), "mention")
        return written(relations.dedupe_edges(linked.unionByName(called).unionByName(used).unionByName(mentioned)), "edges")

    @cached_property
    def modules(self) -> DataFrame:
        n = self.symbols.groupBy(F.col("file").alias("rel")).agg(F.count(F.lit(1)).alias("symbols"))
        f = self.files.join(n, "rel", "left").withColumn("file_kind", F.col("kind"))
        return relations.module_groups(f).join(relations.module_summaries(f), "path")

    @cached_property
    def module_of(self) -> DataFrame:
        return self.files.select("rel", P.directory(F.col("rel")).alias("path")).join(self.modules.select("path", F.col("slug").alias("module")), "path").select("rel", "module")

    @cached_property
    def module_edges(self) -> DataFrame:
        return written(relations.lifted(self.edges.where("not dangling"), self.module_of), "module-edges")

    @cached_property
    def file_nodes(self) -> DataFrame:
        n = self.symbols.groupBy(F.col("file").alias("rel")).agg(F.count(F.lit(1)).alias("symbols"))
        ranks = graph.pagerank(self.files.select(F.col("rel").alias("id")), self.edges.where("not dangling")).select(F.col("id").alias("rel"), F.round("rank", 4).alias("pagerank"))
        base = self.files.select("rel", F.col("kind").alias("file_kind"), "lang", "title", "lines").join(self.module_of, "rel").join(n, "rel", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
        return written(base.join(relations.degrees(self.edges, self.files), "rel").join(ranks, "rel").withColumn("test_file", P.is_test(F.col("rel"))), "file-nodes")

    def module_nodes(self, previous: dict[str, int] | None = None) -> DataFrame:
        n = self.modules.select(F.col("slug").alias("id"))
        e = self.module_edges.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), "weight")
        ranks = graph.pagerank(n, e).select("id", F.round("rank", 4).alias("pagerank"))
        return self.modules.withColumnRenamed("slug", "id").join(ranks, "id").join(graph.betweenness(n, e), "id").join(graph.communities(n, e, previous), "id")

    # questions

    def scan_summary(self) -> DataFrame:
        return self.files.groupBy("lang").agg(F.count(F.lit(1)).alias("files"))

    def status(self, stored: DataFrame) -> DataFrame:
        return snapshot.status(self.files, stored)

    @cached_property
    def search_index(self) -> search.Index:
        """Fields of each file: the names of its symbols, the parts of its path, its headings and its summary."""
        names = self.symbols.groupBy(F.col("file").alias("rel")).agg(F.collect_list("name").alias("names"))
        none = F.expr("cast(array() as array<string>)")
        docs = self.files.select("rel", "summary").join(names, "rel", "left").join(self.rows.select("rel", "headings"), "rel")
        fields = F.concat(F.coalesce("names", none), F.split("rel", "/"), F.coalesce("headings", none), F.array("summary"))
        return search.index(docs, "rel", fields, fields=True)

    def search(self, question: str, limit: int = K.SEARCH_LIMIT, fuzzy: bool = True) -> DataFrame:
        return search.ask(self.search_index, question, limit, fuzzy, self.symbols.select(F.col("file").alias("doc"), "name"))

    @cached_property
    def _vectors(self) -> dict[tuple[str, str], DataFrame]:
        return {}

    def semantic(self, question: str, model_path: str | None = None, url: str | None = None, limit: int = K.SEARCH_LIMIT) -> DataFrame:
        """Ranks of vectors and of words, fused; the words alone, with the reason, where there are no vectors."""
        tier, reason = embed.tier(model_path, url)
        words = search.ask(self.search_index, question, 50).select("doc", "score")
        if tier == "lexical":
            return embed.semantic(None, None, words, limit, reason)
        model = embed.Model.load(model_path) if tier == "static" else None
        encoder = embed.endpoint(url) if tier == "endpoint" else None
        key = (tier, model.model_id if model else url)
        if key not in self._vectors:
            self._vectors[key] = written(embed.build_index(embed.units(self.files, self.symbols), model, encoder), "vectors")
        asked = model.encode(question) if model else encoder([question])[0]
        return embed.semantic(self._vectors[key], asked, words, limit, reason, tier)

    def grep(self, pattern: str, limit: int = K.GREP_LIMIT) -> DataFrame:
        return search.grep(self.texts, "rel", "content", pattern, limit)

    def find_symbol(self, name_path: str, substring: bool = False) -> DataFrame:
        return search.find_symbol(self.symbols, name_path, substring)

    def overview(self, rel: str) -> DataFrame:
        return search.overview(self.symbols, rel).orderBy("line", "name")

    def references(self, name: str) -> DataFrame:
        return search.references(self.symbols, self.idents, name)

    def callers(self, recall: bool = False) -> DataFrame:
        """name, def_file, file, line, confidence: every call site of every definition, in order."""
        return relations.caller_sites(self.calls, self.bindings(recall), self.symbols).orderBy("name", "def_file", "file", "line")

    def caller_index(self, recall: bool = False) -> DataFrame:
        return relations.caller_index(self.bindings(recall)).orderBy("key")

    def raw_callers(self) -> DataFrame:
        """name, file, line, receiver, enclosing, enclosing_line of every call site, bound to nothing."""
        return relations.enclosing(self.calls.select("file", "name", "line", "receiver"), self.symbols)

    def dead_code(self) -> DataFrame:
        """name, file, line, kind, tier in order of tier, file and line."""
        called = self.bindings().select("name", F.col("dst").alias("file"))
        found = relations.dead_code(self.symbols, called, relations.symbol_refs(self.idents, relations.unique_defs(self.symbols)))
        return found.orderBy("tier", "file", "line")

    def tests_map(self) -> DataFrame:
        return relations.tests_map(self.edges)

    def complexity(self, limit: int = K.TOP_COMPLEXITY) -> DataFrame:
        return relations.symbol_complexity(self.symbols, self.texts.select(F.col("rel").alias("file"), "content"), limit)

    def repo_map(self) -> DataFrame:
        return search.repo_map(self.file_nodes, self.symbols)

    def check_rules(self, rules: list[dict]) -> DataFrame:
        """Violations of forbidden edges, and of the built-in rules cycles and orphans where they are asked for."""
        relations.valid_rules(rules)
        out = relations.forbidden(self.edges, [r for r in rules if "builtin" not in r])
        none = F.lit(None).cast("string")
        for r in rules:
            name, severity = F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "error")).alias("severity")
            if r.get("builtin") == "orphans":
                out = out.unionByName(relations.orphans(self.file_nodes).select(name, severity, F.col("rel").alias("src"), none.alias("dst"), F.lit("orphan").alias("kind")))
            elif r.get("builtin") == "cycles":
                e = self.module_edges.where("kind = 'import'").select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))
                found = self.spark.createDataFrame([(c[0], " > ".join(c)) for c in graph.cycles(e)], "src string, dst string")
                out = out.unionByName(found.select(name, severity, "src", "dst", F.lit("cycle").alias("kind")))
        return out.orderBy("rule", "src", "dst", "kind")

    def symbol_index(self) -> DataFrame:
        """name, file, line, kind, end_line, exported, ref_file: definitions and, a row each, the files that refer to names one file defines."""
        refs = relations.symbol_refs(self.idents, relations.unique_defs(self.symbols))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("line", "int"), ("kind", "string"), ("end_line", "int"), ("exported", "boolean"))]
        defs = self.symbols.where("name is not null").select("name", "file", "line", "kind", "end_line", "exported", F.lit(None).cast("string").alias("ref_file"))
        return defs.unionByName(refs.select("name", F.lit(None).cast("string").alias("file"), *none, F.col("file").alias("ref_file"))).orderBy("name", "file", "line", "kind", "ref_file")

    def community_of(self, module: str) -> int | None:
        row = self.module_nodes().where(F.col("id") == module).first()
        return row["community"] if row else None

    def tests_of(self, module: str) -> DataFrame:
        """The tests that reach any file of a module."""
        return self.tests_map().join(self.module_of.where(F.col("module") == module).select("rel"), "rel", "left_semi").select("test").distinct().orderBy("test")

    def graph_json(self) -> Iterator[str]:
        """The graph document, piece by piece."""
        languages = {r["lang"]: r["files"] for r in self.scan_summary().collect()}
        files = self.file_nodes.drop("title")
        return artifacts.graph_json(files, self.edges, self.modules, self.module_edges, languages, git.head(self.root))

    def mermaid(self, module: str | None = None) -> str:
        return artifacts.mermaid(self.module_edges, module)

    def scip(self) -> DataFrame:
        """file, document: the protobuf of each file."""
        occ = artifacts.occurrences(self.symbols, self.calls.select("file", "name", "line"), self.texts)
        return artifacts.scip_documents(occ, self.files.select("rel", "lang"))

    def workspaces(self) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
        return workspaces.workspaces(self.spark, self.manifests, self.folders)

    def hotspots(self, since: str | None = None) -> DataFrame | None:
        """Null where the tree is not under version control."""
        c = git.commits(self.spark, self.root, since)
        return None if c is None else history.hotspots(self.files.select("rel", "lines"), history.churn(c))

    def churn(self, since: str | None = None) -> DataFrame | None:
        c = git.commits(self.spark, self.root, since)
        return None if c is None else history.churn(c).orderBy(F.desc("commits"), "file")

    def risk(self, since: str | None = None) -> DataFrame | None:
        c = git.commits(self.spark, self.root, since)
        whole = self.texts.join(self.files.where("kind = 'code'").select("rel"), "rel").select("rel", T.complexity(F.col("content")).alias("complexity"))
        return None if c is None else history.risk(whole, history.churn(c))

    def coupling(self, since: str | None = None) -> DataFrame | None:
        c = git.commits(self.spark, self.root, since)
        return None if c is None else history.coupling(c)
