"""Joins over the index: definitions, uses, calls, callers, lifted edges, tests, dead code, rules.

Every operator takes and gives DataFrames. Joins are equi-joins; what the index knows as nearest, longest or
enclosing is turned into one by candidate rows and an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths, text
from . import sweep


def family(lang: Column) -> Column:
    """Languages that call each other count as one."""
    return F.when(lang.isin("typescript", "javascript"), "js").when(lang.isin("c", "cpp"), "c").otherwise(lang)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, kind): weights summed, the least reason and confidence kept."""
    return edges.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"), F.max(F.coalesce("dangling", F.lit(False))).alias("dangling"), F.min("reason").alias("reason"), F.min("confidence").alias("confidence"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel, deg_in, deg_out) of all nodes: edges by kind, dangling ones only going out."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("rel"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("rel"), F.when(F.col("dangling"), 0).otherwise(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    d = both.groupBy("x.rel").agg(F.sum("x.i").alias("deg_in"), F.sum("x.o").alias("deg_out"))
    return nodes.select("rel").distinct().join(d, "rel", "left").select("rel", F.coalesce("deg_in", F.lit(0)).alias("deg_in"), F.coalesce("deg_out", F.lit(0)).alias("deg_out"))


def lifted(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """Module edges: weights summed, the kind of the highest rank kept; none within a module."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in K.LIFT_RANK.items() for x in kv]), F.col("kind")), F.lit(0))
    a = module_of.select(F.col("rel").alias("src"), F.col("module").alias("src_module"))
    b = module_of.select(F.col("rel").alias("dst"), F.col("module").alias("dst_module"))
    e = edges.join(a, "src").join(b, "dst").where("src_module <> dst_module").withColumn("rank", rank)
    return e.groupBy("src_module", "dst_module").agg(F.sum("weight").alias("weight"), F.max(F.struct("rank", "kind")).alias("k")).select("src_module", "dst_module", "weight", F.col("k.kind").alias("kind"))


def undirected(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(weight).alias("weight"))


def definitions(symbols: DataFrame) -> DataFrame:
    """Symbols that define something: names that are not null, kinds that are not references."""
    return symbols.where(F.col("name").isNotNull() & ~F.coalesce("kind", F.lit("")).isin(K.REFERENCE_KINDS))


def unique_defs(symbols: DataFrame) -> DataFrame:
    """(name, def_file) of distinctive names that exactly one file defines."""
    d = definitions(symbols).where(text.distinctive(F.col("name"))).select("name", "file").distinct()
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("def_file")).where("n = 1").drop("n")


def symbol_refs(idents: DataFrame, unique: DataFrame) -> DataFrame:
    """(name, file) of the files other than the defining one that use a uniquely defined name."""
    return idents.select(F.col("ident").alias("name"), "file").join(unique, "name").where("file <> def_file").select("name", "file").distinct()


def use_edges(idents: DataFrame, unique: DataFrame, covered: DataFrame) -> DataFrame:
    """(src, dst, weight): names of dst that src uses, capped; pairs that imports or calls cover are left out."""
    refs = symbol_refs(idents, unique).join(unique, "name").groupBy(F.col("file").alias("src"), F.col("def_file").alias("dst")).agg(F.least(F.count(F.lit(1)), F.lit(K.WEIGHT_CAP)).alias("weight"))
    return refs.join(covered.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def mention_edges(tokens: DataFrame, unique: DataFrame) -> DataFrame:
    """(src, dst, weight): documents that name a uniquely defined symbol; counts capped by name, then summed."""
    named = tokens.groupBy("rel", F.col("token").alias("name")).agg(F.least(F.count(F.lit(1)), F.lit(K.WEIGHT_CAP)).alias("n"))
    return named.join(unique, "name").where("rel <> def_file").groupBy(F.col("rel").alias("src"), F.col("def_file").alias("dst")).agg(F.sum("n").alias("weight"))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading parts two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y))
    same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q)
    return F.coalesce(F.array_position(same, F.lit(False)) - F.when(F.array_contains(same, False), 1).otherwise(F.lit(0) - n), n)


def _callable(calls: DataFrame, symbols: DataFrame, import_pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls that definitions elsewhere may answer, with how many do; those definitions; and per call what its imports offer.

    ``calls`` has src, name, family, n. Names that the calling file declares itself are its own. Nothing here pairs
    the callers of a name with its definers: a call meets the imports of its file, an import the names of its target.
    """
    d = definitions(symbols)
    exported = d.where("exported").select("name", F.col("file").alias("dst"), family(F.col("lang")).alias("family")).distinct()
    own = d.select("name", F.col("file").alias("src")).distinct()
    per_name = exported.groupBy("name", "family").agg(F.count(F.lit(1)).alias("defs"), F.min("dst").alias("only"))
    c = calls.join(per_name, ["name", "family"]).join(own, ["src", "name"], "left_anti")
    called = exported.join(c.select("name", "family").distinct(), ["name", "family"], "left_semi")
    pairs = import_pairs.where("src <> dst").select("src", "dst").distinct()
    offered = pairs.join(called, "dst").join(c.select("src", "name", "family"), ["src", "name", "family"])
    near = shared_prefix(F.col("src"), F.col("dst"))
    hi, lo = F.max(F.struct(near.alias("near"), "dst")).alias("hi"), F.min(F.struct((-near).alias("near"), "dst")).alias("lo")
    imported = offered.groupBy("src", "name").agg(F.count(F.lit(1)).alias("offers"), hi, lo)
    return c, exported, imported


def call_candidates(calls: DataFrame, symbols: DataFrame, import_pairs: DataFrame) -> DataFrame:
    """(src, name, candidates, imported): how many definitions a call may mean, and whether imports say so.

    Scripts bind only what they import; the other families prefer it.
    """
    c, _, imported = _callable(calls, symbols, import_pairs)
    x = c.join(imported.select("src", "name", "offers"), ["src", "name"], "left")
    x = x.where(F.col("offers").isNotNull() | (F.col("family") != "js"))
    return x.select("src", "name", F.coalesce("offers", "defs").alias("candidates"), F.col("offers").isNotNull().alias("imported"))


def nearest_target(calls: DataFrame, symbols: DataFrame, import_pairs: DataFrame, recall: bool = False) -> DataFrame:
    """(src, name, n, dst, imported): of each call's candidates the one that shares most leading folders, none where two do.

    Where imports decide, the best of the few they offer is an aggregate. Otherwise definitions are counted by
    (name, family, folder above them), the folders above the caller are looked up there, and the deepest one that
    holds a definition decides: if it holds one only, that is the target. ``recall``: scripts also bind a name that
    one file alone defines.
    """
    c, exported, imported = _callable(calls, symbols, import_pairs)
    c = c.join(imported.select("src", "name", "hi", "lo"), ["src", "name"], "left")
    by_import = c.where(F.col("hi").isNotNull() & (F.col("hi.dst") == F.col("lo.dst"))).select("src", "name", "n", F.col("hi.dst").alias("dst"), F.lit(True).alias("imported"))
    rest = c.where(F.col("hi").isNull() & ((F.col("family") != "js") | F.lit(recall) & (F.col("defs") == 1)))
    alone = rest.where("defs = 1").select("src", "name", "n", F.col("only").alias("dst"), F.lit(False).alias("imported"))
    several = rest.where("defs > 1").select("src", "name", "family", "n")
    wanted = exported.join(several.select("name", "family").distinct(), ["name", "family"], "left_semi")
    held = wanted.select("name", "family", "dst", F.explode(paths.ancestors(F.col("dst"))).alias("folder")).groupBy("name", "family", "folder").agg(F.count(F.lit(1)).alias("held"), F.min("dst").alias("dst"))
    up = several.select("src", "name", "family", "n", F.explode(paths.ancestors(F.col("src"))).alias("folder"))
    met = up.join(held, ["name", "family", "folder"]).groupBy("src", "name", "n").agg(F.max_by(F.struct("held", "dst"), F.length("folder")).alias("best"))
    near = met.where("best.held = 1").select("src", "name", "n", F.col("best.dst").alias("dst"), F.lit(False).alias("imported"))
    return by_import.unionByName(alone).unionByName(near)


def call_edges(calls: DataFrame, symbols: DataFrame, import_pairs: DataFrame) -> DataFrame:
    """(src, dst, weight, confidence): counts summed and capped, the stronger confidence kept."""
    t = nearest_target(calls, symbols, import_pairs)
    conf = F.when(F.max("imported"), "extracted").otherwise("inferred")
    return t.groupBy("src", "dst").agg(F.least(F.sum("n"), F.lit(K.WEIGHT_CAP)).alias("weight"), conf.alias("confidence"))


def bindings(calls: DataFrame, symbols: DataFrame, import_pairs: DataFrame, recall: bool = False) -> DataFrame:
    """(src, name, n, dst, confidence): what each call binds to; a definition in the caller's own file comes first."""
    own = definitions(symbols).select("name", F.col("file").alias("src")).distinct()
    local = calls.join(own, ["src", "name"], "left_semi").select("src", "name", "n", F.col("src").alias("dst"), F.lit(True).alias("imported"))
    every = local.unionByName(nearest_target(calls, symbols, import_pairs, recall))
    return every.select("src", "name", "n", "dst", F.when(F.col("imported"), "corroborated").otherwise("unique-name").alias("confidence"))


def caller_index(bound: DataFrame) -> DataFrame:
    """(key, name, def_file, callers, sites, first_caller): the first file that defines a called name has the name as key, others name@file.

    The sites themselves are the rows of ``bindings`` or of ``caller_sites``: a hot name needs no list.
    """
    x = bound.groupBy("name", F.col("dst").alias("def_file")).agg(F.count(F.lit(1)).alias("callers"), F.sum("n").alias("sites"), F.min("src").alias("first_caller"))
    first = x.groupBy("name").agg(F.min("def_file").alias("first"))
    key = F.when(F.col("def_file") == F.col("first"), F.col("name")).otherwise(F.concat("name", F.lit("@"), "def_file"))
    return x.join(first, "name").select(key.alias("key"), "name", "def_file", "callers", "sites", "first_caller")


def caller_sites(sites: DataFrame, bound: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, def_file, file, line, confidence): each call site of what it binds to; the line of a definition itself is no call of it."""
    at = definitions(symbols).groupBy(F.col("file").alias("def_file"), "name").agg(F.min_by("line", "pos").alias("def_line"))
    x = sites.select(F.col("file").alias("src"), "name", "line").join(bound.select("src", "name", F.col("dst").alias("def_file"), "confidence"), ["src", "name"])
    x = x.join(at, ["def_file", "name"], "left").where((F.col("src") != F.col("def_file")) | (F.col("line") != F.col("def_line")))
    return x.select("name", "def_file", F.col("src").alias("file"), "line", "confidence")


def enclosing(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each site (file, line, ...) with the innermost symbol around it and its line, null if none.

    Ties go to the later start, then the earlier end, then the greater pos. Sites and symbols of a file meet in one
    shuffle and are swept in order of lines, as arrays and many files at a time; nothing is joined.
    """
    names = [c for c in sites.columns if c != "file"]
    d = definitions(symbols).where("line is not null")
    one = lambda c: F.lit(None).cast(c)
    types = dict(sites.dtypes)
    rows = d.select("file", F.col("line").cast("int").alias("_at"), F.col("end_line").cast("int").alias("_end"), F.col("pos").cast("int").alias("_pos"), F.col("name").alias("_name"), *[one(types[c]).alias(c) for c in names])
    asked = sites.where("file is not null and line is not null").select("file", F.col("line").cast("int").alias("_at"), one("int").alias("_end"), F.lit(-1).alias("_pos"), one("string").alias("_name"), *names)
    lone = sites.where("file is null or line is null").select(*sites.columns, one("string").alias("enclosing"), one("int").alias("enclosing_line"))
    spec = ", ".join([f"`{c}` {types[c]}" for c in sites.columns] + ["enclosing string", "enclosing_line int"])
    swept = rows.unionByName(asked).repartition("file").sortWithinPartitions("file").mapInArrow(sweep.innermost(sites.columns), spec)
    return swept.unionByName(lone)


def symbol_complexity(symbols: DataFrame, texts: DataFrame, limit: int | None = K.TOP_COMPLEXITY) -> DataFrame:
    """(file, name, line, complexity) of the symbols with most branches in their lines. ``texts``: file, content."""
    s = symbols.where(~F.coalesce("kind", F.lit("")).isin("reexport", "reexport-all")).join(texts, "file")
    out = s.select("file", "name", "line", text.complexity(text.body(F.col("content"), F.col("line"), F.col("end_line"))).alias("complexity"))
    return out if limit is None else out.orderBy(F.desc("complexity"), "file", "line").limit(limit)


def tests_map(edges: DataFrame) -> DataFrame:
    """(rel, test): the test files that reach each file that is no test, one row each: a hot target needs no list."""
    e = edges.where(F.col("kind").isin("import", "use", "call") & ~F.coalesce("dangling", F.lit(False)))
    e = e.where(paths.is_test(F.col("src")) & ~paths.is_test(F.col("dst")))
    return e.select(F.col("dst").alias("rel"), F.col("src").alias("test")).distinct()


def untested(nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """Modules with code that no test reaches. ``nodes``: rel, module, file_kind, symbols, tier; ``covered``: rel."""
    m = nodes.groupBy("module").agg(F.sum("symbols").alias("symbols"), F.max((F.col("file_kind") == "code") & ~paths.is_test(F.col("rel"))).alias("code"))
    hit = nodes.join(covered.select("rel").distinct(), "rel", "left_semi").select("module").distinct()
    return m.where("code and symbols > 0").join(hit, "module", "left_anti").select("module", "symbols")


def dead_code(symbols: DataFrame, called: DataFrame, refs: DataFrame) -> DataFrame:
    """Exported definitions outside tests and entry points that nothing calls; tier 1 if nothing refers to them, else 2.

    ``called``: (name, file) of the definitions that have a caller; ``refs``: (name, file).
    """
    d = definitions(symbols).where(F.col("exported") & ~paths.is_test(F.col("file")) & ~paths.is_entry_path(F.col("file"))).select("name", "file", "line", "kind").distinct()
    r = refs.select("name").distinct().withColumn("referred", F.lit(True))
    return d.join(called.select("name", "file").distinct(), ["name", "file"], "left_anti").join(r, "name", "left").select("name", "file", "line", "kind", F.when(F.col("referred"), 2).otherwise(1).alias("tier"))


def orphans(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("file_kind") == "code") & (F.coalesce("deg_in", F.lit(0)) == 0) & (F.coalesce("deg_out", F.lit(0)) == 0) & ~paths.is_entry_stem(F.col("rel"))).select("rel")


SEVERITIES, BUILT_IN = ["error", "warn", "info"], ["cycles", "orphans"]


def valid_rules(rules: object) -> list[dict]:
    """The rules if they are well formed, else an error that says which is not and why."""
    if not isinstance(rules, list):
        raise ValueError("rules are a list")
    names: set[str] = set()
    for i, r in enumerate(rules):
        said = f"rule {i}: "
        if not isinstance(r, dict) or not isinstance(r.get("name"), str) or not r["name"]:
            raise ValueError(said + "it has no name")
        if r["name"] in names:
            raise ValueError(said + f"a second one is named {r['name']}")
        names.add(r["name"])
        if r.get("severity", "error") not in SEVERITIES:
            raise ValueError(said + f"its severity is none of {', '.join(SEVERITIES)}")
        if "builtin" in r:
            if r["builtin"] not in BUILT_IN:
                raise ValueError(said + f"there is no built-in {r['builtin']}")
            continue
        for side in ("from", "to", *(["kinds"] if "kinds" in r else [])):
            if not isinstance(r.get(side), list) or not r[side] or not all(isinstance(x, str) and x for x in r[side]):
                raise ValueError(said + f"{side} is no list of patterns")
    return rules


def forbidden(edges: DataFrame, rules: list[dict]) -> DataFrame:
    """Resolved edges that a rule forbids. A rule has name, from, to, and optionally kinds and severity.

    The rules are a stated list; their patterns are literals and all are tested in one scan.
    """
    hits = []
    for r in rules:
        c = paths.any_glob(F.col("src"), r["from"]) & paths.any_glob(F.col("dst"), r["to"])
        if r.get("kinds"):
            c = c & F.col("kind").isin(r["kinds"])
        hits.append(F.when(c, F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "error")).alias("severity"))))
    e = edges.where(~F.coalesce("dangling", F.lit(False)))
    return e.select("src", "dst", "kind", F.explode(F.array_compact(F.array(*hits))).alias("r")).select("r.rule", "r.severity", "src", "dst", "kind")


def surprises(module_edges: DataFrame, community: DataFrame, most: int = K.SURPRISES, per_pair: int = K.SURPRISE_PAIR) -> DataFrame:
    """Dependencies between communities that are otherwise hardly linked; targets of tier 0 are expected.

    ``community``: module, community, tier.
    """
    a = community.select(F.col("module").alias("src_module"), F.col("community").alias("ca"))
    b = community.select(F.col("module").alias("dst_module"), F.col("community").alias("cb"), "tier")
    e = module_edges.join(a, "src_module").join(b, "dst_module").where("ca <> cb").withColumn("lo", F.least("ca", "cb")).withColumn("hi", F.greatest("ca", "cb"))
    pairs = e.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("pair_edges"))
    e = e.join(pairs, ["lo", "hi"]).where(F.col("kind").isin("import", "call", "use") & (F.coalesce("tier", F.lit(1)) != 0) & (F.col("pair_edges") <= per_pair))
    return e.orderBy("pair_edges", "src_module", "dst_module").limit(most).select("src_module", "dst_module", "kind", "weight", "pair_edges")


def nearest_scope(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """(rel, scope): the deepest scope folder above each file, by an equi-join on all folders above."""
    up = files.select("rel", F.explode(paths.ancestors(F.col("rel"))).alias("scope"))
    return up.join(scopes.select("scope").distinct(), "scope").groupBy("rel").agg(F.max_by("scope", F.length("scope")).alias("scope"))


def module_groups(nodes: DataFrame) -> DataFrame:
    """Modules by folder: members, slug (with a hash where two folders share one) and tier."""
    rel = F.col("rel")
    tail = F.col("file_kind").isin("doc", "config") | paths.base(rel).rlike(K.TEST_FILE)
    m = nodes.groupBy(paths.directory(rel).alias("path")).agg(F.count(F.lit(1)).alias("members"), F.sum(F.coalesce("symbols", F.lit(0))).alias("symbols"), F.min(tail).alias("all_tail"))
    m = m.withColumn("slug", F.when(F.col("path") == K.ROOT, "root").otherwise(F.regexp_replace(text.slug(F.col("path")), r"\.", "-")))
    m = m.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("slug")))
    slug = F.when(F.col("same") > 1, F.concat("slug", F.lit("-"), text.short_hash(F.col("path")))).otherwise(F.col("slug"))
    t = F.coalesce(paths.tier(F.col("path")), F.when(F.col("all_tail"), 2).otherwise(1))
    return m.select("path", slug.alias("slug"), "members", "symbols", t.alias("tier"))


def module_summaries(nodes: DataFrame) -> DataFrame:
    """A line for each folder: its readme's summary, else its title, else the longest summary, else a count."""
    rel, name = F.col("rel"), F.lower(paths.base(F.col("rel")))
    readme = name.rlike(r"^(readme|index)\.(md|mdx)$")
    n = nodes.withColumn("path", paths.directory(rel)).withColumn("readme", readme)
    first = lambda c: F.min_by(c, F.when(F.col("readme"), F.col("rel")))
    longest = F.max(F.when(F.col("summary").isNotNull(), F.struct(F.length("summary").alias("n"), F.col("summary").alias("s"))))
    m = n.groupBy("path").agg(F.count(F.lit(1)).alias("n"), first("summary").alias("rs"), first("title").alias("rt"), longest.alias("l"))
    where = F.when(F.col("path") == K.ROOT, "the repository root").otherwise(F.concat(F.lit("`"), F.col("path"), F.lit("/`")))
    return m.select("path", F.coalesce("rs", "rt", F.col("l.s"), F.concat(F.col("n").cast("string"), F.lit(" file(s) in "), where, F.lit("."))).alias("summary"))
