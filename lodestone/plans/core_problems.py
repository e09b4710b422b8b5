"""Queries of the general problems: changed records, hot keys, hierarchies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import incremental, skew
from ..session import clean, latest, shared_dir, table, written
from .registry import Registry

REGISTRY = Registry()
SCHEMA_VERSION, EXTRACTOR_VERSION = 4, 10


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, hash) of the current sighting of each file, hash in lower case."""
    f = table(spark, sf_dir, "files").select(clean("rel").alias("rel"), F.lower(clean("hash")).alias("hash"), "seen_at").where("rel is not null")
    return latest(f, "rel", "seen_at", ["hash"])


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, hash) that the last run that ended well has stored, hash in lower case."""
    ok = table(spark, sf_dir, "runs").where(clean("status") == "ok").select("run_id", "attempt").distinct()
    s = table(spark, sf_dir, "snapshot").where((F.col("schema_version") == SCHEMA_VERSION) & (F.col("extractor_version") == EXTRACTOR_VERSION))
    s = s.select(clean("rel").alias("rel"), F.lower(clean("hash")).alias("hash"), "run_id", "attempt", "written_at").where("rel is not null")
    s = s.join(ok, ["run_id", "attempt"], "left_semi").withColumn("at", F.struct("run_id", "attempt", "written_at"))
    return latest(s, "rel", "at", ["hash"])


@REGISTRY.query(
    "p1_found",
    r"""
    with f as (select rel, lower(nullif(trim(hash, E' \t'), '')) h from (select *, nullif(trim(rel, E' \t'), '') rel_, row_number() over (partition by trim(rel, E' \t') order by seen_at desc nulls last) n from files) where n = 1 and rel_ is not null),
    s as (select rel, lower(nullif(trim(hash, E' \t'), '')) h from (
        select s.*, row_number() over (partition by trim(s.rel, E' \t') order by s.run_id desc, s.attempt desc, s.written_at desc) n
        from snapshot s semi join (select run_id, attempt from runs where trim(status, E' \t') = 'ok') r on s.run_id = r.run_id and s.attempt = r.attempt
        where schema_version = 4 and extractor_version = 10) where n = 1)
    select distinct trim(f.rel, E' \t') rel from f left join s on trim(f.rel, E' \t') = trim(s.rel, E' \t') where f.h is null or s.h is null or f.h <> s.h
    """,
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run over the current files processes in a store that holds what the runs that ended well have left."""
    return _two_runs(spark, sf_dir)[1].pending.select("rel")


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[incremental.PartitionStore, incremental.Run]:
    store = incremental.PartitionStore(spark, f"{shared_dir(spark)}/stores/p1-{uuid.uuid4().hex}", "rel", ["hash"], folder=incremental.folder_of)
    indexed = lambda df: df.withColumn("mark", F.sha1(F.concat_ws(":", "rel", "hash")))
    store.refresh(stored_files(spark, sf_dir), indexed)
    return store, store.refresh(current_files(spark, sf_dir), indexed)


@REGISTRY.query(
    "p1_refresh",
    r"""
    select trim(rel, E' \t') rel, lower(nullif(trim(hash, E' \t'), '')) hash, sha1(concat_ws(':', trim(rel, E' \t'), lower(nullif(trim(hash, E' \t'), '')))) mark from (select *, row_number() over (partition by trim(rel, E' \t') order by seen_at desc) n from files where nullif(trim(rel, E' \t'), '') is not null) where n = 1
    """,
)
def p1_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after both runs: each current file once, under its current hash, with what was worked out for it."""
    return _two_runs(spark, sf_dir)[0].rows().select("rel", "hash", "mark")


def tidy(df: DataFrame) -> DataFrame:
    """Strings without blanks at their ends, empty ones null: rows as they are compared."""
    return df.select(*[clean(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


_SYMBOLS = "(select distinct " + ", ".join(f"nullif(trim({c}, E' \\t'), '') {c}" for c in ("file", "name", "kind", "parent", "signature", "lang")) + ", pos, line, end_line, exported from symbols)"
_EDGES = "(select distinct " + ", ".join(f"nullif(trim({c}, E' \\t'), '') {c}" for c in ("src", "dst", "kind", "reason", "confidence")) + ", weight, dangling from edges)"


@REGISTRY.query(
    "p4_found",
    f"""
    select 'symbol_name' keyed_on, name key_value from {_SYMBOLS} where name is not null group by name having count(*) >= 0.01 * (select count(*) from {_SYMBOLS})
    union all
    select 'edge_dst', dst from {_EDGES} where dst is not null group by dst having count(*) >= 0.01 * (select count(*) from {_EDGES})
    """,
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for source, column, keyed_on in (("symbols", "name", "symbol_name"), ("edges", "dst", "edge_dst")):
        rows = tidy(table(spark, sf_dir, source))
        parts.append(skew.heavy_keys(rows, F.col(column)).select(F.lit(keyed_on).alias("keyed_on"), "key_value"))
    return parts[0].unionByName(parts[1])


@REGISTRY.query(
    "p4_symbol_profile",
    f"""
    with s as (select name, file, kind, coalesce(end_line - line, 0) span from {_SYMBOLS} where name is not null),
    m as (select name, kind, row_number() over (partition by name order by count(*) desc, kind) n from s where kind is not null group by name, kind)
    select s.name key_value, count(*) n_rows, count(distinct file) n_files, any_value(m.kind) top_kind, quantile_disc(span, 0.5)::double median_span, quantile_disc(span, 0.9)::double p90_span
    from s left join m on s.name = m.name and m.n = 1 group by s.name
    """,
)
def p4_symbol_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per name: distinct rows, files, most frequent kind, median and 90th percentile of the length in lines."""
    s = tidy(table(spark, sf_dir, "symbols")).where("name is not null")
    rows = s.dropDuplicates()
    span = F.coalesce(F.col("end_line") - F.col("line"), F.lit(0))
    base = written(skew.weighted(rows, F.col("name"), [F.col("file"), F.col("kind"), span]), "weighted")
    files = base.groupBy("key", "v0").agg(F.sum("w").alias("w")).groupBy("key").agg(F.sum("w").alias("n_rows"), F.count("v0").alias("n_files"))
    kinds = skew.modes(base.groupBy("key", F.col("v1").alias("v0")).agg(F.sum("w").alias("w"))).select("key", F.col("mode").alias("top_kind"))
    spans = skew.percentiles(base.groupBy("key", F.col("v2").alias("v0")).agg(F.sum("w").alias("w")), {"median_span": 0.5, "p90_span": 0.9})
    spans = spans.select("key", F.col("median_span").cast("double").alias("median_span"), F.col("p90_span").cast("double").alias("p90_span"))
    return files.join(kinds, "key", "left").join(spans, "key", "left").select(F.col("key").alias("key_value"), "n_rows", "n_files", "top_kind", "median_span", "p90_span")


@REGISTRY.query(
    "p4_target_profile",
    f"""
    with e as (select dst, src, kind, weight from {_EDGES} where dst is not null),
    m as (select dst, kind, row_number() over (partition by dst order by count(*) desc, kind) n from e where kind is not null group by dst, kind)
    select e.dst key_value, count(*) n_rows, count(distinct src) n_sources, any_value(m.kind) top_kind, sum(weight)::bigint total_weight
    from e left join m on e.dst = m.dst and m.n = 1 group by e.dst
    """,
)
def p4_target_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per link target: distinct rows, sources, most frequent kind and total weight."""
    e = tidy(table(spark, sf_dir, "edges")).where("dst is not null").dropDuplicates()
    base = written(skew.weighted(e, F.col("dst"), [F.col("src"), F.col("kind"), F.col("weight")]), "weighted")
    sources = base.groupBy("key", "v0").agg(F.sum("w").alias("w"), F.sum(F.col("v2").cast("bigint") * F.col("w")).alias("s")).groupBy("key").agg(F.sum("w").alias("n_rows"), F.count("v0").alias("n_sources"), F.sum("s").alias("total_weight"))
    kinds = skew.modes(base.groupBy("key", F.col("v1").alias("v0")).agg(F.sum("w").alias("w"))).select("key", F.col("mode").alias("top_kind"))
    return sources.join(kinds, "key", "left").select(F.col("key").alias("key_value"), "n_rows", "n_sources", "top_kind", "total_weight")


_TREE = r"""
    with recursive s as (select distinct file, pos, nullif(trim(name, E' \t'), '') name, nullif(trim(parent, E' \t'), '') parent from symbols where file is not null and pos is not null),
    near as (select c.file, c.pos, max(p.pos) filter (p.pos < c.pos) lo, min(p.pos) fst from s c join s p on c.file = p.file and c.parent = p.name group by c.file, c.pos),
    link as (select file, pos, coalesce(lo, fst) up from near),
    walk as (select file, pos, up anc, 1 depth from link union all select w.file, w.pos, l.up, depth + 1 from walk w join link l on w.file = l.file and w.anc = l.pos where depth < 60),
    ends as (select file, pos, max(depth) depth, arg_max(anc, depth) root from walk group by file, pos),
    tree as (select file, pos, case when depth >= 60 then -1 else root end root_pos, case when depth >= 60 then -1 else depth end depth from ends)
"""


@REGISTRY.query("p5_found", _TREE + "select file, pos, root_pos::int root_pos, depth::int depth from tree where depth = -1 or depth >= 2")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.deep_or_cyclic(table(spark, sf_dir, "symbols"))


@REGISTRY.query("p5_hierarchy", _TREE + "select tree.file, tree.pos, link.up::int up, root_pos::int root_pos, depth::int depth from tree join link using (file, pos)")
def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, root and depth of every symbol that has a parent."""
    return H.hierarchy(table(spark, sf_dir, "symbols"))


_NAMED = "(select file, pos, min(name) nm from s group by file, pos)"


@REGISTRY.query(
    "p5_paths",
    _TREE
    + f""", up2 as (select w.file, w.pos, w.anc, w.depth from walk w join tree t on w.file = t.file and w.pos = t.pos where t.depth <> -1),
    txt as (select u.file, u.pos, string_agg(coalesce(n.nm, ''), '/' order by u.depth desc) p from up2 u join {_NAMED} n on n.file = u.file and n.pos = u.anc group by u.file, u.pos),
    below as (select file, anc pos, count(*) n from up2 group by file, anc)
    select n.file, n.pos, case when t.depth = -1 then null else concat_ws('/', txt.p, coalesce(n.nm, '')) end path, coalesce(t.depth, 0)::int depth, case when t.depth is null then n.pos else t.root_pos end::int root_pos, coalesce(b.n, 0)::bigint n_descendants
    from {_NAMED} n left join tree t on n.file = t.file and n.pos = t.pos left join txt on n.file = txt.file and n.pos = txt.pos left join below b on n.file = b.file and n.pos = b.pos""",
)
def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path, depth, outermost symbol and number of symbols inside of every symbol."""
    return H.paths(table(spark, sf_dir, "symbols"))


@REGISTRY.query("p5_descendants", _TREE + "select w.file, w.anc::int pos, w.pos::int descendant, w.depth::int distance from walk w join tree t on w.file = t.file and w.pos = t.pos where t.depth <> -1")
def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols inside every symbol."""
    return H.descendants(table(spark, sf_dir, "symbols"))
