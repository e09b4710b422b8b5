"""Queries of the training-data problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import clean, latest, table, written
from . import handwritten, leaks, packing, splitting, terms, topn

REGISTRY = Registry()


@REGISTRY.query(
    "p2_found",
    r"""
    with c as (select nullif(trim(module, E' \t'), '') module, rel, pagerank, deg_in from (select * replace (trim(rel, E' \t') as rel), row_number() over (partition by trim(rel, E' \t') order by built_at desc nulls last) n from file_nodes) where n = 1 and rel is not null)
    select module, rel, rank_no::int rank_no from (select *, row_number() over (partition by module order by pagerank desc, deg_in desc nulls last, rel) rank_no from c where module is not null and pagerank is not null and not isnan(pagerank)) where rank_no <= 5
    """,
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "file_nodes").select(clean("rel").alias("rel"), clean("module").alias("module"), "pagerank", "deg_in", "built_at").where("rel is not null")
    current = latest(f, "rel", "built_at", ["module", "pagerank", "deg_in"])
    top = topn.top_n(current, "module", "pagerank", [F.col("deg_in").desc_nulls_last(), F.col("rel").asc()], 5)
    return top.select("module", "rel", F.col("rank_no").cast("int").alias("rank_no"))


_TERMS = r"""
    with base as (
        select distinct 'ident' f, nullif(trim(ident, E' \t'), '') t, nullif(trim(file, E' \t'), '') r, 0 p, '' h, 0 i from idents
        union all select distinct 'symbol', nullif(trim(name, E' \t'), ''), nullif(trim(file, E' \t'), ''), pos, '', 0 from symbols
        union all select distinct 'heading', w, r, pos, h, i from (select r, pos, h, unnest(ws) w, generate_subscripts(ws, 1) i from (select nullif(trim(rel, E' \t'), '') r, pos, trim(heading, E' \t') h, regexp_extract_all(lower(heading), '[\p{L}\p{Nd}]+') ws from headings))),
    n as (select f, count(distinct r) n from base where t is not null and r is not null group by f),
    c as (select f, t, count(*) occ, count(distinct r) files from base where t is not null and r is not null group by f, t),
    m as (select f, t, occ, files, case when files = 1 then 'rare' when files > 0.05 * n then 'common' end mark from c join n using (f))
"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = terms.index_rows(*(table(spark, sf_dir, t) for t in ("idents", "symbols", "headings")))
    name = F.element_at(F.create_map(*[x for k, v in terms.FIELDS.items() for x in (F.lit(k), F.lit(v))]), F.col("field"))
    return terms.marked(rows).withColumn("source_field", name)


@REGISTRY.query("p3_found", _TERMS + "select f source_field, t term, mark from m where mark is not null")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark is not null").select("source_field", "term", "mark")


@REGISTRY.query("p3_counts", _TERMS + "select f source_field, t term, occ::bigint occurrences, files::bigint files, mark from m")
def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and files of every term."""
    return _marked(spark, sf_dir).select("source_field", "term", "occurrences", F.col("records").alias("files"), "mark")


@REGISTRY.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.found(table(spark, sf_dir, "files"), table(spark, sf_dir, "symbols")).select("rel")


@REGISTRY.query("p6_reasons")
def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.found(table(spark, sf_dir, "files"), table(spark, sf_dir, "symbols"))


@REGISTRY.query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"))


@REGISTRY.query("p7_placed", "select doc_id, true whole, true fits, true apart from documents where text is not null and text <> ''")
def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text whether it is placed as it has to be, from the containers as they were made."""
    docs = table(spark, sf_dir, "documents")
    return packing.placed(docs, written(packing.containers(docs), "containers"))


@REGISTRY.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@REGISTRY.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "documents")).where("piece_no = 0").select("doc_id").distinct()


@REGISTRY.query("p9_pieces")
def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "documents"))


@REGISTRY.query("p9_cover", "select doc_id, strlen(text)::bigint bytes, true covered, true fits from documents where text is not null and text <> ''")
def p9_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text, cut or not, whether its pieces make it up within the limit and with the overlap."""
    return splitting.cover(table(spark, sf_dir, "documents"))
