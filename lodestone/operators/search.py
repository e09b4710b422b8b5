"""Search: BM25 with a fuzzy fallback, quantised vectors, rank fusion, grep and symbol lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text
from ..session import written


def postings(docs: DataFrame, doc: str, content: Column, fields: bool = False) -> DataFrame:
    """(doc, term, tf): the subtokens of each word of the content, counted; of each of its ``fields`` where it is an array.

    Documents are spread once, over as many tasks as the session shuffles to: taking words apart is work, and what
    follows is counted within documents and so shuffles nothing.
    """
    parts = content if fields else F.split(content, r"\s+")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.select(F.col(doc).alias("doc"), parts.alias("words")).repartition(tasks, "doc")
    words = spread.select("doc", F.explode("words").alias("word")).where("word is not null").groupBy("doc", "word").agg(F.count(F.lit(1)).alias("n"))
    terms = words.select("doc", "n", F.explode(text.exploded_subtokens(F.col("word"))).alias("term")).where(F.length("term") >= 2)
    return terms.groupBy("doc", "term").agg(F.sum("n").alias("tf"))


def query_terms(question: str) -> list[str]:
    """The subtokens of a question's keywords, once each; worked out on the driver, a question is one line."""
    import re

    out: dict[str, None] = {}
    for word in text.keywords(question):
        apart = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", word))
        for t in [re.sub("[^a-z0-9_]+", "", word.lower()), *(p.lower() for p in re.split("[^A-Za-z0-9]+", apart))]:
            if len(t) >= 2:
                out[t] = None
    return list(out)


def dice(terms: list[str], vocabulary: DataFrame, threshold: float = K.DICE, most: int = K.FUZZY_CAP) -> DataFrame:
    """(query, term, dice): for each query term the most similar terms of the vocabulary, by shared trigrams."""
    spark = vocabulary.sparkSession
    q = spark.createDataFrame([(t,) for t in terms], "query string").select("query", text.trigrams(F.col("query")).alias("g"))
    q = q.select("query", F.size("g").alias("qn"), F.explode("g").alias("gram"))
    v = vocabulary.select("term").distinct().select("term", text.trigrams(F.col("term")).alias("g")).select("term", F.size("g").alias("tn"), F.explode("g").alias("gram"))
    s = v.join(q, "gram").groupBy("query", "term", "qn", "tn").agg(F.count(F.lit(1)).alias("both"))
    s = s.withColumn("dice", 2.0 * F.col("both") / (F.col("qn") + F.col("tn"))).where(F.col("dice") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dice"), "term"))
    return s.withColumn("r", rank).where(F.col("r") <= most).select("query", "term", "dice")


def bm25(docs: DataFrame, doc: str, content: Column, question: str, limit: int | None = K.SEARCH_LIMIT, fuzzy: bool = True, fields: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """(doc, score, matched, fuzzy) by BM25; terms that no document holds are replaced by similar ones.

    ``content`` is a text, or an array of texts if ``fields``. ``symbols`` (doc, name): adds ``top_symbols``, the few
    names of each result that carry most of the terms.
    """
    return ask(index(docs, doc, content, fields), question, limit, fuzzy, symbols)


class Index:
    """Postings and lengths of documents, written once and asked any number of times."""

    def __init__(self, post: DataFrame, sizes: DataFrame):
        self.post, self.sizes = post, sizes
        self.total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()


def index(docs: DataFrame, doc: str, content: Column, fields: bool = False) -> Index:
    """Postings in order of terms, so that a question reads the parts of the files that hold its terms."""
    post = written(postings(docs, doc, content, fields).sortWithinPartitions("term"), "postings")
    sizes = docs.select(F.col(doc).alias("doc")).distinct().join(post.groupBy("doc").agg(F.sum("tf").alias("len")), "doc", "left")
    return Index(post, written(sizes.select("doc", F.coalesce("len", F.lit(0)).alias("len")), "sizes"))


def top_symbols(results: DataFrame, symbols: DataFrame, terms: list[str], most: int = K.TOP_SYMBOLS) -> DataFrame:
    """(doc, top_symbols): names of the documents found that carry most of the terms, then by name."""
    s = symbols.select("doc", "name").distinct().join(results.select("doc"), "doc", "left_semi")
    hits = F.size(F.array_intersect(text.subtokens(F.col("name")), F.array(*map(F.lit, terms))))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("hits"), "name"))
    s = s.withColumn("hits", hits).where("hits > 0").withColumn("r", rank).where(F.col("r") <= most)
    return s.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("top_symbols"))


def ask(built: Index, question: str, limit: int | None = K.SEARCH_LIMIT, fuzzy: bool = True, symbols: DataFrame | None = None) -> DataFrame:
    """The frequency of the question's few terms decides on the driver whether the fuzzy join is planned at all."""
    post, sizes, total = built.post, built.sizes, built.total
    terms = query_terms(question)
    spark = post.sparkSession
    schema = f"doc {dict(sizes.dtypes)['doc']}, score double, matched string, fuzzy string" + ", top_symbols array<string>" * (symbols is not None)
    if not terms:
        return spark.createDataFrame([], schema)
    df = {r["term"]: r["df"] for r in post.where(F.col("term").isin(terms)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    used = [(t, t, 1.0) for t in terms if t in df]
    missing = [t for t in terms if t not in df]
    if fuzzy and missing:
        used += [(r["query"], r["term"], r["dice"]) for r in dice(missing, post.select("term")).collect()]
    if not used or not total["avg"]:
        return spark.createDataFrame([], schema)
    q = spark.createDataFrame(used, "query string, term string, share double")
    hits = post.where(F.col("term").isin(sorted({t for _, t, _ in used}))).join(F.broadcast(q), "term")  # at most a few rows a term
    freq = hits.select("term", "doc").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = hits.join(freq, "term").join(sizes, "doc")
    idf = F.ln(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("share") * idf * F.col("tf") * (K.K1 + 1) / (F.col("tf") + K.K1 * (1 - K.B + K.B * F.col("len") / F.lit(total["avg"])))
    exact = F.when(F.col("query") == F.col("term"), F.col("query"))
    near = F.when(F.col("query") != F.col("term"), F.col("query"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = hits.groupBy("doc").agg(F.round(F.sum(part), 4).alias("score"), joined(exact).alias("matched"), joined(near).alias("fuzzy"))
    out = out if limit is None else out.orderBy(F.desc("score"), "doc").limit(limit)
    if symbols is None:
        return out
    named = top_symbols(out, symbols, sorted({t for _, t, _ in used}))
    none = F.expr("cast(array() as array<string>)")
    return out.join(named, "doc", "left").withColumn("top_symbols", F.coalesce("top_symbols", none)).orderBy(F.desc("score"), "doc")


def nearest(vectors: DataFrame, query: list[int], key: str, vec: str) -> DataFrame:
    """(key, dot) of quantised vectors and one query: the query is a literal, so nothing is joined."""
    q = F.array(*[F.lit(x) for x in query])
    return vectors.select(key, text.dot(F.col(vec), q).alias("dot"))


def _query_blocks(queries: DataFrame, key: str, vec: str, block: int):
    """The query set as (ids, matrix), ``block`` rows at a time, so that the driver never holds more of it."""
    ids, rows = [], []
    for r in queries.select(key, vec).orderBy(key).toLocalIterator():
        ids.append(r[key])
        rows.append(r[vec])
        if len(ids) == block:
            yield ids, np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, dtype=np.float64)


def _scored(vectors: DataFrame, queries: DataFrame, key: str, vec: str, group: str | None, most: int, block: int) -> DataFrame:
    """(query_id, group if any, key, dot): from each batch of vectors, the ``most`` best of each query and group.

    Dots of 8-bit steps are whole numbers far below 2^53, so doubles hold them exactly.
    """
    cols = [key] + ([group] if group else [])
    types = dict(vectors.dtypes)
    schema = ", ".join(["query_id bigint", *(f"{c} {types[c]}" for c in cols), "dot bigint"])

    def scorer(ids, matrix):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b.sort_values(key)  # the sort below is stable: of equal dots the smallest key comes first
                parts = b.groupby(group, sort=False, dropna=False) if group else [(None, b)]
                for _, g in parts:
                    dots = matrix @ np.array(g[vec].tolist(), dtype=np.float64).T
                    at = np.argsort(-dots, axis=1, kind="stable")[:, :most]
                    out = g[cols].iloc[at.ravel()].reset_index(drop=True)
                    out.insert(0, "query_id", np.repeat(ids, at.shape[1]))
                    out["dot"] = np.take_along_axis(dots, at, axis=1).ravel().astype(np.int64)
                    yield out

        return run

    out = None
    for ids, matrix in _query_blocks(queries, key, vec, block):
        part = vectors.select(*cols, vec).mapInPandas(scorer(ids, matrix), schema)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def nearest_of_set(vectors: DataFrame, queries: DataFrame, key: str, vec: str, most: int = K.SEARCH_LIMIT, block: int = 256) -> DataFrame:
    """(query_id, key, dot): for each vector of a query set its nearest ``most`` of all vectors, ties to the smallest key."""
    s = _scored(vectors, queries, key, vec, None, most, block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dot"), key))
    return s.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def best_of_set(vectors: DataFrame, queries: DataFrame, group: str, key: str, vec: str, block: int = 256) -> DataFrame:
    """(query_id, group, key, dot): for each vector of a query set the best of each group, ties to the smallest key."""
    s = _scored(vectors, queries, key, vec, group, 1, block)
    best = F.max(F.struct(F.col("dot").alias("s"), (-F.col(key)).alias("i"))).alias("b")
    return s.groupBy("query_id", group).agg(best).select("query_id", group, (-F.col("b.i")).alias(key), F.col("b.s").alias("dot"))


def fused(lists: list[DataFrame], key: str, rank: str, k: int = K.RRF_K) -> DataFrame:
    """(key, score) by reciprocal rank: each list has a key and its rank from 1."""
    rows = None
    for x in lists:
        part = x.select(key, (F.lit(1.0) / (F.lit(k) + F.col(rank))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.round(F.sum("s"), 6).alias("score"))


def grep(docs: DataFrame, key: str, content: str, pattern: str, limit: int | None = K.GREP_LIMIT) -> DataFrame:
    """(key, line, text) of the lines that match, in order of key and line."""
    near = docs.where(F.col(content).rlike(pattern))  # whole texts first: most never get split
    lines = near.select(key, F.posexplode(F.split(content, "\n")).alias("i", "text")).where(F.col("text").rlike(pattern))
    out = lines.select(key, (F.col("i") + 1).alias("line"), "text")
    return out if limit is None else out.orderBy(key, "line").limit(limit)


def find_symbol(symbols: DataFrame, name_path: str, substring: bool = False, limit: int = K.FIND_LIMIT) -> DataFrame:
    """Symbols named by the last part of a path such as Class/method, under the parent before it; exact ones first."""
    *above, leaf = name_path.split("/")
    exact = F.col("name") == leaf
    hit = exact | F.lower("name").contains(leaf.lower()) if substring else exact
    s = symbols.where(hit)
    if above:
        s = s.where(F.col("parent") == above[-1])
    out = s.select("file", "line", "name", "kind", "parent", exact.alias("exact")).distinct()
    return out.orderBy(F.desc("exact"), "file", "line", "name", "kind").limit(limit)


def overview(symbols: DataFrame, rel: str) -> DataFrame:
    return symbols.where(F.col("file") == rel).select("line", "name", "kind", "parent").distinct()


def references(symbols: DataFrame, idents: DataFrame, name: str) -> DataFrame:
    """(file, how): where a name is defined and which files refer to it, without the one that alone defines it."""
    d = symbols.where(F.col("name") == name).select("file").distinct()
    only = d.agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("f")).first()
    refs = idents.where(F.col("ident") == name).select("file").distinct()
    if only["n"] == 1:
        refs = refs.where(F.col("file") != only["f"])
    return d.select("file", F.lit("definition").alias("how")).unionByName(refs.select("file", F.lit("reference").alias("how")))


def repo_map(nodes: DataFrame, symbols: DataFrame, tokens: int = K.MAP_TOKENS, per_file: int = K.MAP_SYMBOLS) -> DataFrame:
    """(rank, rel, block): the most central files with their first symbols, as long as the budget lasts.

    The running length is taken over blocks in order of rank; the order is cut before the window to the files that
    can fit at all: a block has at least one letter and a line end.
    """
    top = nodes.orderBy(F.col("pagerank").desc_nulls_last(), F.col("symbols").desc_nulls_last(), "rel").limit(tokens * K.CHARS_PER_TOKEN // 2)
    near = symbols.join(top.select(F.col("rel").alias("file")), "file", "left_semi")
    s = near.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("exported"), "line", "pos"))).where(F.col("r") <= per_file)
    lines = s.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("  "), F.coalesce("kind", F.lit("")), F.lit(" "), F.coalesce("name", F.lit(""))).alias("t")))), lambda x: x["t"]), "\n").alias("_lines"))
    b = top.join(lines, top["rel"] == lines["file"], "left").select("rel", "pagerank", "symbols", F.concat("rel", F.lit("\n"), F.coalesce(F.concat("_lines", F.lit("\n")), F.lit(""))).alias("block"))
    order = Window.orderBy(F.col("pagerank").desc_nulls_last(), F.col("symbols").desc_nulls_last(), "rel")
    b = b.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return b.where(F.col("upto") <= tokens * K.CHARS_PER_TOKEN).select("rank", "rel", "block")
