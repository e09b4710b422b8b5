"""Artifacts: graph and symbol documents, diagrams, packed vectors, code-index protobuf, persisted index.

What a consumer reads whole is put together on the driver from ordered rows; the canonical store of everything is
parquet, written by executors.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K

SCHEMA_VERSION, EXTRACTOR_VERSION, EMBED_VERSION = 4, 10, 1


def _rows(df: DataFrame, order: list[str]) -> Iterator[str]:
    """Rows in a total order as JSON without nulls, one after another: the driver holds one partition of them."""
    for i, r in enumerate(df.orderBy(*order).toLocalIterator()):
        yield ("," if i else "") + "\n    " + json.dumps({k: v for k, v in r.asDict(True).items() if v is not None}, ensure_ascii=False, default=str)


def graph_json(files: DataFrame, edges: DataFrame, modules: DataFrame, module_edges: DataFrame, languages: dict[str, int], commit: str | None = None) -> Iterator[str]:
    """The graph document piece by piece, to be written as it comes; the pieces together are one JSON text."""
    head = {"schemaVersion": SCHEMA_VERSION, **({"commit": commit} if commit else {}), "fileCount": files.count(), "languages": dict(sorted(languages.items()))}
    yield json.dumps(head, indent=2, ensure_ascii=False)[:-2]
    for name, df, order in (("files", files, ["rel"]), ("modules", modules, ["slug"]), ("fileEdges", edges, ["src", "dst", "kind"]), ("moduleEdges", module_edges, ["src_module", "dst_module"])):
        yield f',\n  "{name}": ['
        yield from _rows(df, order)
        yield "\n  ]"
    yield "\n}\n"


def graph_lines(edges: DataFrame) -> DataFrame:
    """One JSON line for each edge: the graph document where it is too large to be read whole."""
    return edges.select("src", "dst", "kind", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "weight", F.when(F.col("dangling"), True).alias("dangling"), "reason", "confidence")).alias("line"))


def symbol_lines(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, line): one JSON line for each definition of a name and for each file that refers to it: a hot name needs no list."""
    d = symbols.where("name is not null").select("name", F.to_json(F.struct("name", "file", "line", "kind", "end_line", "exported")).alias("line"))
    return d.unionByName(refs.select("name", F.to_json(F.struct("name", F.col("file").alias("ref"))).alias("line"))).distinct()


def mermaid(module_edges: DataFrame, module: str | None = None, most: int = K.MERMAID_EDGES) -> str:
    e = module_edges if module is None else module_edges.where((F.col("src_module") == module) | (F.col("dst_module") == module))
    total = e.count()
    rows = e.orderBy(F.desc("weight"), "src_module", "dst_module").limit(most).collect()
    names = sorted({x for r in rows for x in (r["src_module"], r["dst_module"])})
    no = {n: f"n{i}" for i, n in enumerate(names)}
    quote = lambda s: s.replace('"', "#quot;")
    lines = ["graph LR", *(f'  {no[n]}["{quote(n)}"]' for n in names), *(f"  {no[r['src_module']]} -->|{r['kind']} {r['weight']}| {no[r['dst_module']]}" for r in rows)]
    return "\n".join([*lines, *([f"  %% {total - len(rows)} more edges"] if total > len(rows) else [])]) + "\n"


MAGIC = b"CIE1"


def pack_vectors(rows: list[tuple[dict, list[int]]], model: str, dim: int) -> bytes:
    """Header as JSON behind its length, then one signed byte for each number."""
    head = json.dumps({"version": EMBED_VERSION, "modelId": model, "dim": dim, "count": len(rows), "records": [r for r, _ in rows]}, separators=(",", ":"), ensure_ascii=False).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(struct.pack(f"{dim}b", *v) for _, v in rows)


def unpack_vectors(data: bytes) -> tuple[dict, list[list[int]]]:
    if data[:4] != MAGIC:
        raise ValueError("not a file of packed vectors")
    size = struct.unpack("<I", data[4:8])[0]
    head = json.loads(data[8 : 8 + size])
    body, dim = data[8 + size :], head["dim"]
    if len(body) != dim * head["count"]:
        raise ValueError("the body has not the length that the header says")
    return head, [list(struct.unpack(f"{dim}b", body[i * dim : (i + 1) * dim])) for i in range(head["count"])]


def packed_blocks(vectors: DataFrame, key: str, vec: str, model: str, per_block: int = 4096) -> DataFrame:
    """(block, data): packed files of a bounded number of vectors each, made where the rows lie. ``key``: a number."""
    import pandas as pd

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        rows = [({key: int(k)}, v.tolist()) for k, v in zip(g[key], g[vec])]
        return pd.DataFrame({"block": [g["block"].iloc[0]], "data": [pack_vectors(rows, model, len(rows[0][1]))]})

    blocks = vectors.select(F.floor(F.col(key) / per_block).cast("bigint").alias("block"), key, vec)
    return blocks.groupBy("block").applyInPandas(pack, "block bigint, data binary")


def unpacked_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """(key, vec) of all packed files."""
    import pandas as pd

    def unpack(batches):
        for b in batches:
            for data in b["data"]:
                head, vecs = unpack_vectors(bytes(data))
                yield pd.DataFrame({key: [r[key] for r in head["records"]], "vec": vecs})

    return blocks.select("data").mapInPandas(unpack, f"{key} bigint, vec array<int>")


# protobuf of a code index: documents with occurrences and symbols


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def tagged(no: int, payload: bytes | str | int) -> bytes:
    if isinstance(payload, int):
        return varint(no << 3) + varint(payload)
    data = payload.encode() if isinstance(payload, str) else payload
    return varint(no << 3 | 2) + varint(len(data)) + data


def escaped_id(name: str) -> str:
    return name if name and all(c.isascii() and (c.isalnum() or c in "_+-$") for c in name) else "`" + name.replace("`", "``") + "`"


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """(file, pos, symbol): a global name of each symbol; where two of a file would share one, lines tell them apart."""
    plain = F.col("name").rlike(r"^[A-Za-z0-9_+$-]+$")
    quoted = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z0-9_+$-]+$"), F.col(c)).otherwise(F.concat(F.lit("`"), F.replace(F.col(c), F.lit("`"), F.lit("``")), F.lit("`")))
    end = F.when(F.col("kind").isin("class", "interface", "struct", "enum", "type", "trait"), "#").when(F.col("kind").isin("function", "method"), "().").when(F.col("kind").isin("module", "namespace"), "/").otherwise(".")
    path = F.array_join(F.transform(F.split("file", "/"), lambda p: F.when(p.rlike(r"^[A-Za-z0-9_+$-]+$"), p).otherwise(F.concat(F.lit("`"), p, F.lit("`")))), "/")
    base = F.concat(path, F.lit("/"), F.coalesce(F.concat(quoted("parent"), F.lit("#")), F.lit("")), F.when(plain, F.col("name")).otherwise(quoted("name")), end)
    x = symbols.where("name is not null").withColumn("base", base)
    n = F.row_number().over(Window.partitionBy("file", "base", "line").orderBy("pos"))
    same = F.count(F.lit(1)).over(Window.partitionBy("file", "base"))
    x = x.withColumn("n", n).withColumn("same", same)
    mark = F.when(F.col("same") == 1, "").when(F.col("n") == 1, F.concat(F.lit("("), F.col("line").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("("), F.col("line").cast("string"), F.lit("_"), F.col("n").cast("string"), F.lit(")")))
    return x.select("file", "pos", "name", "line", F.concat(F.col("base"), mark).alias("symbol"))


def utf16_length(s):
    """How many UTF-16 code units a string has: two for each letter beyond the basic plane."""
    return F.length(s) + F.length(F.regexp_replace(s, r"[\x{0}-\x{FFFF}]+", ""))


def occurrences(symbols: DataFrame, calls: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(file, line, start, stop, symbol, role): definitions, and calls of names that one file alone defines.

    Places in a line are counted in UTF-16 code units; where the name is not found, the occurrence is the whole line.
    """
    ids = symbol_ids(symbols)
    x = ids.select("file", "line", "name", "symbol", F.lit(1).alias("role"))
    if calls is not None:
        one = ids.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("symbol").alias("symbol")).where("n = 1").drop("n")
        x = x.unionByName(calls.join(one, "name").select("file", "line", "name", "symbol", F.lit(0).alias("role")))
    if texts is None:
        start, stop = F.lit(0), utf16_length(F.col("name"))
    else:
        x = x.join(texts.select(F.col("rel").alias("file"), F.split("content", "\n").alias("lines")), "file", "left")
        text = F.try_element_at("lines", F.col("line"))
        at = F.regexp_instr(text, F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), F.col("name"), F.lit(r"\E(?![A-Za-z0-9_$])")))
        before = utf16_length(F.substring(text, F.lit(1), at - 1))
        start = F.when(at > 0, before).otherwise(0)
        stop = F.when(at > 0, before + utf16_length(F.col("name"))).otherwise(F.coalesce(utf16_length(text), F.lit(0)))
    return x.where("line is not null").select("file", (F.col("line") - 1).alias("line"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), "symbol", "role").distinct()


def scip_documents(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """(file, document): the protobuf of each file, encoded where its rows lie; a file's occurrences are bounded by the caps on extraction."""
    import pandas as pd

    parts = ["line", "start", "stop", "role", "symbol"]

    def encode(batches):
        for b in batches:
            docs = []
            for file, lang, *occ in zip(b["file"], b["lang"], *(b[p] for p in parts)):
                doc = tagged(1, file) + tagged(4, lang or "") + tagged(6, 2)  # places are UTF-16 code units
                for line, start, stop, role, symbol in zip(*(x.tolist() for x in occ)):
                    where = varint(line) + varint(start) + varint(stop)
                    doc += tagged(2, tagged(1, where) + tagged(2, symbol) + (tagged(3, role) if role else b""))
                for s in sorted({s for s, r in zip(occ[4], occ[3]) if r == 1}):
                    doc += tagged(3, tagged(1, s))
                docs.append(doc)
            yield pd.DataFrame({"file": b["file"], "document": docs})

    x = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("o"))
    x = x.join(languages.select(F.col("rel").alias("file"), "lang"), "file", "left")
    return x.select("file", "lang", *[F.col(f"o.{p}").alias(p) for p in parts]).mapInPandas(encode, "file string, document binary")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: numbers and byte strings."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while i < len(data):
        tag = number()
        if tag & 7 == 2:
            size = number()
            yield tag >> 3, data[i : i + size]
            i += size
        else:
            yield tag >> 3, number()


def scip_occurrences(documents: DataFrame) -> DataFrame:
    """(file, line, start, stop, symbol, role): the occurrences that the documents hold, read back from their bytes."""
    import pandas as pd

    def packed(data: bytes) -> list[int]:
        out, n, shift = [], 0, 0
        for b in data:
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                out.append(n)
                n = shift = 0
        return out

    def decode(batches):
        for b in batches:
            rows = []
            for doc in b["document"]:
                parts = list(fields(bytes(doc)))
                file = next(v for k, v in parts if k == 1).decode()
                for k, v in parts:
                    if k == 2:
                        o = dict(fields(v))
                        rows.append((file, *packed(o[1]), o[2].decode(), o.get(3, 0)))
            yield pd.DataFrame(rows, columns=["file", "line", "start", "stop", "symbol", "role"])

    return documents.select("document").mapInPandas(decode, "file string, line int, start int, stop int, symbol string, role int")


def scip_index(documents: DataFrame, root: str, version: str = "1") -> bytes:
    tool = tagged(1, "lodestone") + tagged(2, version)
    meta = tagged(1, tagged(2, tool) + tagged(3, f"file://{root}") + tagged(4, 1))
    return meta + b"".join(tagged(2, bytes(r["document"])) for r in documents.orderBy("file").toLocalIterator())


# the persisted index


def _sha(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


def content_sum(df: DataFrame) -> str:
    """Rows and the sum of their hashes, which adds up in any order."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def save_index(path: str, tables: dict[str, DataFrame], commit: str | None = None) -> None:
    """All tables, and last of all one row that says what they are and hold: an index without it does not count."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = {n: content_sum(spark.read.parquet(f"{path}/{n}")) for n in sorted(tables)}
    row = [(SCHEMA_VERSION, EXTRACTOR_VERSION, commit, json.dumps(counts), _sha(json.dumps(counts)))]
    spark.createDataFrame(row, "schema_version int, extractor_version int, commit string, counts string, sha string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_meta_")


def load_index(spark: SparkSession, path: str, commit: str | None = None) -> dict[str, DataFrame] | None:
    """The tables of an index that was saved whole by this version at this commit and has its contents; else null, and the caller rebuilds."""
    try:
        m = spark.read.parquet(f"{path}/_meta_").first()
        if not m or (m["schema_version"], m["extractor_version"]) != (SCHEMA_VERSION, EXTRACTOR_VERSION) or m["commit"] != commit or m["sha"] != _sha(m["counts"]):
            return None
        out = {n: spark.read.parquet(f"{path}/{n}") for n in json.loads(m["counts"])}
        return out if all(content_sum(out[n]) == c for n, c in json.loads(m["counts"]).items()) else None
    except Exception:  # noqa: BLE001 whatever is wrong with it, it is built anew
        return None
