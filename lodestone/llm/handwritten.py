"""Source files that nobody wrote by hand: generated, minified or bundled, vendored, or data saved as code.

``of_contents`` takes the files' texts: each is lexed, re-emitted in one canonical layout and compared with its own
layout. Extreme expansion marks minified and bundled files, perfect uniformity generated ones, dominance of literals
data blobs.

``found`` takes an index, which keeps no contents: it lexes and re-emits what is kept of them, the signatures with the
lines they stand on, and compares with the lines, bytes and spans of the file. Canonical lines are those of the
signatures, or the bytes by the usual bytes of a line, which is learned from all code files, if these are more;
literals dominate where the bytes for each symbol are those of hundreds; a layout is uniform if every signature
stands as it is re-emitted and all symbols span the same number of lines.

A second reason is what a file says of itself: tools and licensed copies sign their output in the first comment and by
names of files and folders (fixed values below), and the folders directly under folders of vendored code name
libraries, by which versioned copies elsewhere are told from versioned files of the project. Third, a file of some
size with the content hash of a file that was found is a copy of it.

Defined results: null rel is no file; only the current sighting of a rel counts; null or zero size and lines leave
the layout tests out; null summaries leave the comment tests out, null hashes the copies; an index without hashes,
signatures or lines leaves out what needs them; other columns are not looked at. Null and empty contents are hand-written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sweep import by_file
from ..session import clean, latest, written
from . import lexing

#: Canonical lines for each original one beyond which a file is minified; bytes a symbol of a data blob.
EXPANSION, LITERAL = 25, 20_000
#: For contents: share of literals and characters of a data blob; uniformity and lines of generated code; expansion.
LITERAL_SHARE, LITERAL_CHARS, UNIFORMITY, UNIFORM_LINES, EXPANDS = 0.75, 5000, 0.9, 40, 8
#: Symbols at least for a layout to be called uniform; bytes of a file whose copies say something; bytes of a line where no file tells.
UNIFORM_SYMBOLS, COPY_BYTES, WIDTH = 8, 512, 40
#: Symbols of a file that one task looks at together.
BLOCK = 50_000
#: Folders of vendored code and of generated code.
VENDOR = "vendor|vendored|third_party|third-party|thirdparty|3rdparty|external|extern|deps|bower_components|node_modules|jspm_packages|Godeps/_workspace"
GENERATED = "codegen-out|gen|__generated__|generated|_gen|autogen|generated-sources|generated_src"
#: Endings of generated files' names before the extension, and whole endings.
GENERATED_NAME = r"(?:[._]generated|[._]gen|\.g|\.pb|\.pb-c|_pb2|_pb2_grpc|\.designer|\.yy|\.tab|\.freezed|\.auto)\.[a-z0-9]+$|(?:Grpc|OuterClass)\.java$|_string\.go$|(?:^|/)zz_generated[^/]*$|\.d\.ts\.map$"
#: How tools sign their output, and how licensed copies are signed.
GENERATED_SAYS = r"""^\W*(?:@generated\b|<auto-generated\b|auto-?generated (?:file|by|from|code)\b|(?:code|this (?:file|code) (?:is|was)(?: automatically| auto)?|file) (?:auto-?)?generated by\b|machine[ -]generated\b|generated (?:by|from|with) \S+(?: \S+)? .*(?:overwritten|edit|lost|v?\d)|this (?:file|code) (?:was|is) (?:created|generated|produced) automatically\b|automatisch (?:erzeugt|generiert)\b)|\b(?:do not edit|do not modify|manual changes will be lost|edits are overwritten|nicht von hand bearbeiten)\W*$"""
VENDORED_SAYS = r"^\W*(?:copyright (?:\(c\) )?(?:the )?\S+ (?:contributors|authors)\b.*licen[sc]|upstream: .*(?:release|version)|@license\b|@preserve\b)|^\W*\S+ v?\d+(?:\.\d+)+\S*\s*(?:[|-]).*licen[sc]e|\bredistributed unmodified\b"
VERSIONED = r"/?([a-z][a-z0-9]*?)[-._]v?\d+[._]\d+(?:[._]\d+)?\.[a-z0-9]+$"


class _Lexed(dict):
    """(canonical lines, whether the text stands as it is re-emitted) of each signature, worked out once."""

    def __missing__(self, text: str) -> tuple[int, bool]:
        if len(self) > 500_000:
            self.clear()
        lines = lexing.canonical(lexing.tokens(text))
        out = self[text] = (len(lines), len(lines) == 1 and lexing.alike(text, lines[0][1]))
        return out


LEXED = _Lexed()


def _layouts(rows: pa.Table, file: np.ndarray) -> pa.Table:
    pos, line, end = (rows[c].combine_chunks().fill_null(-1).to_numpy() for c in ("pos", "line", "end_line"))
    order = np.lexsort((pos, file))
    first = np.ones(len(order), bool)
    first[1:] = (file[order][1:] != file[order][:-1]) | (pos[order][1:] != pos[order][:-1])
    keep = np.sort(order[first])  # repeated rows count once
    of, n_files = file[keep], int(file[-1]) + 1
    signs = rows["signature"].take(pa.array(keep)).combine_chunks().dictionary_encode()
    known = [LEXED[s] for s in signs.dictionary.to_pylist()] or [(0, True)]
    at = signs.indices.fill_null(-1).to_numpy()
    lines, same = np.array([k[0] for k in known] + [1]), np.array([k[1] for k in known] + [True])
    span = np.maximum(0, end[keep] - line[keep])
    n = np.bincount(of, minlength=n_files)
    least, most = np.full(n_files, 1 << 30), np.full(n_files, -1)
    np.minimum.at(least, of, span)
    np.maximum.at(most, of, span)
    alike = np.bincount(of, weights=same[at], minlength=n_files) == n
    signed = np.bincount(of, weights=signs.indices.is_valid().to_numpy(zero_copy_only=False), minlength=n_files) > 0
    starts = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
    drawn = pa.array(np.bincount(of, weights=lines[at], minlength=n_files), pa.float64())
    return pa.table([rows["file"].take(pa.array(starts)), pa.array(n, pa.int64()), drawn, pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array(alike), pa.array(signed)], names=["rel", "n", "drawn", "least", "most", "alike", "signed"])


def _or_null(df: DataFrame, name: str, kind: str):
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def layouts(symbols: DataFrame) -> DataFrame:
    """(rel, n, drawn, uniform): symbols of each file, lines of their signatures in canonical layout, whether all are alike."""
    told = [_or_null(symbols, c, "int").alias(c) for c in ("line", "end_line")]
    s = symbols.where("file is not null and pos is not null").select(clean("file").alias("file"), F.col("pos").cast("int").alias("pos"), *told, clean(_or_null(symbols, "signature", "string")).alias("signature")).where("file is not null")
    # a file of very many symbols is spread by blocks of them, and what the blocks give is put together
    spread = s.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition("file", "block").sortWithinPartitions("file", "block").drop("block")
    parts = spread.mapInArrow(by_file(_layouts), "rel string, n bigint, drawn double, least bigint, most bigint, alike boolean, signed boolean")
    uniform = (F.sum("n") >= UNIFORM_SYMBOLS) & (F.min("least") == F.max("most")) & F.min("alike") & F.max("signed")
    return parts.groupBy("rel").agg(F.sum("n").alias("n"), F.sum("drawn").alias("drawn"), uniform.alias("uniform"))


def found(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rel, reason) of the code files that nobody wrote by hand; the first reason that holds."""
    f = files.select(clean("rel").alias("rel"), F.col("size").cast("bigint").alias("size"), F.col("lines").cast("bigint").alias("lines"), clean("kind").alias("kind"), clean("summary").alias("summary"), F.lower(clean(_or_null(files, "hash", "string"))).alias("hash"), "seen_at").where("rel is not null")
    f = written(latest(f, "rel", "seen_at", ["kind", "size", "lines", "summary", "hash"]).where("kind = 'code'"), "code-files")
    told = f.where("lines > 0 and size > 0").agg(F.percentile_approx(F.col("size") / F.col("lines"), 0.5).alias("w")).first()["w"]
    width = float(told or WIDTH)
    f = f.join(layouts(symbols), "rel", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    vendored_in = F.regexp_extract("rel", rf"(?:^|/)(?:{VENDOR})/([^/]+)/", 1)
    libraries = files.select(F.regexp_extract(clean("rel"), rf"(?:^|/)(?:{VENDOR})/([^/]+)/", 1).alias("library")).where("library <> ''").distinct()
    f = f.withColumn("library", F.regexp_extract("rel", VERSIONED, 1)).join(libraries.withColumn("known", F.lit(True)), "library", "left")
    expansion = F.greatest(F.col("size") / width, F.coalesce("drawn", F.lit(0.0))) / F.col("lines")
    reason = (
        F.when((F.col("lines") > 0) & (expansion >= EXPANSION), "minified")
        .when((F.col("size") / (F.col("n") + 1)) >= LITERAL, "data")
        .when(F.col("uniform"), "generated")
        .when((vendored_in != "") | F.col("known"), "vendored")
        .when(F.col("summary").rlike(f"(?i){VENDORED_SAYS}"), "vendored")
        .when(F.col("rel").rlike(rf"(?:^|/)(?:{GENERATED})/") | F.col("rel").rlike(f"(?i){GENERATED_NAME}"), "generated")
        .when(F.col("summary").rlike(f"(?i){GENERATED_SAYS}"), "generated")
    )
    told = written(f.select("rel", "hash", "size", reason.alias("reason")), "reasons")
    hashes = told.where(F.col("reason").isNotNull() & F.col("hash").isNotNull() & (F.col("size") >= COPY_BYTES)).select("hash", "size").distinct()
    copies = told.where("reason is null").join(hashes, ["hash", "size"], "left_semi").select("rel", F.lit("copy").alias("reason"))
    return told.where("reason is not null").select("rel", "reason").unionByName(copies)


def of_contents(texts: DataFrame, rel: str = "rel", content: str = "content", lang: str | None = None) -> DataFrame:
    """(rel, expansion, uniformity, literal_share, reason) of every text: its layout against the canonical one.

    Every row gives a row, so repeated paths are given again; reason is null for hand-written texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, c, g in zip(b["rel"], b["content"], b["lang"]):
                x = lexing.layout(c or "", g)
                reason = None
                if x.literal_share >= LITERAL_SHARE and x.code_chars >= LITERAL_CHARS:
                    reason = "data"
                elif x.expansion >= EXPANDS:
                    reason = "minified"
                elif x.lines >= UNIFORM_LINES and x.uniformity >= UNIFORMITY:
                    reason = "generated"
                rows.append((r, x.expansion, x.uniformity, x.literal_share, reason))
            yield pd.DataFrame(rows, columns=["rel", "expansion", "uniformity", "literal_share", "reason"])

    t = texts.select(F.col(rel).cast("string").alias("rel"), F.col(content).alias("content"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    return t.mapInPandas(run, "rel string, expansion double, uniformity double, literal_share double, reason string")
