"""Splitting oversized texts at natural boundaries by recursive bisection.

A text of more than ``limit`` tokens is cut at the strongest boundary near its middle (between cues, else lines,
else sentences, else words, else tokens), its halves are cut on while they exceed the limit less the overlap, and
each piece but the first then begins with the last ``overlap`` tokens of the one before. Pieces are byte ranges of
the text that begin and end between characters, so the texts of the pieces without their overlaps make up the text.

Texts of at most ``limit`` bytes cannot have more tokens and never reach Python.

Defined results: null and empty texts have no piece; a text within the limit is one piece where ``whole`` asks for
it; a cut never falls inside a character; where a token is only part of one, the overlap takes in that character,
a few bytes more; repeated texts are cut alike; columns with other names are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import VOCABULARY, Tokenizer, tokenizer

LIMIT, OVERLAP = 2048, 64
#: Boundaries in UTF-8 bytes from strong to weak: cues, lines, sentences, words; the cut falls at the end of the match.
BOUNDARIES = [re.compile(p) for p in (rb"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+|\s(?=\d+\s+\d\d?:\d\d)", rb"\r\n|\r|\n|\s{2,}", rb"(?:[.!?]|\xe2\x80\xa6)+[\"')\]]*\s+", rb"\s+")]
#: Tokens that a piece read by itself may have more than its share of the whole text.
SLACK = 8


def bisect(text: str, tok: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(first token, first own token, end token) of each piece; one piece if the text is within the limit.

    ``ends``: where the text's tokens end, if that is known.
    """
    raw = text.encode("utf-8", "surrogatepass")
    ends = tok.ends(text) if ends is None else ends
    n = len(ends)
    if n <= limit:
        return [(0, 0, n)]
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = np.concatenate(([0], ends[:-1]))
    whole = (data[starts] & 0xC0) != 0x80  # tokens that begin with a character
    strength = np.full(n, len(BOUNDARIES))
    for level in range(len(BOUNDARIES) - 1, -1, -1):
        e = np.fromiter((m.end() for m in BOUNDARIES[level].finditer(raw)), dtype=np.int64)
        i = np.searchsorted(starts, e, side="right") - 1
        # a token may begin with the blank that ends the match
        strength[i[(starts[i] == e) | (starts[i] == e - 1)]] = level
    strength[~whole] = len(BOUNDARIES) + 1
    room = max(1, limit - overlap - SLACK)
    cuts: list[int] = []
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= room:
            continue
        mid, reach = (a + b) // 2, max(1, (b - a) // 4)
        for lo, hi in ((max(a + 1, mid - reach), min(b, mid + reach + 1)), (a + 1, b)):
            near = strength[lo:hi]
            if len(near) and near.min() <= len(BOUNDARIES):
                at = np.flatnonzero(near == near.min()) + lo
                cut = int(at[np.argmin(np.abs(at - mid))])
                cuts.append(cut)
                stack += [(a, cut), (cut, b)]
                break
    cuts = [0, *sorted(cuts), n]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        first = max(0, a - overlap)
        while first > 0 and not whole[first]:
            first -= 1
        out.append((first, a, b))
    return out


PIECES = "piece_no int, n_pieces int, start_byte bigint, own_byte bigint, end_byte bigint, n_tokens int, overlap_tokens int"


def pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY, whole: bool = False, with_text: bool = False) -> DataFrame:
    """Pieces of the texts that exceed the limit, in order, and of the others as one piece each if ``whole``."""
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    docs = docs.where(F.length("t") > 0) if whole else docs.where(F.octet_length("t") > limit)
    names = ["d", *[c.split()[0] for c in PIECES.split(", ")], *["piece"] * with_text]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(vocabulary)
        for b in batches:
            out = []
            for d, t in zip(b["d"], b["t"]):
                if not whole and tok.count(t) <= limit:
                    continue
                places = tok.ends(t)
                parts = bisect(t, tok, limit, overlap, places)
                raw = t.encode("utf-8", "surrogatepass") if with_text else b""
                ends = [0, *places.tolist()]
                for i, (first, own, end) in enumerate(parts):
                    row = [d, i, len(parts), ends[first], ends[own], ends[end], end - first, own - first]
                    out.append([*row, raw[ends[first] : ends[end]].decode("utf-8", "replace")] if with_text else row)
            yield pd.DataFrame(out, columns=names)

    kind = dict(docs.dtypes)["d"]
    return docs.mapInPandas(cut, f"d {kind}, {PIECES}" + ", piece string" * with_text).withColumnRenamed("d", doc_id)


def cover(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, bytes, covered, fits) of every text that is not empty, from its pieces.

    ``bytes``: where the last piece ends; ``covered``: whether the pieces' own parts follow one another without gap from
    the first byte on; ``fits``: whether no piece exceeds the limit and each but the first repeats the overlap.
    """
    p = pieces(documents, doc_id, text, limit, overlap, vocabulary, whole=True)
    order = Window.partitionBy(doc_id).orderBy("piece_no")  # as many rows as the text has pieces
    after = F.coalesce(F.lag("end_byte").over(order), F.lit(0))
    p = p.withColumn("follows", (F.col("own_byte") == after) & (F.col("end_byte") > F.col("own_byte")))
    fits = (F.col("n_tokens") <= limit) & ((F.col("piece_no") == 0) | (F.col("overlap_tokens") >= overlap))
    return p.groupBy(doc_id).agg(F.max("end_byte").alias("bytes"), (F.min("follows") & (F.count(F.lit(1)) == F.max("n_pieces"))).alias("covered"), F.min(fits).alias("fits"))
