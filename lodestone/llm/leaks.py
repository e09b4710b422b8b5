"""Evaluation passages in training text, by a prefix-filtered set join.

Items are cut into windows of ``words`` consecutive words, a window into shingles of ``shingle`` words. One pass over
the texts cleans each document and makes its shingles; whatever the number of items, there is no second one. The
shingles of all items set bits in a bitmap of fixed size, the only thing that goes to every task: a run of shingles
whose bits are set, long enough for a window, is written to the shared folder with its words. A window that a document
speaks has all of its shingles there, so no true case is lost, and a wrong bit costs a row and nothing else.

From the written runs come, over all documents, the counts that order shingles by rarity. The rarest shingle of a
window is its necessary prefix: runs and windows are joined on it alone. Its places in run and window give the one
place where the window can stand (positional bound), which must lie inside the run (length bound), and there the
window is compared word by word. Items, windows and runs are tables; none of them is collected.

Words are equal here if their keys are (letters that recognition confuses are one, see ``speech``), and at most
``DAMAGED`` of a window's words may differ in form, as single errors do, not other words. A form that only an error
gives (a digit among letters, a capital behind a small letter) does not count, and proves that the text was misread:
then up to ``MISREAD`` of the words may differ. Words that have no key (one
letter outside ASCII, which a wrong decoding destroys) are left out on both sides; a window that keeps fewer than
``LEAST`` words is not looked for. Words before a colon may be speakers' names in capitals: items are looked for with
and without those they have.

Defined results: null or empty texts on either side give no row; items with fewer than ``words`` words give none;
repeated documents each give their rows; repeated item ids are taken together; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .speech import Keys, spoken, word_form

WORDS, SHINGLE, LEAST = 12, 5, 8
DAMAGED, MISREAD = 0.25, 0.5
#: Bits of the map that tells which shingles items have: 2 MB in every task, whatever there is.
BITS = 1 << 24
_WORD = re.compile(r"\w")
MEMO = Keys()


class Forms(dict):
    """A 63-bit number for the form of each word, 0 for one that is misread for certain, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        form = word_form(word)
        n = self[word] = xxhash.xxh3_64_intdigest(form) >> 1 if form else 0
        return n


FORMS = Forms()


def _forms(words: list[str]) -> np.ndarray:
    return np.fromiter(map(FORMS.__getitem__, words), np.int64, len(words))


def shingle_ids(a: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit number for each run of k words. Verification compares words, so equal numbers do no harm."""
    if len(a) < k:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - k + 1 + i].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def item_windows(text: str, words: int = WORDS, shingle: int = SHINGLE, least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, forms, shingles) of each window of an item, with the words it has before colons and without."""
    own = [w for w in text.split() if _WORD.search(w)]
    named = [w.rstrip("\"'»").endswith(":") for w in own]
    out: dict[tuple, tuple] = {}
    for i in range(len(own) - words + 1):
        part = own[i : i + words]
        for drop in (False, True) if any(named[i : i + words]) else (False,):
            kept = [w for w, n in zip(part, named[i : i + words]) if MEMO[w] and not (drop and n)]
            if len(kept) >= least:
                k, f = np.array([MEMO[w] for w in kept], np.int64), _forms(kept)
                out[tuple(f.tolist())] = (k, f, shingle_ids(k, shingle))
    return list(out.values())


def _runs(seqs: list[tuple[int, list[str], list[int]]], bits: np.ndarray, shingle: int, need: int) -> Iterator[tuple]:
    """(document, keys, forms, shingles) of each run of at least ``need`` shingles whose bits are set."""
    sizes = [len(n) for _, _, n in seqs]
    first_of = np.cumsum([0, *sizes])
    k = np.concatenate([np.array(n, np.int64) for _, _, n in seqs] or [np.zeros(0, np.int64)])
    if len(k) < shingle:
        return
    of = np.repeat(np.arange(len(seqs)), sizes)
    s = shingle_ids(k, shingle)
    at = s.view(np.uint64) % np.uint64(BITS)
    hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool) & (of[: len(s)] == of[shingle - 1 :])
    # a run ends where a bit is not set or another document begins
    first = hit.copy()
    first[1:] &= ~hit[:-1] | (of[1 : len(s)] != of[: len(s) - 1])
    starts = np.flatnonzero(first)
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (of[1 : len(s)] != of[: len(s) - 1])
    ends = np.flatnonzero(last) + 1
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= need:
            doc, words, _ = seqs[of[a]]
            own = words[a - first_of[of[a]] : b + shingle - 1 - first_of[of[a]]]
            yield doc, k[a : b + shingle - 1], _forms(own), s[a:b]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that speak ``words`` consecutive words of an item."""
    spark = documents.sparkSession
    least = min(words, max(shingle, LEAST))
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, *w) for i, t in zip(b["i"], b["t"]) for n, w in enumerate(item_windows(t, words, shingle, least))]
            yield pd.DataFrame(rows, columns=["i", "w", "wk", "wf", "ws"])

    windows = written(wanted.mapInPandas(cut, "i bigint, w int, wk array<bigint>, wf array<bigint>, ws array<bigint>"), "windows")
    # no more rows than the map has words
    bit = windows.select(F.explode("ws").alias("s")).select(F.pmod("s", F.lit(BITS)).alias("bit"))
    filled = bit.selectExpr("bit div 64 word", "shiftleft(1L, int(bit % 64)) b").groupBy("word").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[filled["word"].to_numpy(np.int64)] = filled["b"].to_numpy(np.int64).view(np.uint64)
    need = least - shingle + 1
    sent = spark.sparkContext.broadcast(bits)

    def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seqs = [(d, *said) for d, t in zip(b["d"], b["t"]) for said in spoken(t, MEMO)]
            yield pd.DataFrame(list(_runs(seqs, sent.value, shingle, need)), columns=["d", "k", "f", "s"])

    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    runs = written(docs.mapInPandas(speak, "d bigint, k array<bigint>, f array<bigint>, s array<bigint>"), "spoken")

    counted = runs.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    places = windows.select("i", "w", F.posexplode("ws").alias("place", "s")).join(counted, "s", "left")
    rarest = places.groupBy("i", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "s")).alias("p")).where("p.n > 0")  # else no document speaks it
    prefixes = rarest.join(windows.select("i", "w", "wk", "wf"), ["i", "w"]).select("i", "wk", "wf", F.col("p.place").alias("place"), F.col("p.s").alias("s"))
    met = runs.select("d", "k", "f", F.posexplode("s").alias("pos", "s")).join(prefixes, "s")
    start, size = F.col("pos") - F.col("place"), F.size("wk")
    at = F.greatest(start, F.lit(0)) + 1
    met = met.where((start >= 0) & (start + size <= F.size("k")) & (F.slice("k", at, size) == F.col("wk")))
    said = F.slice("f", at, size)
    other = F.size(F.filter(F.zip_with("wf", said, lambda a, b: (a != b) & (b != 0)), lambda x: x))
    most = size * F.when(F.array_contains(said, 0), MISREAD).otherwise(DAMAGED)
    return met.where(other <= most).select(F.col("d").alias(doc_id), F.col("i").alias(item_id)).distinct()
