"""Static word-piece vectors: tokenise, pool, quantise, search, with a fall back to words."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from . import search as S


class Model:
    """Pieces and their vectors; the first of equal tokens counts."""

    def __init__(self, model_id: str, vocab: list[str], rows: list[list[float]], unknown: str = "[UNK]"):
        dim = {len(r) for r in rows}
        if len(vocab) != len(rows) or len(dim) != 1:
            raise ValueError("vocabulary and rows do not fit")
        self.model_id, self.dim, self.unknown = model_id, dim.pop(), unknown
        self.number: dict[str, int] = {}
        for i, t in enumerate(vocab):
            self.number.setdefault(t, i)
        self.rows = np.array(rows, dtype=np.float64)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            m = json.load(f)
        return cls(m["modelId"], m["vocab"], m["weights"], m.get("unk", "[UNK]"))

    def pieces(self, text: str) -> list[int]:
        """Lower-case words without marks, cut greedily into the longest known pieces."""
        low = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
        out: list[int] = []
        for word in re.findall(r"[a-z0-9]+|[^\sa-z0-9]", low):
            at, own = 0, []
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.number), 0)
                if not end:
                    own = [self.number[self.unknown]] if self.unknown in self.number else []
                    break
                own.append(self.number[("##" if at else "") + word[at:end]])
                at = end
            out += own
        return out

    def encode(self, text: str) -> list[int]:
        """The mean of the pieces' vectors at unit length in 8-bit steps, halves to even; zeros where nothing is known."""
        ids = self.pieces(text)
        if not ids:
            return [0] * self.dim
        mean = self.rows[ids].sum(axis=0) / len(ids)
        norm = float(np.sqrt((mean * mean).sum()))
        return [0] * self.dim if norm == 0 else np.clip(np.rint(mean / norm * K.QUANTUM), -K.QUANTUM, K.QUANTUM).astype(int).tolist()


def letter_model(dim: int = 32, seed: int = 1) -> Model:
    """A model that knows every word of letters and digits: a fixed random vector for each one or two of them.

    It has learned nothing; words are alike as far as they share pairs. It stands in where no trained model is at hand.
    """
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    short = [*signs, *(a + b for a in signs for b in signs)]
    vocab = ["[UNK]", *short, *("##" + x for x in short)]
    return Model(f"letters-{dim}", vocab, np.random.RandomState(seed).standard_normal((len(vocab), dim)).tolist())


def units(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """What gets a vector: each named symbol of a file once, and files without symbols under their title or name."""
    s = symbols.where("name is not null").groupBy("file", "name").agg(F.min("line").alias("line")).select("file", F.col("name").alias("symbol"), "line", F.col("name").alias("text"))
    bare = files.join(symbols.select(F.col("file").alias("rel")).distinct(), "rel", "left_anti")
    return s.unionByName(bare.select(F.col("rel").alias("file"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("int").alias("line"), F.coalesce("title", "summary", "rel").alias("text")))


def build_index(unit_rows: DataFrame, model: Model | None = None, encoder: Callable[[list[str]], list[list[int]]] | None = None, batch: int = 64) -> DataFrame:
    """(file, symbol, line, vec). ``encoder``: another one, such as an HTTP endpoint, called with bounded batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            if encoder:
                vecs = [v for i in range(0, len(texts), batch) for v in encoder(texts[i : i + batch])]
            else:
                known = {t: model.encode(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t)) for t in dict.fromkeys(texts)}
                vecs = [known[t] for t in texts]
            yield b.drop(columns="text").assign(vec=vecs)

    return unit_rows.select("file", "symbol", "line", "text").mapInPandas(run, "file string, symbol string, line int, vec array<int>")


def endpoint(url: str, timeout: float = 30.0) -> Callable[[list[str]], list[list[int]]]:
    """An encoder behind POST url/embed; its vectors are quantised here. A malformed answer is an error."""

    def call(texts: list[str]) -> list[list[int]]:
        import urllib.request

        req = urllib.request.Request(url.rstrip("/") + "/embed", json.dumps({"texts": texts}).encode(), {"content-type": "application/json"})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            got = json.load(r).get("vectors")
        if not isinstance(got, list) or len(got) != len(texts) or any(not isinstance(v, list) or not all(isinstance(x, (int, float)) for x in v) for v in got):
            raise ValueError("the endpoint's answer is malformed")
        a = np.array(got, dtype=np.float64)
        norm = np.sqrt((a * a).sum(axis=1, keepdims=True))
        return np.clip(np.rint(np.divide(a, norm, out=np.zeros_like(a), where=norm > 0) * K.QUANTUM), -K.QUANTUM, K.QUANTUM).astype(int).tolist()

    return call


def healthy(url: str, timeout: float = 3.0) -> bool:
    """Whether an endpoint answers."""
    import urllib.request

    try:
        with urllib.request.urlopen(url.rstrip("/") + "/healthz", timeout=timeout) as r:
            return 200 <= r.status < 300
    except OSError:
        return False


def tier(model_path: str | None, url: str | None) -> tuple[str, str | None]:
    """Which vectors there are, endpoint, static or lexical (none), and why there are no better ones."""
    import os

    reason = None
    if url:
        if healthy(url):
            return "endpoint", None
        reason = f"the endpoint {url} does not answer"
    if model_path:
        if os.path.isfile(model_path):
            return "static", reason
        reason = reason or f"there is no model at {model_path}"
    return "lexical", reason or "neither a model nor an endpoint is named"


def semantic(index: DataFrame | None, query_vec: list[int] | None, lexical: DataFrame, limit: int = K.SEARCH_LIMIT, reason: str | None = None, tier: str = "static") -> DataFrame:
    """(file, score, tier, degraded_reason): the ranks of the best vector of each file and of the words, fused.

    ``lexical``: doc, score in its order. Without vectors the words alone rank, and the reason is given.
    """
    from pyspark.sql import Window

    # no more than the best of both go into the windows
    lexical = lexical.orderBy(F.desc("score"), "doc").limit(max(limit, 50))
    words = lexical.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "doc"))).select(F.col("doc").alias("file"), "r")
    if index is None or not query_vec:
        return lexical.select(F.col("doc").alias("file"), "score", F.lit("lexical").alias("tier"), F.lit(reason or "no vectors").alias("degraded_reason")).orderBy(F.desc("score"), "file").limit(limit)
    dots = S.nearest(index, query_vec, "file", "vec").groupBy("file").agg(F.max("dot").alias("dot")).where("dot > 0")
    top = dots.orderBy(F.desc("dot"), "file").limit(max(limit, 50))
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("dot"), "file"))).select("file", "r")
    out = S.fused([words, ranked], "file", "r")
    return out.select("file", "score", F.lit(tier).alias("tier"), F.lit(reason).cast("string").alias("degraded_reason")).orderBy(F.desc("score"), "file").limit(limit)
