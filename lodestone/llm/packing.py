"""Filling containers of fixed capacity: conflict-constrained best fit.

Each text is an item of as many tokens as it has; of a text above the capacity, full containers are cut off and
the rest is an item. Items are spread by hash over groups of bounded size (so a hot source is spread as well) and
packed in each group from the largest to the smallest: open bins stand in order of their residual room, each with
a bitmap of its sources and one of its duplicate clusters, and the search goes on from the smallest residual that
is large enough to the next ones until a bin is found whose bitmaps do not meet the item's. Items of bins that
stay too empty are packed once more, over larger parts of the collection.

A duplicate cluster (texts equal up to white space and case) never has two members in a container, nor has a
source. Where a source has more items than that leaves room for, its items stand in emptier containers: no item is
dropped.

Defined results: null and empty texts are in no container; a null source conflicts with nothing; repeated rows are
items of their own (and of one duplicate cluster); ties in size go to the smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tokens import VOCABULARY, tokenizer

CAPACITY, GROUP, FULL = 2048, 16_000, 0.97


class Bins:
    """Open bins by residual room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0  # bit r is set if a bin with r tokens of room exists
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> int:
        """The number of the bin that takes the item: the tightest compatible one, else a new one."""
        mask = self.open >> size << size
        while mask:
            low = mask & -mask
            room = low.bit_length() - 1
            for i, b in enumerate(self.at[room]):
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    self.at[room].pop(i)
                    if not self.at[room]:
                        self.open ^= low
                    return self._seat(b, room - size, source, cluster)
            mask ^= low
        self.sources.append(0)
        self.clusters.append(0)
        return self._seat(len(self.sources) - 1, self.capacity - size, source, cluster)

    def _seat(self, b: int, room: int, source: int, cluster: int) -> int:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if room:
            self.at[room].append(b)
            self.open |= 1 << room
        return b


def pack_group(items: pd.DataFrame, capacity: int = CAPACITY) -> pd.Series:
    """Bin numbers for items (item, size, source, cluster). Bits are given only to sources and clusters that recur."""
    items = items.sort_values(["size", "item", "piece_no"], ascending=[False, True, True])
    bits = []
    for c in ("source", "cluster"):
        n = items[c].value_counts()
        again = {v: 1 << i for i, v in enumerate(n.index[n > 1])}
        bits.append([again.get(v, 0) for v in items[c]])
    bins = Bins(capacity)
    return pd.Series([bins.put(s, a, b) for s, a, b in zip(items["size"], *bits)], index=items.index)


def _sized(documents: DataFrame, doc_id: str, text: str, source: str, vocabulary: str, capacity: int) -> DataFrame:
    docs = documents.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("bigint").alias("item"), F.col(text).alias("t"), F.xxhash64(source).alias("s"), F.col(source).isNull().alias("none"))

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(vocabulary)
        for b in batches:
            same = [int.from_bytes(hashlib.blake2b(" ".join(t.lower().split()).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for t in b["t"]]
            source_of = b["s"].where(~b["none"], ~b["item"])
            yield pd.DataFrame({"item": b["item"], "tokens": [tok.count(t) for t in b["t"]], "source": source_of, "cluster": same})

    return written(docs.mapInPandas(size, "item bigint, tokens int, source bigint, cluster bigint"), "sized")


def _packed(items: DataFrame, groups: int, capacity: int, stage: int) -> DataFrame:
    """Items with (container, fill): container numbers are unique over groups and stages."""
    schema = "item bigint, piece_no int, size int, source bigint, cluster bigint, container bigint, fill int"
    base = stage << 56

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["g"].iloc[0])
        rows = rows.drop(columns="g")
        number = pack_group(rows, capacity)
        rows["container"] = base + (group << 32) + number
        rows["fill"] = rows.groupby("container")["size"].transform("sum").astype("int32")
        return rows

    spread = items.withColumn("g", F.pmod(F.xxhash64("item", "piece_no", F.lit(stage)), F.lit(groups)).cast("int"))
    return spread.groupBy("g").applyInPandas(pack, schema)


def containers(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, group: int = GROUP, full: float = FULL, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container, fill) of every text; whole texts have piece_no 0."""
    sized = _sized(documents, doc_id, text, source, vocabulary, capacity)
    n = sized.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    groups = max(1, -(-n // group))
    rest = (F.col("tokens") - F.floor((F.col("tokens") - 1) / capacity) * capacity).cast("int")
    number = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    items = sized.where("tokens > 0").select("item", number.alias("piece_no"), rest.alias("size"), "source", "cluster")
    first = written(_packed(items, groups, capacity, 1), "packed")
    good = F.col("fill") >= F.lit(int(full * capacity))
    again = _packed(first.where(~good).select("item", "piece_no", "size", "source", "cluster"), max(1, -(-groups // 8)), capacity, 2)
    cut = sized.where(F.col("tokens") > capacity).select("item", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece_no"))
    own = (F.lit(3 << 56).cast("bigint") + F.pmod(F.xxhash64("item", "piece_no"), F.lit(1 << 55))).alias("container")
    cut = cut.select("item", "piece_no", F.lit(capacity).alias("size"), own, F.lit(capacity).alias("fill"))
    names = ["item", "piece_no", "size", "container", "fill"]
    out = first.where(good).select(names).unionByName(again.select(names)).unionByName(cut)
    return out.select(F.col("item").alias(doc_id), "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.col("size").alias("n_tokens"), "container", "fill")


def placed(documents: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, whole, fits, apart) of every text in a container, from the containers that were made.

    ``whole``: its pieces follow one another, and one below the capacity is a single piece; ``fits``: none of its
    containers holds more than the capacity or other than it says; ``apart``: none holds a second text of its source
    or one equal to it up to white space and case.
    """
    same = F.xxhash64(F.trim(F.regexp_replace(F.lower(F.col(text)), r"(?U)\s+", " ")))
    told = documents.where(F.length(text) > 0).select(F.col(doc_id).alias("_d"), F.xxhash64(source).alias("_s"), F.col(source).isNotNull().alias("_named"), same.alias("_c"))
    x = packed.join(told, packed[doc_id] == told["_d"])
    held = x.groupBy("container").agg(F.sum("n_tokens").alias("held"), F.max("fill").alias("fill"))
    twice = [x.where("_named").groupBy("container", F.col("_s").alias("_k")), x.groupBy("container", F.col("_c").alias("_k"))]
    # the pieces of one text have one source and one cluster, but containers of their own
    met = [g.agg(F.count_distinct(doc_id).alias("n")).where("n > 1").select("container") for g in twice]
    clash = met[0].unionByName(met[1]).distinct().withColumn("clash", F.lit(True))
    y = x.join(held.select("container", F.col("held"), F.col("fill").alias("_fill")), "container").join(clash, "container", "left")
    follows = F.count(F.lit(1)) == F.max("piece_no") + 1
    sized = (F.sum("n_tokens") > F.max("piece_no") * capacity) & (F.sum("n_tokens") <= (F.max("piece_no") + 1) * capacity)
    return y.groupBy(doc_id).agg((follows & sized).alias("whole"), F.min((F.col("held") <= capacity) & (F.col("held") == F.col("_fill"))).alias("fits"), F.min(F.col("clash").isNull()).alias("apart"))
