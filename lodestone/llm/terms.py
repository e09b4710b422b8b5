"""Frequency of every distinct term by a global integer dictionary and count arrays.

1. Dictionary: the distinct terms of all fields, each with a number. Numbers run through each of the dictionary's
   partitions, which are the identifier ranges (upper bits: range, lower bits: place in it). It is a written table;
   the same pass over the rows counts the records of each field.
2. Encoding: rows (term, record, place) become rows (number, record, place) by one join with the dictionary. Terms
   with at least 1/200 of all rows are 200 at most; they get their numbers by broadcast where they stand and then are
   spread by record, so no hot term meets in one task.
3. Blocks: the encoded rows of a partition, in which no pair of term and record is split, come in order of number,
   record and place, and are counted a batch at a time: occurrences and records in arrays, cut by identifier range.
   A batch knows the last row of the one before, so a block takes the room of a batch.
4. The arrays are summed range by range, and the sums are given their terms again.

Defined results: null terms and null records are left out; a repeated row (same field, term, record and place)
counts once; an empty table gives no rows; long terms are terms like others; other columns are not looked at.
Records are told apart by 96 bits of hashes of their name, places by 64 bits of the row and the number of the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import clean, written

#: monotonically_increasing_id puts the partition above this bit and counts rows below it.
RANGE_BITS = 33
HOT = 200
RARE_RECORDS, COMMON_SHARE = 1, 0.05
_ARRAYS = "range bigint, places array<bigint>, occurrences array<bigint>, records array<bigint>"
_KEY = ["id", "record", "record2", "place", "word"]


def field_rows(df: DataFrame, field: int, term: Column, record: Column, place: list[Column], word: Column | None = None) -> DataFrame:
    """(field, term, record, record2, place, word): ``place`` and ``word`` tell the occurrences in a record apart."""
    rows = df.select(F.lit(field).alias("field"), term.alias("term"), record.alias("_r"), F.xxhash64(*place).alias("place"), (F.lit(0) if word is None else word).alias("word"))
    rows = rows.where(F.col("term").isNotNull() & F.col("_r").isNotNull())
    return rows.select("field", "term", F.xxhash64("_r").alias("record"), F.hash(F.lit("second"), "_r").alias("record2"), "place", "word")


def words_of(column: str) -> Column:
    """The maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def _count_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of ``_KEY``; counts of each batch, in which what the batch before has counted is left out."""
    before: list[int] | None = None
    for b in batches:
        if not len(b):
            continue
        columns = [b[c].to_numpy(np.int64) for c in _KEY]
        changed = []
        for i, c in enumerate(columns):
            d = np.ones(len(b), bool)
            d[1:] = c[1:] != c[:-1]
            d[0] = before is None or before[i] != c[0]
            changed.append(d)
        new_record = changed[0] | changed[1] | changed[2]
        new_row = new_record | changed[3] | changed[4]
        before = [int(c[-1]) for c in columns]
        own, at = np.unique(columns[0], return_inverse=True)
        occurrences = np.bincount(at, weights=new_row).astype(np.int64)
        present = np.bincount(at, weights=new_record).astype(np.int64)
        ranges, offsets = own >> RANGE_BITS, own & ((1 << RANGE_BITS) - 1)
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        yield pd.DataFrame({"range": ranges[np.r_[0, cuts]], "places": np.split(offsets, cuts), "occurrences": np.split(occurrences, cuts), "records": np.split(present, cuts)})


def _sum_range(rows: pd.DataFrame) -> pd.DataFrame:
    places = np.concatenate(rows["places"].to_list())
    size = int(places.max()) + 1
    occurrences, records = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(occurrences, places, np.concatenate(rows["occurrences"].to_list()))
    np.add.at(records, places, np.concatenate(rows["records"].to_list()))
    some = np.flatnonzero(records)
    return pd.DataFrame({"id": (int(rows["range"].iloc[0]) << RANGE_BITS) + some, "occurrences": occurrences[some], "records": records[some]})


def dictionary(rows: DataFrame) -> DataFrame:
    """(field, term, n, id): the distinct terms with their rows and numbers; and (field, null, n, null): the records of each field.

    Both come from one pass: a row stands once under its term and once under its record.
    """
    both = rows.select("field", F.explode(F.array(F.struct("term", F.lit(None).cast("bigint").alias("record"), F.lit(None).cast("int").alias("record2")), F.struct(F.lit(None).cast("string").alias("term"), "record", "record2"))).alias("x"))
    counted = both.groupBy("field", "x.term", "x.record", "x.record2").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.select("field", "term", "n", F.when(F.col("term").isNotNull(), F.monotonically_increasing_id()).alias("id")), "dictionary")


def term_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Counts (id, occurrences, records) of every term, the dictionary that names them, and the records of each field."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = dictionary(rows)
    named = every.where("term is not null")
    sizes = every.groupBy("field").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("rows"), F.count_if(F.col("term").isNull()).alias("records")).collect()  # one row a field
    total = max(1, sum(r["rows"] for r in sizes))
    hot = named.where(F.col("n") * HOT >= total).select("field", "term", F.col("id").alias("hot"))  # at most HOT rows
    # An explicit number of partitions: neither split nor merged at run time, so a term's rows stay together.
    # A hot row has a number already; it matches no term of the dictionary and goes by its record.
    spread = F.when(F.col("hot").isNotNull(), F.col("record")).otherwise(0)
    placed = rows.join(F.broadcast(hot), ["field", "term"], "left").withColumn("term", F.when(F.col("hot").isNull(), F.col("term")).otherwise("")).withColumn("spread", spread)
    placed = placed.repartition(partitions, "field", "term", "spread")
    cold = named.where(F.col("n") * HOT < total).select("field", "term", F.least("n", F.lit(0)).alias("spread"), F.col("id").alias("cold"))  # 0, but no constant: both sides are to be placed by the same three columns
    met = placed.join(cold.repartition(partitions, "field", "term", "spread").hint("shuffle_hash"), ["field", "term", "spread"], "left")
    encoded = met.select(F.coalesce("hot", "cold").alias("id"), *_KEY[1:]).sortWithinPartitions(*_KEY)
    blocks = encoded.mapInPandas(_count_block, _ARRAYS)
    return blocks.groupBy("range").applyInPandas(_sum_range, "id bigint, occurrences bigint, records bigint"), named, {r["field"]: r["records"] for r in sizes}


def marked(rows: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """(field, term, occurrences, records, mark): mark is rare, common or null; rare goes first."""
    counts, named, limits = term_counts(rows)
    share = F.lit(None).cast("double")
    for field, n in limits.items():
        share = F.when(F.col("field") == field, F.lit(common * n)).otherwise(share)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > share, "common")
    return counts.join(named.select("id", "field", "term"), "id").select("field", "term", "occurrences", "records", mark.alias("mark"))


def index_rows(idents: DataFrame, symbols: DataFrame, headings: DataFrame) -> DataFrame:
    """The rows of the three fields: 0 identifiers, 1 symbol names, 2 words of headings."""
    a = field_rows(idents, 0, clean("ident"), clean("file"), [F.lit(0)])
    b = field_rows(symbols, 1, clean("name"), clean("file"), [F.col("pos")])
    words = headings.select("rel", "pos", clean("heading").alias("h"), F.posexplode(words_of("heading")).alias("i", "word"))
    c = field_rows(words, 2, F.col("word"), clean("rel"), [F.col("pos"), F.col("h")], F.col("i"))
    return a.unionByName(b).unionByName(c)


FIELDS = {0: "ident", 1: "symbol", 2: "heading"}
