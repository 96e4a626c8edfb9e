"""Packing by concatenation: all documents' ids in one stream, cut into fixed windows.

First pass: ids are written once, each row with the ids of its part before it. Second pass: a prefix
sum over the parts' totals (one row a part) gives every row its global offset, and rows are cut where
a window of the stream ends. A piece is the record of one row in one window.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringside.llm import subwords
from ringside.llm.common import mapped, store

LENGTH = 2048
#: Words of a generation that a worker remembers, and bytes of text in which a word is looked up once, beside other
#: operators: an executor may keep more workers than it has cores, each with its own words, and what others left in its JVM.
REMEMBERED, BLOCK = 125_000, 2 << 20


def placed(tokens: DataFrame) -> DataFrame:
    """`tokens` (part, at, n_tokens, ...) with first: the ids of all rows before, in order of part and place in it."""
    # one small row a part, never one a document: 16 bytes for each task that encoded
    parts = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return tokens.join(F.broadcast(offsets), "part").withColumn("first", F.col("before") + F.col("at")).drop("before")


def cut(tokens: DataFrame, width: int, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """Pieces of `tokens` (key, n_tokens, ids, first): key, start, length, doc_tokens, sequence_id, offset, ids."""
    rows = tokens.select(F.col(f"`{key}`").alias(key), "n_tokens", "ids", "first")
    schema = rows.select(key).schema.add("start", "long").add("length", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long").add("ids", "binary")

    names = schema.names

    def run(batches):
        for batch in batches:
            n, first = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            ids = batch.column(2)
            last = np.maximum(first + n - 1, first)
            pieces = np.where(n > 0, last // length - first // length + 1, 0)
            row = np.repeat(np.arange(len(n)), pieces)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + turn
            start = np.maximum(sequence * length, first[row]) - first[row]
            end = np.minimum((sequence + 1) * length, first[row] + n[row]) - first[row]
            for lo in range(0, len(row), 10_000):
                s = slice(lo, lo + 10_000)
                body, at = [], -1
                for r, a, b in zip(row[s].tolist(), start[s].tolist(), end[s].tolist()):
                    if r != at:
                        at, whole = r, ids[r].as_py()
                    body.append(whole[a * width:b * width])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[s])), pa.array(start[s]), pa.array((end - start)[s]), pa.array(n[row][s]),
                                                  pa.array(sequence[s]), pa.array((first[row] + start)[s] % length), pa.array(body, pa.binary())], names=names)

    return mapped(rows, run, schema)


def packed(docs: DataFrame, path: str, end: int = 1, length: int = LENGTH, key: str = "doc_id", text: str = "text", remembered: int | None = None, most: int | None = None) -> DataFrame:
    """Pieces of all documents; every sequence is full but the last. Null texts are empty: their end id alone.
    Rows with a null key are packed like others; an empty table gives no pieces. Pieces don't depend on `remembered` and
    `most` (None for REMEMBERED and BLOCK): a job that packs and does nothing else has room for more."""
    tokens = store(subwords.encoded(docs, path, end, text, (key,), most or BLOCK, remembered or REMEMBERED), "ids")
    return cut(placed(tokens), subwords.id_width(path), length, key)
