"""Consecutive rows of a table in key order, without a sort in one task and with one shuffle of the texts."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ringside.llm.common import blocks, give_back, mapped

#: Bytes of text that `function` sees at once; what it makes of a text may be several times as long.
BLOCK = 1 << 20


def with_next(docs: DataFrame, function: Callable[[list, list[bytes], list[bytes]], pa.RecordBatch], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """function(keys, texts, next texts) over blocks of rows in ascending key order; the last row is followed by the first.

    Rows are dealt to buckets by quantiles of the key. The first row of each bucket is sent to the bucket
    before it too, as a boundary record, so every bucket knows what follows its last row. Keys are integers;
    null keys come last, rows of one key in the order of a hash of the text. Null texts are empty.
    """
    spark = docs.sparkSession
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), body.alias("text"), F.xxhash64(body).alias("tie"))
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / number for i in range(1, number)] if number > 1 else [0.5], 20_000)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))  # one number a bucket

    def bucket_of(keys: pa.Array) -> np.ndarray:
        null = keys.is_null().to_numpy(zero_copy_only=False)
        return np.where(null, len(bounds), np.searchsorted(bounds, keys.fill_null(0).to_numpy(), side="right"))

    def least(batches):
        found: dict[int, tuple] = {}
        for batch in batches:
            for b, k, t in zip(bucket_of(batch.column(0)).tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = (k is None, k or 0, t)
                if b not in found or own < found[b]:
                    found[b] = own
        if found:
            b, own = zip(*sorted(found.items()))
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*own), (pa.bool_(), pa.int64(), pa.int64())))], names=["bucket", "unkeyed", "key", "tie"])

    firsts = (mapped(rows.select("key", "tie"), least, "bucket int, unkeyed boolean, key bigint, tie bigint")
              .groupBy("bucket").agg(F.min(F.struct("unkeyed", "key", "tie")).alias("first")).orderBy("bucket").collect())  # one row a bucket
    before = {r.bucket: firsts[i - 1].bucket for i, r in enumerate(firsts)}
    opens = {(r.first.unkeyed, r.first.key, r.first.tie): r.bucket for r in firsts}

    def deal(batches):
        sent = set()
        for batch in batches:
            bucket = bucket_of(batch.column(0)).astype(np.int32)
            edge = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                b = opens.get((k is None, k or 0, t))
                if b is not None and b not in sent:
                    sent.add(b)
                    edge.append((i, before[b]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(bucket), bool)), *batch.columns], names=["bucket", "follows", "key", "text", "tie"])
            if edge:
                at = pa.array([i for i, _ in edge])
                yield pa.RecordBatch.from_arrays([pa.array([b for _, b in edge], pa.int32()), pa.array([True] * len(edge)), *(c.take(at) for c in batch.columns)],
                                                 names=["bucket", "follows", "key", "text", "tie"])

    dealt = mapped(rows, deal, "bucket int, follows boolean, key bigint, text string, tie bigint").repartition("bucket")
    dealt = dealt.sortWithinPartitions("bucket", "follows", F.asc_nulls_last("key"), "tie")

    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, key, text) of the row whose follower isn't known yet
        for block, texts in blocks(batches, most=BLOCK):
            keys, bodies, nexts = [], [], []
            for b, follows, k, t in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), block.column(2).to_pylist(), texts):
                if last is not None and last[0] == b:
                    keys.append(last[1])
                    bodies.append(last[2])
                    nexts.append(t)
                    last = None
                if not follows:
                    last = (b, k, t)
            if keys:
                yield function(keys, bodies, nexts)
        give_back()

    return mapped(dealt, run, schema)
