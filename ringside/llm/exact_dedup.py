"""Exact dedup against a history, through minimal perfect hashes of its distinct digests.

The digests of the historical rows are grouped, cut into buckets by their first bytes, and each
bucket gets a minimal perfect hash: level by level, digests that have a bit of a level's bit array
to themselves settle there, the others go on; a digest's slot is the rank of its bit. A slot holds
the whole digest and the locator of the row that stays. Incoming digests, grouped before they are
shuffled, are looked up: the slot's digest is compared byte by byte, so that digests outside the
history, which also hit some slot, are told apart. Members are repeats of the slot's row,
nonmembers form groups of their own.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringside.llm.common import WHITE, keyed, mapped, mixed, store

#: Digests for which a bucket is meant; a bit array has GAMMA bits for each digest of its level.
BUCKET_KEYS, GAMMA, LEVELS = 50_000, 2.0, 48


class PerfectHash:
    """Slots 0 to n-1 for n distinct 32-byte digests."""

    def __init__(self, digests: np.ndarray):
        self.levels, self.n = [], len(digests)
        left, settled, order = np.arange(self.n), 0, []
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
        while len(left) and len(self.levels) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            place = self._place(words[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, bool)
            bits[place[alone]] = True
            self.levels.append((bits, settled + np.cumsum(bits) - bits))
            order.append(left[alone][np.argsort(place[alone])])
            settled += int(alone.sum())
            left = left[~alone]
        #: digests that no level parts (practically none): compared one by one
        self.rest = {digests[i].tobytes(): settled + j for j, i in enumerate(left)}
        order.append(left)
        self.order = np.concatenate(order).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.digests = digests[self.order]

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(words[:, 1] + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64) * (words[:, 2] | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not held."""
        out = np.full(len(digests), -1, np.int64)
        open_, words = np.arange(len(digests)), np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
        for level, (bits, rank) in enumerate(self.levels):
            if not len(open_):
                break
            place = self._place(words[open_], level, len(bits))
            hit = bits[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        for i in open_:
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        member = out >= 0
        member[member] = (self.digests[out[member]] == digests[member]).all(1)  # byte by byte
        out[~member] = -1
        return out


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, runs of white space replaced by one space; null is empty."""
    return F.unhex(F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), "utf-8"), 256))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _verdicts(batches):
    """Rows sorted by (bucket, incoming): a bucket's history fills its slots, its incoming digests are looked up."""
    names = ["digest", "winner", "group_size", "from_history"]

    def out(block, digests, winners, sizes, old):
        return pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in digests], pa.binary()), winners.cast(block.schema.field("winner").type),
                                           pa.array(sizes, pa.int64()), pa.array(np.full(len(digests), old))], names=names)

    bucket, parts, index, locators, counts, last = None, [], None, None, None, None

    def close():
        if index is None:
            seal()
        if index is not None and index.n:
            for at in range(0, index.n, 20_000):
                yield out(last, index.digests[at:at + 20_000], locators.slice(at, 20_000), counts[at:at + 20_000], True)

    def seal():
        nonlocal index, locators, counts
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks()
            index = PerfectHash(_matrix(table["digest"].combine_chunks()))
            order = pa.array(index.order)
            locators = table["winner"].combine_chunks().take(order)
            counts = table["n"].to_numpy()[index.order].copy()
        else:
            index = PerfectHash(np.zeros((0, 32), np.uint8))

    for batch in batches:
        keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            block = batch.slice(lo, hi - lo)
            if bucket is not None and keys[lo] // 2 != bucket:
                yield from close()
                parts, index = [], None
            bucket, last = keys[lo] // 2, block
            if keys[lo] % 2 == 0:
                parts.append(block)
                continue
            if index is None:
                seal()
            digests, sizes = _matrix(block.column(2)), block.column(4).to_numpy()
            slot = index.slots(digests)
            np.add.at(counts, slot[slot >= 0], sizes[slot >= 0]) if index.n else None
            new = slot < 0
            if new.any():
                yield out(block, digests[new], block.column(3).filter(pa.array(new)), sizes[new], False)
    if bucket is not None:
        yield from close()


def verdicts(rows: DataFrame, historical: Column, order: Column) -> DataFrame:
    """One row per distinct digest: digest, winner (the least `order` struct), group_size, from_history.

    `rows` has a column `digest`. A digest found in the history keeps the history's winner, whatever
    comes in later; others are won by their own least row. An empty table gives no rows.
    """
    grouped = (rows.groupBy(F.when(F.coalesce(historical, F.lit(False)), 0).otherwise(1).alias("incoming"), "digest")
               .agg(F.min(order).alias("winner"), F.count(F.lit(1)).alias("n")))
    grouped = store(grouped.select("incoming", "digest", "winner", "n"), "digests")
    buckets = max(1, -(-grouped.where("incoming = 0").count() // BUCKET_KEYS), int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")
    rows = grouped.select(bucket, "incoming", "digest", "winner", "n").repartition("bucket").sortWithinPartitions("bucket", "incoming")
    winner = grouped.schema["winner"].dataType.simpleString()
    return mapped(rows, _verdicts, f"digest binary, winner {winner}, group_size bigint, from_history boolean")


def assign(rows: DataFrame, historical: Column, key: str = "doc_id") -> DataFrame:
    """Every row of `rows` (rid, digest, `key`) with keep_id, keep_rid, group_size and kept.

    The row of smallest key stays, rows without a key come last, and of rows with one key the first
    read stays; just one row of a group is kept.
    """
    order = F.struct(F.col(key).isNull().alias("unkeyed"), F.col(key).alias("id"), F.col("rid"))
    found = verdicts(rows, historical, order)
    found = found.select("digest", F.col("winner.id").alias("keep_id"), F.col("winner.rid").alias("keep_rid"), "group_size", "from_history")
    return rows.join(found, "digest").withColumn("kept", F.col("rid") == F.col("keep_rid"))


def lower_half(rows: DataFrame, key: str = "doc_id") -> Column:
    """History: the rows up to the (approximate) median key, which all earlier rows precede."""
    middle = rows.agg(F.percentile_approx(key, F.lit(0.5))).first()[0]
    return F.col(key) <= F.lit(middle) if middle is not None else F.lit(False)


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows, one of each group of equal texts: that of smallest key."""
    rows = keyed(docs, "exact", digest=digest(docs[f"`{text}`"]))
    narrow = rows.select("rid", "digest", F.col(f"row.`{key}`").alias("id"))
    found = assign(narrow, lower_half(narrow, "id"), "id")
    gone = store(found.where(~F.col("kept")).select("rid"), "gone")  # written first, so that the join knows its size
    return rows.join(gone, "rid", "left_anti").select("row.*")
