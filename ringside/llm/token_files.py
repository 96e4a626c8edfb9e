"""Token files: ids by frequency rank, byte-aligned, control bytes apart from data bytes.

The most frequent id has rank 0. A rank takes 1 to 4 bytes, least first; a control byte holds the
lengths of four ranks, 2 bits each. A file holds whole documents in key order:

    magic  8 bytes      b"RSRANKS1"
    counts 2 x uint64   documents, ids
    valid  1 byte a document (0: its key is null), then int64 keys, then uint64 id counts
    control bytes, then data bytes

Ranks are turned back by `ranks.bin` beside the files: the uint32 ids in rank order. Decoding is
a table lookup: 256 control bytes give four lengths each, and a running sum the data's places.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringside.llm import files, subwords
from ringside.llm.common import blocks, mapped, new_path, spread, store

MAGIC = b"RSRANKS1"
#: Ids meant for one file; a file is closed at twice as many.
FILE_IDS = 4_000_000
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
_BYTES = np.arange(4)
#: Bytes of text in which a word is looked up once when encoding.
BLOCK = 8 << 20


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[_BYTES < lengths[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_BYTES < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def frequency_order(tokens: DataFrame, width: int) -> np.ndarray:
    """All ids that occur, most frequent first, ties by id; at most one row for each id of the vocabulary."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for _, bodies in blocks(batches, "ids"):
            counts = np.bincount(np.frombuffer(b"".join(bodies), f"<u{width}"))
            if len(counts) > len(total):
                total = np.pad(total, (0, len(counts) - len(total)))
            total[:len(counts)] += counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = mapped(tokens.select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    return np.array([r.id for r in rows], "<u4")


def write(docs: DataFrame, path: str, end: int = 1, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Encode all documents into files; the folder, and a manifest (file, n_ids) of them.

    Files are in ascending key order, null keys last, rows of one key in the order they are read.
    Keys are integers or null; an empty table gives no file.
    """
    spark, width = docs.sparkSession, subwords.id_width(path)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.monotonically_increasing_id().alias("rid"), docs[f"`{text}`"].alias("text"))
    tokens = store(subwords.encoded(rows, path, end, "text", ("key", "rid"), BLOCK).drop("part", "at"), "ids", "zstd")
    order = frequency_order(tokens, width)
    folder = new_path(spark, "token-files")
    files.make_folder(folder)
    ranks = files.Writer(f"{folder}/ranks.bin")
    ranks.write(order.tobytes())
    ranks.close()
    parts = max(1, -(-int(tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]) // FILE_IDS))
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, "<u4")
    rank_of[order] = np.arange(len(order), dtype="<u4")
    held = spark.sparkContext.broadcast(rank_of)  # as many entries as the vocabulary has

    def run(batches):
        from pyspark import TaskContext
        part, turn, keys, bodies, held_ids = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            name = f"{part:08d}-{turn:06d}.ids"
            counts = np.array([len(b) // width for b in bodies], "<u8")
            control, data = pack(held.value[np.frombuffer(b"".join(bodies), f"<u{width}")])
            out = files.Writer(f"{folder}/{name}")
            for x in (MAGIC, np.array([len(keys), int(counts.sum())], "<u8").tobytes(), np.array([k is not None for k in keys], np.uint8).tobytes(),
                      np.array([k or 0 for k in keys], "<i8").tobytes(), counts.tobytes(), control, data):
                out.write(x)
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(counts.sum())])], names=["file", "n_ids"])

        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                bodies.append(b.as_py())
                held_ids += len(bodies[-1]) // width
                if held_ids >= 2 * FILE_IDS:
                    yield flush()
                    turn, keys, bodies, held_ids = turn + 1, [], [], 0
        if keys:
            yield flush()

    sort = [F.asc_nulls_last("key"), F.asc("rid")]
    rows = tokens.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    return folder, store(mapped(rows.select("key", "ids"), run, "file string, n_ids bigint"), "manifest")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids (little-endian uint32) of every document in the files."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    named = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))

    def run(batches):
        with files.reader(f"{folder}/ranks.bin") as stream:
            ids_by_rank = np.frombuffer(stream.read(), "<u4")
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                with files.reader(f"{folder}/{name}") as stream:
                    if stream.read(8) != MAGIC:
                        raise ValueError(f"{name} is no token file")
                    n, total = (int(x) for x in np.frombuffer(stream.read(16), "<u8"))
                    valid, keys = np.frombuffer(stream.read(n), np.uint8), np.frombuffer(stream.read(8 * n), "<i8")
                    counts = np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
                    ids = ids_by_rank[unpack(stream.read(-(-total // 4)), stream.read(), total)]
                ends = np.cumsum(counts)
                for lo in range(0, n, 2000):
                    s = slice(lo, lo + 2000)
                    body = [ids[b - c:b].tobytes() for b, c in zip(ends[s], counts[s])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s], mask=valid[s] == 0), pa.array(first + ends[s] - counts[s]), pa.array(counts[s]),
                                                      pa.array(body, pa.binary())], names=["key", "start", "n_tokens", "ids"])

    return mapped(spread(named), run, "key bigint, start bigint, n_tokens bigint, ids binary")
