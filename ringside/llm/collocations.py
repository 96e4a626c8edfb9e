"""Phrase collocations by partitioned mining: shards at lowered support, then exact counts of every candidate.

Input splits are dealt to SHARDS shards. A phrase with `support` occurrences in all has at least
ceil(support / SHARDS) in some shard, so the union of what the shards find at that local support misses none.
Shards are mined level by level (words, pairs, triples; a phrase is looked at only where both its shorter
parts were found). A task counts keys of its phrases in numpy and sends each bucket of keys its sorted
share; a bucket's reducer adds a shard's shares up. A phrase that some shard finds but that all shards together
don't bring to the support is no candidate either. What a level finds becomes a bit map (bit: the key's
top bits) of 32 MB at most, however large the corpus is. Keys that share a bit only add candidates.

Then all texts are read again: every phrase on the maps is counted as a string over all shards, exactly, and
those below the support go. Scores, the rule about longer phrases and ranks are DataFrame work on the counts.
"""
from __future__ import annotations

from collections import Counter, defaultdict
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringside.llm.common import blocks, grouped, mapped, mixed, random_words, store

#: Shards, and the longest phrase.
SHARDS, LONGEST = 3, 3
#: A level's bit map has 2^BITS bits at most; fewer where the texts have fewer than eight times as many bytes.
BITS, LEAST_BITS = 28, 20
#: Phrases that a task holds before it sends their counts on, and text bytes meant for one bucket of keys.
HELD, BUCKET_BYTES = 2_500_000, 4 << 20
#: Distinct strings that a task holds in the exact count.
STRINGS = 300_000
#: Text bytes of one block; a block takes some fifty times as many bytes.
BLOCK = 1 << 18

BREAKS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0 inside a word, 1 between words, 2 between pieces.
_KIND = np.array([2 if b in BREAKS else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)
_PLAIN = _LOWER.translate(bytes(32 if k else b for b, k in enumerate(_KIND)))
_BYTE = random_words(256, 11)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_MIX = random_words(LONGEST + 1, 12) | np.uint64(1)


def _powers(n: int, radix: np.uint64) -> np.ndarray:
    out = np.full(n, radix, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = np.uint64(pow(int(_RADIX), -1, 2**64))


class Words:
    """Words of a block of texts: a 64-bit key each, salted by the text's language, and which follow one another in a piece."""

    def __init__(self, texts: list[bytes], salts: np.ndarray):
        whole = b"\n".join(texts).translate(_LOWER)
        data = np.frombuffer(whole, np.uint8)
        kind = _KIND[data]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends, self.whole = edges[0::2], edges[1::2], whole
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text = np.searchsorted(np.cumsum(lengths), self.starts, side="right")
        # a word's key: its bytes as a polynomial, brought to the same power wherever it lies
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(len(data), _RADIX), dtype=np.uint64)])
        flat = (sums[self.ends] - sums[self.starts]) * _powers(len(data) + 1, _INVERSE)[self.starts]
        self.keys = mixed(flat + salts[self.text])
        pieces = np.concatenate([[0], np.cumsum(kind == 2)])[self.starts]
        self.joined = np.concatenate([pieces[1:] == pieces[:-1], [False]]) if len(pieces) else np.zeros(0, bool)

    def phrases(self, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the phrases of len(maps) + 1 words whose shorter parts are all on their maps, and their first words."""
        keys, first = self.keys, np.arange(len(self.keys))
        for size, found in enumerate(maps, 1):
            on = listed(found, keys)
            whole = np.zeros(len(self.keys) + 1, bool)
            whole[first[on]] = True
            at = np.zeros(len(self.keys) + 1, np.uint64)
            at[first] = keys
            first = first[on]
            first = first[whole[first + 1] & self.joined[first]]  # both parts overlap in all but one word
            keys = mixed(at[first] * _MIX[size] + self.keys[np.minimum(first + size, len(self.keys) - 1)])
        return keys, first


def listed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit set."""
    at = keys >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def salt_of(lang: str | None) -> int:
    name = (UNKNOWN if lang is None else lang).encode("utf-8")
    return zlib.crc32(name) << 32 | zlib.crc32(name[::-1])


def _columns(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit(UNKNOWN)).alias("_lang"), docs[f"`{text}`"].alias("_text"))


def _blocks(batches):
    """(languages, Words) of blocks of texts."""
    for block, texts in blocks(batches, "_text", BLOCK):
        langs = block.column(0).to_pylist()
        salts = {name: salt_of(name) for name in set(langs)}
        yield langs, Words(texts, np.array([salts[name] for name in langs], np.uint64))


_MAPS: dict[str, np.ndarray] = {}


def _map(held) -> np.ndarray:
    name, broadcast = held
    if name not in _MAPS:
        if len(_MAPS) >= LONGEST:
            _MAPS.clear()
        _MAPS[name] = np.frombuffer(broadcast.value, np.uint8)
    return _MAPS[name]


def mine(rows: DataFrame, maps: list, support: int, bits: int, bucket_bits: int, width: int):
    """The bit map of phrases one word longer than `maps` cover that are frequent in some shard.

    Keys are sent by their first `width` bytes, byte plane by byte plane: sorted, the first planes of a bucket
    are runs, which the shuffle's compression folds.
    """
    least = -(-support // SHARDS)
    kind = np.dtype(np.uint8 if support < 256 else "<u8")

    def count(batches):
        from pyspark import TaskContext
        shard, kept, n = TaskContext.get().partitionId() % SHARDS, [], 0
        found = [_map(m) for m in maps]

        def flush():
            every = np.concatenate(kept)
            kept.clear()
            every >>= np.uint64(64 - 8 * width)
            every.sort()
            # buckets in turn, so that one sorted array is all that is held whole
            ends = [*np.searchsorted(every, np.arange(0, 1 << bucket_bits, 1 << max(0, bucket_bits - 5), dtype=np.uint64) << np.uint64(8 * width - bucket_bits)).tolist(), len(every)]
            for lo, hi in zip(ends, ends[1:]):
                if lo == hi:
                    continue
                keys = every[lo:hi]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                counts = np.minimum(np.diff(np.append(first, len(keys))), support).astype(kind)
                keys = keys[first]
                bucket = (keys >> np.uint64(8 * width - bucket_bits)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]).tolist()
                planes, spans = keys.astype("<u8").view(np.uint8).reshape(-1, 8), list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([shard] * len(spans), pa.int32()),
                    pa.array([planes[a:b, :width].T.tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], names=["bucket", "shard", "keys", "n"])

        for _, words in _blocks(batches):
            keys, _ = words.phrases(found)
            kept.append(keys)
            n += len(keys)
            if n >= HELD:
                yield from flush()
                kept, n = [], 0
        if n:
            yield from flush()

    def parts(group, column, kind, at):
        return [np.frombuffer(group.column(column)[int(i)].as_py(), kind) for i in at]

    def reduce(group: pa.Table) -> pa.Table:
        inside = bits - bucket_bits
        shard_of, keys, frequent = group.column("shard").to_numpy(), [], []
        totals = []
        for shard in np.unique(shard_of):
            at = np.flatnonzero(shard_of == shard)
            sent = []
            for p in parts(group, "keys", np.uint8, at):
                whole = np.zeros((len(p) // width, 8), np.uint8)
                whole[:, :width] = p.reshape(width, -1).T
                sent.append(whole.view("<u8").ravel())
            total, key = _summed(np.concatenate(sent), np.concatenate(parts(group, "n", kind, at)).astype(np.int64))
            keys.append(key)
            totals.append(total)
            frequent.append(key[total >= least])
        total, key = _summed(np.concatenate(keys), np.concatenate(totals))
        enough = np.intersect1d(key[total >= support], np.concatenate(frequent))
        out = np.zeros(1 << inside, bool)
        out[((enough >> np.uint64(8 * width - bits)) & np.uint64((1 << inside) - 1)).astype(np.int64)] = True
        return pa.table({"bucket": [group.column("bucket")[0].as_py()], "bits": pa.array([zlib.compress(np.packbits(out, bitorder="little").tobytes(), 1)], pa.binary())})

    shares = mapped(rows, count, "bucket bigint, shard int, keys binary, n binary")
    found = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << bits - bucket_bits) // 8
    for r in grouped(shares, "bucket", reduce, "bucket bigint, bits binary").collect():  # 2^bits bits in all
        found[r.bucket * size:(r.bucket + 1) * size] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(found.tobytes())


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total and key of each distinct key, in order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.add.reduceat(n[order], first), keys[first]


def counts(rows: DataFrame, maps: list, support: int, buckets: int) -> DataFrame:
    """lang, size, phrase and n of every phrase of 1 to len(maps) words on the maps that occurs `support` times, and of
    all words together (size 0), counted over all rows.

    Tasks send each bucket its phrases as sorted, compressed lists; phrases that begin alike lie in one bucket.
    """
    def run(batches):
        found = [_map(m) for m in maps]
        met = defaultdict(Counter)

        def flush():
            for lang, size in list(met):
                lists, counter = defaultdict(list), met.pop((lang, size))
                for phrase in sorted(counter):
                    lists[zlib.crc32(phrase[:phrase.find(b" ") + 3] if size > 1 else phrase[:4]) % buckets].append(phrase)
                where = list(lists)
                yield pa.RecordBatch.from_arrays([
                    pa.array(where, pa.int32()), pa.array([lang] * len(where), pa.string()), pa.array([size] * len(where), pa.int32()),
                    pa.array([zlib.compress(b"\n".join(lists[k]), 1) for k in where], pa.binary()),
                    pa.array([zlib.compress(np.fromiter(map(counter.__getitem__, lists[k]), "<u8", len(lists[k])).view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for k in where], pa.binary())],
                    names=["bucket", "lang", "size", "phrases", "n"])

        for langs, words in _blocks(batches):
            strings = words.whole.translate(_PLAIN).split()
            ends = np.searchsorted(words.text, np.arange(len(langs)), side="right").tolist()
            for size in range(1, len(maps) + 1):
                keys, first = words.phrases(found[:size - 1])
                first = first[listed(found[size - 1], keys)]
                cuts = np.searchsorted(first, [0, *ends]).tolist()
                first = first.tolist()
                for lang, a, b, before, after in zip(langs, cuts, cuts[1:], [0, *ends], ends):
                    counter = met[lang, size]
                    if size == 1:
                        met[lang, 0][b""] += after - before
                        counter.update([strings[i] for i in first[a:b]])
                    else:
                        counter.update([b" ".join(strings[i:i + size]) for i in first[a:b]])
            if sum(map(len, met.values())) > STRINGS:
                yield from flush()
        yield from flush()

    def reduce(group: pa.Table) -> pa.Table:
        met = defaultdict(Counter)
        for batch in group.to_batches(max_chunksize=64):
            for r in batch.to_pylist():
                counter, phrases = met[r["lang"], r["size"]], zlib.decompress(r["phrases"]).split(b"\n")
                sent = np.frombuffer(zlib.decompress(r["n"]), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().tolist()
                for phrase, n in zip(phrases, sent):
                    counter[phrase] += n
        kept = [(lang, size, phrase, n) for (lang, size), counter in met.items() for phrase, n in counter.items() if n >= support or not size]
        columns = list(zip(*kept)) or [[]] * 4
        return pa.table({"lang": pa.array(columns[0], pa.string()), "size": pa.array(columns[1], pa.int32()),
                         "phrase": pa.array(columns[2], pa.binary()).cast(pa.string()), "n": pa.array(columns[3], pa.int64())})

    sent = mapped(rows, run, "bucket int, lang string, size int, phrases binary, n binary")
    return grouped(sent, "bucket", reduce, "lang string, size int, phrase string, n bigint")


def mined(docs: DataFrame, support: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, size, phrase and n of all phrases of 1 to LONGEST words with at least `support` occurrences, and of
    all words of a language (size 0, empty phrase)."""
    rows = _columns(docs, text, lang)
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(BITS, max(LEAST_BITS, int(total).bit_length() - 3))
    bucket_bits = min(bits - 3, max(6, (int(total) // BUCKET_BYTES).bit_length()))
    width = min(8, max(4, 1 + -(-(int(total).bit_length() + 2) // 8)))  # keys with some 2^8 to 2^16 times as many values as there are phrases
    maps = []
    for _ in range(LONGEST):
        maps.append(mine(rows, maps, support, bits, bucket_bits, width))
    return store(counts(rows, maps, support, 1 << bucket_bits), "phrases")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r and score of every phrase of two words and more, by its lowest-scoring cut.

    Scores are exact: products are decimals of up to 38 digits, enough for counts up to 10^16.
    """
    long = found.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("words"))
    cut = long.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words")
    cut = cut.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
                     F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("rest"))
    part = found.where("size >= 1").select("lang", "phrase", "n")
    cut = cut.join(part.withColumnsRenamed({"phrase": "head", "n": "l"}), ["lang", "head"]).join(part.withColumnsRenamed({"phrase": "rest", "n": "r"}), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    return cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least")).select(
        "lang", "phrase", "size", "a", "least.l", "least.r", "least.score")


def collocations(docs: DataFrame, support: int = 10, top: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first `top` phrases (None: all).

    A phrase goes if a longer one that holds it occurs at least half as often. Null texts are empty, a null
    language is UNKNOWN; ties in score and count are broken by the phrase's bytes, so ranks never depend on
    the order of rows. Repeated rows count again. Other columns aren't read; an empty table gives no rows.
    """
    found = mined(docs, support, text, lang)
    longer = found.where("size >= 3").select("lang", F.split("phrase", " ", -1).alias("w"), F.col("n").alias("of_longer"))
    inside = longer.select("lang", F.explode(F.array(*[F.array_join(F.slice("w", i, 2), " ") for i in range(1, LONGEST)])).alias("phrase"), "of_longer")
    inside = inside.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    kept = scored(found).join(inside, ["lang", "phrase"], "left").where(F.col("of_longer").isNull() | (F.col("of_longer") * 100 < F.col("a") * 50))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    if top is not None:
        # scores in a thousand steps: of each language only the steps that hold its first ones are ranked
        kept = store(kept, "kept")
        steps = kept.groupBy("lang", F.expr("score div 1000").alias("step")).agg(F.count(F.lit(1)).alias("rows"))
        above = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
        last = steps.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top).groupBy("lang").agg(F.min("step").alias("last"))
        kept = kept.join(last, "lang").where(F.expr("score div 1000") >= F.col("last")).drop("last")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = found.where("size = 0").select("lang", F.col("n").alias("words"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
