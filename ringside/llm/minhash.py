"""Near-duplicate documents: ProbMinHash signatures of shingle sets, bands, verification, classes.

Each shingle sends the arrivals of a Poisson process to random components of the signature, which keep
their earliest arrival; a shingle stops as soon as its next arrival is later than all of them. Two
components agree with the probability Jaccard similarity of the weighted sets. Every shingle has weight 1
however often a text repeats it, so that this is the plain Jaccard similarity that makes a link.

BANDS bands of ROWS components give the buckets; texts that share a bucket are candidates, and a pair
is a link if the plain Jaccard similarity of the whole shingle sets reaches the threshold. Classes
are what links connect. A bucket is worked off by leaders: a leader is compared with every member
that isn't in its class yet and that sizes and parity sketches don't rule out, and then retires; those nearest to earlier
leaders lead next. Pairs within
a class aren't compared, so a large family costs about one comparison a member, and no candidate pair
of different classes is left out. Equal shingle sets are folded before all this.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringside.llm.common import blocks, keyed, mapped, mixed, store
from ringside.llm.components import components
from ringside.llm.shingles import jaccard, shingle_sets

WORDS, THRESHOLD = 5, 0.8
COMPONENTS, BANDS, ROWS = 128, 25, 5
#: Bytes of texts that a worker takes at once; their words' and shingles' hashes take some twenty times as much.
BLOCK = 1 << 20
#: Members that meet one copy of their leader's text.
MEMBERS = 400
#: Leaders of a bucket in the first rounds; in each later one there are MORE times as many.
LEADERS, MORE = (1, 1), 64
#: Bits of a set's parity sketch.
PARITIES = 2048
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signature(elements: np.ndarray, weights: np.ndarray, size: int = COMPONENTS) -> np.ndarray:
    """The element with the earliest arrival at each of `size` (a power of two) components."""
    earliest, kept = np.full(size, np.inf), np.zeros(size, np.uint64)
    time, drawn = np.zeros(len(elements)), 0
    draws = 8 * size  # fills all components nearly always; few shingles go on then
    while len(elements):
        each = max(1, -(-draws // len(elements)))
        draws = size
        turn = np.arange(drawn + 1, drawn + each + 1, dtype=np.uint64)
        random = mixed(elements[:, None] ^ mixed(turn * _GOLDEN))
        gaps = -np.log(((random >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weights[:, None]
        arrival = time[:, None] + np.cumsum(gaps, 1)
        place = (random & np.uint64(size - 1)).astype(np.int64)
        soon = arrival < earliest[place]
        when, where, what = arrival[soon], place[soon], np.broadcast_to(elements[:, None], arrival.shape)[soon]
        np.minimum.at(earliest, where, when)
        won = when == earliest[where]
        kept[where[won]] = what[won]
        on = arrival[:, -1] < earliest.max()
        elements, weights, time, drawn = elements[on], weights[on], arrival[on, -1], drawn + each
    return kept


def band_keys(kept: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = kept[:BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = mixed(keys * _GOLDEN + rows[:, j])
    return keys.view(np.int64)


def parities(elements: np.ndarray) -> np.ndarray:
    """For each of PARITIES cells whether an odd number of elements falls into it, as 64-bit numbers.

    Two sets' sketches differ in at most as many bits as their sets differ in elements.
    """
    odd = np.bincount((elements & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def signed(rows: DataFrame) -> DataFrame:
    """rid, digest of the shingle set, number of shingles, band keys and parities for `rows` (rid, text)."""
    def run(batches):
        known: dict[bytes, np.ndarray] = {}
        for block, texts in blocks(batches, most=BLOCK):
            digests, sizes, keys, odd = [], [], [], []
            for elements, _ in shingle_sets(texts, WORDS):
                digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
                if digest not in known:
                    if len(known) >= 5000:
                        known.clear()
                    known[digest] = band_keys(signature(elements, np.ones(len(elements)))) if len(elements) else np.zeros(0, np.int64)
                digests.append(digest)
                sizes.append(len(elements))
                keys.append(known[digest])
                odd.append(parities(elements))
            ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                                              pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * (PARITIES // 64)), pa.array(np.concatenate(odd)))],
                                             names=["rid", "digest", "n_shingles", "bands", "odd"])

    return mapped(rows.select("rid", "text"), run, "rid bigint, digest binary, n_shingles int, bands array<bigint>, odd array<bigint>")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, member, similarity) of `pairs` (leader, member), from the whole texts of `texts` (rid, text).

    A leader with many members is copied once for every MEMBERS of them, so no task gets a whole family.
    """
    pairs = store(pairs, "pairs")
    copies = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("copies"))
    roles = (pairs.join(copies, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("follows"), F.col("member").alias("rid"))
             .union(copies.select("leader", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)), F.lit(0), F.col("leader"))))
    rows = texts.join(store(roles, "roles"), "rid").repartition("leader", "copy").sortWithinPartitions("leader", "copy", "follows")

    def run(batches):
        lead, own = None, None
        for block, bodies in blocks(batches, most=BLOCK):
            leaders, follows, members = (block.column(i).to_pylist() for i in range(3))
            rows = []
            for (elements, _), leader, follower, member in zip(shingle_sets(bodies, WORDS), leaders, follows, members):
                if not follower:
                    lead, own = leader, elements
                else:
                    assert lead == leader, "a leader's text comes before those of its members"
                    rows.append((leader, member, jaccard(own, elements)))
            if rows:
                a, b, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["leader", "member", "similarity"])

    return store(mapped(rows.select("leader", "follows", "rid", "text"), run, "leader bigint, member bigint, similarity double"), "compared")


def possible(a: str, b: str, threshold: float):
    """False only for pairs that can't reach the threshold: a set that is too small for the other, or sketches that
    differ in more bits than linked sets differ in elements. Exact: it loses no link."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differing = sum((F.bit_count(F.element_at(f"{a}.odd", i).bitwiseXOR(F.element_at(f"{b}.odd", i))) for i in range(2, PARITIES // 64 + 1)),
                    F.bit_count(F.element_at(f"{a}.odd", 1).bitwiseXOR(F.element_at(f"{b}.odd", 1))))
    most = (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-6) & (differing <= most)


def linked(members: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """(node, component) of the nodes that links join, from buckets `members` (key, rid); None without any.

    `sketches` has n_shingles and odd of each rid. Rounds end by themselves: every round retires a leader
    of each bucket that still holds two classes and a member that hasn't led.
    """
    known, classes, led, turn = None, None, None, 0
    while True:
        leaders = LEADERS[turn] if turn < len(LEADERS) else MORE ** (turn - len(LEADERS) + 1)
        turn += 1
        state = members.withColumn("class", F.col("rid"))
        near = None
        if known is not None:
            links = known.where(F.col("similarity") >= threshold).select(F.col("leader").alias("a"), F.col("member").alias("b"))
            classes = components(links)
            state = members.join(classes.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("class"))
            near = known.groupBy(F.col("member").alias("rid")).agg(F.max("similarity").alias("near"))
        several = state.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("key")
        sketch = sketches.select("rid", F.struct("n_shingles", "odd").alias("sketch"))
        state = store(state.join(several, "key", "left_semi").join(sketch, "rid").select("key", "rid", "class", "sketch"), "open")
        fresh = state if led is None else state.join(led, ["key", "rid"], "left_anti")
        fresh = fresh.withColumn("near", F.lit(0.0)) if near is None else fresh.join(near, "rid", "left").select("key", "rid", "class", "sketch", F.coalesce("near", F.lit(0.0)).alias("near"))
        order = Window.partitionBy("key").orderBy(F.desc("near"), "rid")
        chosen = store(fresh.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders).select("key", F.col("rid").alias("leader"), F.col("class").alias("own"), "place", F.col("sketch").alias("own_sketch")), "leaders")
        if chosen.isEmpty():
            return classes
        others = state.join(chosen.select("key", F.col("leader").alias("rid"), F.col("place").alias("turn")), ["key", "rid"], "left") if leaders > 1 else state.withColumn("turn", F.lit(None).cast("int"))
        pairs = others.alias("o").join(chosen.alias("c"), (F.col("o.key") == F.col("c.key")) & (F.col("rid") != F.col("leader")) & (F.col("class") != F.col("own"))
                                       & (F.col("turn").isNull() | (F.col("turn") > F.col("place"))) & possible("sketch", "own_sketch", threshold))
        pairs = pairs.select("leader", F.col("rid").alias("member")).distinct()
        if known is not None:  # in either direction
            for a, b in (("leader", "member"), ("member", "leader")):
                pairs = pairs.join(known.select(F.col(a).alias("leader"), F.col(b).alias("member")), ["leader", "member"], "left_anti")
        found = compared(pairs, texts)
        known = found if known is None else store(known.union(found), "known")
        retired = chosen.select("key", F.col("leader").alias("rid"))
        led = retired if led is None else store(led.union(retired), "led")


def classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rid, class_id, class_size, n_shingles and kept of every row of `rows` (rid, id, text).

    class_id is the least id of the class; the row that has it is kept (rows without an id come last,
    of rows with one id the first read stays). Null texts are empty; texts without words form one class.
    """
    signatures = store(signed(rows), "signatures")
    marked = signatures.select("rid", "digest", "n_shingles").join(rows.select("rid", "id"), "rid")
    order = F.struct(F.col("id").isNull().alias("unkeyed"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    sets = store(marked.groupBy("digest").agg(F.min("rid").alias("rid"), F.min(order).alias("winner"), F.count(F.lit(1)).alias("n")).select("digest", "rid", "winner", "n"), "sets")
    # one row stands for all of its shingle set
    keys = signatures.select("rid", "bands").join(sets.select("rid"), "rid", "left_semi").select("rid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = store(keys.join(shared, "key", "left_semi").select("key", "rid"), "buckets")
    texts = store(rows.select("rid", "text").join(members.select("rid").distinct(), "rid", "left_semi"), "candidates")
    joined = linked(members, signatures.select("rid", "n_shingles", "odd"), texts, threshold)
    whole = sets.select("digest", "rid", "winner", "n")
    if joined is None:
        whole = whole.withColumn("class", F.col("rid"))
    else:
        whole = whole.join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("class", F.coalesce("component", "rid"))
    whole = store(whole.select("digest", "class", "winner", "n"), "classes")
    totals = whole.groupBy("class").agg(F.min("winner").alias("best"), F.sum("n").alias("class_size"))
    answers = whole.join(totals, "class").select("digest", F.col("best.id").alias("class_id"), F.col("best.rid").alias("keep_rid"), "class_size")
    return marked.join(answers, "digest").select("rid", "id", "class_id", "class_size", "n_shingles", (F.col("rid") == F.col("keep_rid")).alias("kept"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, class_id, class_size, n_shingles, kept of every row of docs."""
    rows = store(docs.select(F.monotonically_increasing_id().alias("rid"), docs[f"`{key}`"].alias("id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text")), "near")
    return classes(rows).select(F.col("id").alias(key), "class_id", "class_size", "n_shingles", "kept")


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows, one of each class of near-duplicates: that of smallest key."""
    rows = keyed(docs, "near")
    found = classes(rows.select("rid", F.col(f"row.`{key}`").alias("id"), F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("text")))
    gone = store(found.where(~F.col("kept")).select("rid"), "gone")  # written first, so that the join knows its size
    return rows.join(gone, "rid", "left_anti").select("row.*")
