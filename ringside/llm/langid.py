"""Language ID by partial matching: one variable-order byte context tree a language, exact code lengths.

A tree holds, for contexts of up to ORDER bytes seen at least MIN_COUNT times, how often each byte
followed. A byte's probability comes from the longest context held; what a context has not seen it
passes on with the escape probability u / (n + u) (n: bytes seen, u: distinct ones), leaving out
what the longer context knows, down to a uniform guess over the bytes never seen. Statistics are
frozen, so each (context, byte) has one code length and one next context: scoring a text is a walk
through two tables. Texts are cut into lanes that walk side by side; ORDER bytes of run-up bring a
lane into the exact context, so cutting changes no code length.

Learning reads a bounded sample of labelled rows: for each language the SAMPLE_DOCS distinct texts
of smallest hash, whole, as many of them in the order of their hashes as fit into SAMPLE_BYTES (the first in
any case). Everything else reads every byte of every text.
"""
from __future__ import annotations

from dataclasses import dataclass
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringside.llm.common import KEPT, blocks, mapped, ship

ORDER, MIN_COUNT = 4, 2
SAMPLE_DOCS, SAMPLE_BYTES = 160, 1 << 20
SALTS = 16
#: Lanes that walk side by side, and the least bytes of one.
LANES, LEAST_LANE = 4096, 256
#: Bytes of text that are walked at once.
BLOCK = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    """Languages in order and, for each, its packed tree counts."""
    languages: list[str]
    trees: list[bytes]


def count_tree(texts: list[bytes]) -> bytes:
    """Counts of (context, next byte) for contexts of 0 to ORDER bytes within a text, rare contexts left out."""
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    since = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, code = {}, symbols.copy()
    for k in range(ORDER + 1):
        if k:
            code[k:] |= symbols[:-k] << np.int64(8 * k)
        codes, counts = np.unique(code[since >= k], return_counts=True)
        context = np.unique(codes >> 8, return_inverse=True)[1]
        held = np.bincount(context, counts)[context] >= (MIN_COUNT if k else 1)
        out[f"codes{k}"], out[f"counts{k}"] = codes[held], counts[held].astype(np.int32)
    packed = io.BytesIO()
    np.savez_compressed(packed, **out)
    return packed.getvalue()


def learn(docs: DataFrame, text: str = "text", label: str = "lang", seen: Column | None = None) -> Model:
    """Trees from the labelled rows that `seen` admits. Null texts, empty texts and null labels teach nothing;
    a table without labelled rows gives a model of no language."""
    rows = docs.where(seen if seen is not None else F.lit(True)).select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).withColumn("h", F.xxhash64("text"))
    # the first of each salt, then the first of those: a language's rows never meet in one task but for the last few
    salt = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(SALTS))
    per_salt = Window.partitionBy("lang", "salt").orderBy("h")
    first = rows.groupBy("lang", "h", salt.alias("salt")).agg(F.min(F.octet_length("text").cast("long")).alias("size"))
    first = first.withColumn("place", F.row_number().over(per_salt)).where(F.col("place") <= SAMPLE_DOCS)
    by_hash = Window.partitionBy("lang").orderBy("h")
    first = first.withColumn("place", F.row_number().over(by_hash)).withColumn("bytes", F.sum("size").over(by_hash))
    last = first.where((F.col("place") == 1) | (F.col("place") <= SAMPLE_DOCS) & (F.col("bytes") <= SAMPLE_BYTES)).groupBy("lang").agg(F.max("h").alias("last")).orderBy("lang").collect()
    if not last:
        return Model([], [])
    admitted = F.lit(False)
    for r in last:
        admitted = admitted | ((F.col("lang") == r.lang) & (F.col("h") <= r["last"]))
    sample = rows.where(admitted).groupBy("lang", "h").agg(F.first(F.encode("text", "utf-8")).alias("text"))

    def tree(group: pa.Table) -> pa.Table:
        texts = [t for _, t in sorted(zip(group.column("h").to_pylist(), group.column("text").to_pylist()))]
        return pa.table({"lang": [group.column("lang")[0].as_py()], "tree": pa.array([count_tree(texts)], pa.binary())})

    ship(docs.sparkSession)
    found = sample.groupBy("lang").applyInArrow(tree, "lang string, tree binary").orderBy("lang").collect()
    return Model([r.lang for r in found], [bytes(r.tree) for r in found])


class Walker:
    """Code-length and next-context tables of all languages of a model, and the walk through them."""

    def __init__(self, model: Model):
        trees = [dict(np.load(io.BytesIO(t))) for t in model.trees]
        used = np.unique(np.concatenate([t["codes0"] & 255 for t in trees]))
        self.novel, self.reset, self.width = len(used), len(used) + 1, len(used) + 2
        self.column = np.full(256, self.novel, np.int16)
        self.column[used] = np.arange(len(used))
        costs, nexts, self.roots, at = [], [], [], 0
        for t in trees:
            cost, following = self._tables(t)
            self.roots.append(at)
            following += at
            following *= self.width
            costs.append(cost.ravel())
            nexts.append(following.ravel())
            at += len(cost)
            t.clear()  # one language's counts at a time
        self.cost = np.concatenate(costs)
        costs.clear()
        self.next = np.concatenate(nexts)
        self.roots = (np.array(self.roots) * self.width).astype(np.int32)

    def _tables(self, tree) -> tuple[np.ndarray, np.ndarray]:
        width, novel, reset = self.width, self.novel, self.reset
        contexts = [np.unique(tree[f"codes{k}"] >> 8) for k in range(ORDER + 1)]
        starts = np.cumsum([0] + [len(c) for c in contexts])
        total = int(starts[-1])
        counts, rest = np.zeros((total, width), np.float32), np.zeros((total, width), np.float32)
        cost, following = np.zeros((total, width), np.float32), np.zeros((total, width), np.int32)
        for k in range(ORDER + 1):
            lo, hi = starts[k], starts[k + 1]
            if lo == hi:
                break
            codes = tree[f"codes{k}"]
            state = lo + np.searchsorted(contexts[k], codes >> 8)
            counts[state, self.column[codes & 255]] = tree[f"counts{k}"]
            own = counts[lo:hi]
            seen = own > 0
            if k:
                shorter = starts[k - 1] + np.searchsorted(contexts[k - 1], contexts[k] & ((1 << 8 * (k - 1)) - 1))
                below = counts[shorter]
                below[seen] = 0
                n, u = below.sum(1, keepdims=True, dtype=np.float64), (below > 0).sum(1, keepdims=True)
                escape = np.where(n > 0, u / np.maximum(n + u, 1), 1.0).astype(np.float32)
                below /= np.maximum(n + u, 1).astype(np.float32)
                rest[lo:hi] = np.where(counts[shorter] > 0, below, escape * rest[shorter])
            else:
                rest[lo:hi] = 1 / max(1, 256 - int(seen.sum()))
            n, u = own.sum(1, keepdims=True, dtype=np.float64), seen.sum(1, keepdims=True)
            p = np.where(seen, own / (n + u).astype(np.float32), (u / (n + u)).astype(np.float32) * rest[lo:hi])
            cost[lo:hi] = -np.log2(np.maximum(p, np.float32(1e-30)))
        # the next context is the longest one held that ends the context and the byte: the shorter context's, unless there is a longer
        for k in range(ORDER + 1):
            lo, hi = starts[k], starts[k + 1]
            if k and lo < hi:
                following[lo:hi] = following[starts[k - 1] + np.searchsorted(contexts[k - 1], contexts[k] & ((1 << 8 * (k - 1)) - 1))]
            if k < ORDER and starts[k + 2] > hi:
                longer = contexts[k + 1]
                following[lo + np.searchsorted(contexts[k], longer >> 8), self.column[longer & 255]] = np.arange(hi, starts[k + 2])
        following[:, novel] = 0
        following[:, reset] = 0
        cost[:, reset] = 0
        return cost, following

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in bits: (texts, languages)."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        symbols = np.empty(int(lengths.sum()), np.int32)
        inside = np.ones(len(symbols), bool)
        inside[starts] = False
        symbols[~inside] = self.reset
        symbols[inside] = self.column[np.frombuffer(b"".join(texts), np.uint8)]
        lanes = int(max(1, min(LANES, len(symbols) // LEAST_LANE)))
        steps = -(-len(symbols) // lanes)
        padded = np.full(ORDER + lanes * steps, self.reset, np.int32)
        padded[ORDER:ORDER + len(symbols)] = symbols
        walk = np.empty((ORDER + steps, lanes), np.int32)
        for i in range(ORDER + steps):  # lane j starts ORDER symbols before its own first
            walk[i] = padded[i: i + lanes * steps: steps][:lanes]
        n = len(self.roots)
        state = np.repeat(self.roots[:, None], lanes, 1)
        cost = np.empty((steps, n, lanes), np.float32)
        for i in range(ORDER + steps):
            at = state + walk[i]
            if i >= ORDER:
                np.take(self.cost, at, out=cost[i - ORDER])
            np.take(self.next, at, out=state)
        out = np.empty((len(texts), n))
        for j in range(n):
            flat = np.ascontiguousarray(cost[:, j, :].T).ravel()[:len(symbols)]
            out[:, j] = np.add.reduceat(flat, starts, dtype=np.float64)
        return out


_WALKERS: dict[int, tuple[Model, Walker]] = {}
KEPT.append(_WALKERS)


def walker(model: Model) -> Walker:
    """The tables of a model, built once in a worker."""
    key = hash(tuple(model.trees))
    if key not in _WALKERS:
        _WALKERS.clear()
        _WALKERS[key] = (model, Walker(model))
    return _WALKERS[key][1]


def judge(model: Model, texts: list[bytes], letters: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior under equal priors, and bits a byte of each text."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
    bits = walker(model).bits(texts)
    best = bits.argmin(1)
    least = bits.min(1)
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    known = np.array(letters, bool)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return names, np.where(known, score, 0.0), least / np.maximum(1, [len(t) for t in texts])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred, score and bits_per_byte of every row.

    A null text, or one without a letter, is UNKNOWN with score 0. Equal texts get equal answers; ties
    go to the language that comes first. Nothing but the text is read for an answer.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # counts of at most SAMPLE_BYTES, or one text, a language
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[text].alias("_text"), F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = rows.drop("_text", "_letters").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def run(batches):
        for block, texts in blocks(batches, "_text", BLOCK):
            names, score, rate = judge(held.value, texts, block.column("_letters").to_pylist())
            yield pa.RecordBatch.from_arrays([*[block.column(i) for i in range(len(keep))], pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                                             names=[*keep, "lang_pred", "score", "bits_per_byte"])

    return mapped(rows, run, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text", most_bits: float = 8.0) -> DataFrame:
    """Whole rows whose text is in some learned language.

    Rejected are null texts, texts without a letter, and texts that no tree codes in fewer than
    `most_bits` bits a byte (prose needs 2 to 4; 8 is what bytes need without any tree). Without any learned language all rows stay.
    """
    if not model.languages:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = rows.withColumn("letters", F.coalesce(rows[f"c{place}"].rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        for block, texts in blocks(batches, f"c{place}", BLOCK):
            names, _, rate = judge(held.value, texts, block.column(block.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(block.columns[:-1], names=block.schema.names[:-1]).filter(
                pa.array([n != UNKNOWN and r < most_bits for n, r in zip(names, rate)], pa.bool_()))

    return mapped(rows, run, rows.drop("letters").schema).toDF(*docs.columns)
