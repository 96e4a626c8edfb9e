"""Token counts by pre-token: a broadcast table of frequent lengths, then a worker's cache, no shuffle of pre-tokens.

A byte-level vocabulary first parts a text into pre-tokens; merges never cross them, so a text has as many
tokens as its pre-tokens have together. The lengths of the TABLE most frequent pre-tokens of a bounded sample
are worked out once and broadcast. What the table lacks is merged by the library in the worker that meets
it and remembered there, up to MISSES bytes. The sample decides only what is looked up where, never a count.
"""
from __future__ import annotations

from collections import Counter
import os
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import regex

from ringside.llm.common import blocks, mapped
from ringside.llm.subwords import byte_characters

#: Rows of the sample, pre-tokens of the table, and the longest one (in characters) that is held anywhere.
SAMPLE_DOCS, TABLE, LONGEST = 2000, 50_000, 64
#: Bytes of misses that a worker remembers, about; beyond them it starts anew.
MISSES = 64 << 20
#: What parts a text into pre-tokens, as the byte-level scheme of these vocabularies fixes it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Lengths(dict):
    """Token counts of pre-tokens; a miss is merged by the library and, if short, remembered.

    `table` holds the frequent ones and stays; the misses after it are given up once they take MISSES bytes.
    """

    def __init__(self, path: str, table: dict[str, int] | None = None, odd: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.merges, self.letters = self.model.model, byte_characters()
        self.table, self.held = table or {}, 0
        self.update(self.table)
        pattern = PIECES.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pieces = regex.compile(pattern).findall
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.odd = frozenset(odd)
        self.high = regex.compile(f"[{min(odd)}-\U0010ffff]") if odd else None

    def __missing__(self, piece: str) -> int:
        n = len(self.merges.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters)))
        if len(piece) <= LONGEST:
            size = sys.getsizeof(piece) + 100
            if self.held + size > MISSES:
                self.clear()
                self.update(self.table)
                self.held = 0
            self[piece], self.held = n, self.held + size
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings in it count one each."""
        if self.high is not None and self.high.search(text) and not self.odd.isdisjoint(text):
            return len(self.model.encode(text, add_special_tokens=False).ids)
        if self.special is None or "<" not in text:
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


def odd_characters(path: str) -> str:
    """Characters that the library's tables class otherwise than ours; texts with one of them go through the library whole."""
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd = []
    for lead, ours in (("x", r"\p{L}"), ("1", r"\p{N}"), ("!", f"[^{WHITE}\\p{{L}}\\p{{N}}]"), ("\n", f"[{WHITE}]")):
        of_class = regex.findall(ours, every)
        if len(split("".join(of_class))) > 1:  # characters of one class in a row are one piece
            odd += [c for c in of_class if len(split(lead + c)) > 1]
    return "".join(odd)


def frequent(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> dict[str, int]:
    """Lengths of the TABLE most frequent pre-tokens of the SAMPLE_DOCS rows whose keys have the smallest
    hashes (and further rows of the last key)."""
    rows = docs.select(F.xxhash64(docs[f"`{key}`"]).alias("h"))
    last = rows.orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return {}
    sample = docs.where(F.xxhash64(docs[f"`{key}`"]) <= last).select(F.col(f"`{text}`").alias("text"))

    def run(batches):
        lengths, met = Lengths(path), Counter()
        for _, texts in blocks(batches):
            for t in texts:
                met.update(p for p in lengths.pieces(t.decode("utf-8", "replace")) if len(p) <= LONGEST)
            if len(met) > 4 * TABLE:  # only the leaders of a task can be among the leaders of all
                met = Counter(dict(met.most_common(2 * TABLE)))
        yield pa.RecordBatch.from_arrays([pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())], names=["piece", "n"])

    counted = mapped(sample, run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    lengths = Lengths(path)
    return {r.piece: lengths[r.piece] for r in counted.orderBy(F.desc("n"), "piece").limit(TABLE).collect()}


def counted(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null texts are empty: no bytes, no tokens. Keys are carried, never read, whether null or repeated; only the
    key and the text are returned or read, so other columns may have any name. An empty table gives no rows.
    Very long texts and pre-tokens are counted whole; a pre-token over LONGEST characters is merged each time.
    """
    held = docs.sparkSession.sparkContext.broadcast((frequent(docs, path, text, key), odd_characters(path)))  # TABLE entries of at most LONGEST characters
    name = uuid.uuid4().hex
    rows = docs.select(docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].alias("_text"))
    schema = docs.select(docs[f"`{key}`"].alias(key)).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        lengths = _lengths(name, path, held)
        for block, texts in blocks(batches, "_text", 1 << 20):
            n = np.array([lengths.count(t.decode("utf-8", "replace")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=schema.names)

    return mapped(rows, run, schema)


_HELD: dict[str, Lengths] = {}


def _lengths(name: str, path: str, held) -> Lengths:
    """The worker's own lengths, kept from task to task of one run."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Lengths(path, *held.value)
    return _HELD[name]
