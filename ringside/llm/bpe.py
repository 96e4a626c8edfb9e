"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a heap holds the merges that neighbours allow, by rank and
place. The least is taken, skipped if its symbols have changed since, or carried out, after
which the merged symbol's two new neighbours enter the heap. Decoding joins vocabulary strings.
"""
from __future__ import annotations

from heapq import heapify, heappop, heappush
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
import regex

from ringside.llm.common import blocks, mapped
from ringside.llm.subwords import WordIds, byte_characters, width_of

#: What the vocabulary file's pattern calls white space.
_WHITE = r"\t-\r \x85\xa0  -     　"


class Bpe:
    """A vocabulary with word ends, lower case and byte-level symbols, as its JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"{path} describes another kind of tokenizer")
        vocabulary, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max(*vocabulary.values(), *added.values()) + 1)
        for token, i in (vocabulary | added).items():
            self.strings[i] = token
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        letters = byte_characters()
        self.inner = [vocabulary[letters[b]] for b in range(256)]
        self.final = [vocabulary[letters[b] + self.suffix] for b in range(256)]
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}")).findall
        self.met: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-split piece."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.final[piece[-1]]]
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:  # stale: a neighbour has been merged since
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # case is mapped character by character
        out, met = [], self.met
        for piece in self.pieces(text):
            ids = met.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(met) < 20_000 and len(piece) < 32:  # whole words are remembered by WordIds
                    met[piece] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of any text; added tokens are found before anything else."""
        if self.special is None or "<" not in text:
            return self.plain(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if i % 2 else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return joined(self.strings, ids)


def joined(strings: list[str], ids: list[int]) -> str:
    """Vocabulary strings in a row, parted by a space as the library does where a file names no decoder."""
    return " ".join(map(strings.__getitem__, ids))


_HELD: dict[str, tuple[Bpe, WordIds]] = {}
_STRINGS: dict[str, list[str]] = {}


def strings(path: str) -> list[str]:
    """The strings of all ids alone, for workers that only decode."""
    if path not in _STRINGS:
        _STRINGS[path] = Bpe(path).strings
    return _STRINGS[path]


def codec(path: str) -> tuple[Bpe, WordIds]:
    """The vocabulary and a word-wise encoder of whole texts, one instance a worker."""
    if path not in _HELD:
        bpe = Bpe(path)
        _HELD[path] = bpe, WordIds(lambda words: [bpe.encode(w) for w in words], width_of(len(bpe.strings)), list(bpe.added))
    return _HELD[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and ids (array) of every row; null texts are empty and have no ids."""
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text"))

    def run(batches):
        _, words = codec(path)
        for block, texts in blocks(batches, "_text"):
            ids = [np.frombuffer(row, words.kind) for row in words(texts)]
            ends = np.cumsum([0] + [len(row) for row in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*block.columns[:len(keep)], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))],
                                             names=[*keep, "ids"])

    return mapped(rows, run, rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, ids (array) and decoded of every row: encoding and decoding by one worker, block by block, so
    that the vocabulary is held once. Null texts are empty: no ids, an empty decoded text."""
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text"))
    schema = rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        bpe, words = codec(path)
        for block, texts in blocks(batches, "_text", 1 << 20):
            ids = [np.frombuffer(row, words.kind) for row in words(texts)]
            ends = np.cumsum([0] + [len(row) for row in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*block.columns[:len(keep)], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))),
                                              pa.array([bpe.decode(row.tolist()) for row in ids], pa.string())], names=schema.names)

    return mapped(rows, run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and text of every row of ids; null is no ids."""
    rows = rows.select(*[rows[f"`{c}`"] for c in keep], F.coalesce(rows[f"`{ids}`"], F.array().cast("array<int>")).alias("_ids"))

    def run(batches):
        held = strings(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                block = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*block.columns[:len(keep)], pa.array([joined(held, x) for x in block.column(len(keep)).to_pylist()], pa.string())], names=[*keep, "text"])

    return mapped(rows, run, rows.drop("_ids").schema.add("text", "string"))
