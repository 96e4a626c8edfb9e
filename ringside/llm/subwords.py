"""Subword ids of whole texts through the tokenizers library, looked up by word.

White space parts words in these vocabularies and belongs to none of their tokens, so the ids of a
text are the ids of its words in a row. A worker keeps the ids of words it has met lately, up to a bound.
"""
from __future__ import annotations

from collections.abc import Callable
import os
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ringside.llm.common import KEPT, blocks, mapped

#: Words of a generation that a worker remembers (it holds two), and the longest one that is remembered.
REMEMBERED, LONGEST = 500_000, 64
#: Marks that mostly follow a word's letters.
MARKS = ",.!?:;"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts as little-endian bytes, from a function that encodes words.

    `whole`: tokens that are found before case is folded; None if the vocabulary tells A from a.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]], width: int, whole: list[str] | None):
        self.encode_words, self.kind, self.known, self.older = encode_words, np.dtype(f"<u{width}"), {}, {}
        self.remembered: int | None = None  # words of a generation; None for REMEMBERED
        # a mark after letters that adds the same ids to any word needs no look of its own
        the, zq, *ended = encode_words(["the", "zq", *(w + m for m in MARKS for w in ("the", "zq"))])
        self.tails = {m.encode(): np.array(a[len(the):], self.kind).tobytes() for m, a, b in zip(MARKS, ended[0::2], ended[1::2])
                      if a[:len(the)] == the and b == zq + a[len(the):]}
        self.whole = None if whole is None else [w.lower().encode("utf-8") for w in whole]

    def _cased(self, text: bytes) -> bytes:
        low = text.lower()  # A-Z alone
        return text if self.whole is None or any(w in low for w in self.whole) else low

    def _marked(self, word: bytes) -> bool:
        """Whether a word is letters up to U+024F with a mark after them."""
        if word[-1:] not in self.tails:
            return False
        stem = word[:-1].decode("utf-8", "replace")
        return stem.isalpha() and (stem.isascii() or max(stem) < "\u0250")

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, remembered or encoded now."""
        out = list(map(self.known.get, words))
        open_ = [i for i, ids in enumerate(out) if ids is None]
        fresh = [words[i] for i in open_]
        if not fresh:
            return out
        if len(self.known) + len(fresh) > (self.remembered or REMEMBERED):
            self.older, self.known, fresh, open_ = self.known, {}, words, range(len(words))
        again = [w for w in fresh if w in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        fresh = set(fresh).difference(again)
        parted = [w for w in fresh if self._marked(w)]
        fresh.difference_update(parted)
        fresh = list(fresh | ({w[:-1] for w in parted} - self.known.keys()))
        for at in range(0, len(fresh), 20_000):
            part = fresh[at:at + 20_000]
            ids = self.encode_words([w.decode("utf-8", "replace") for w in part])
            flat = np.fromiter((i for row in ids for i in row), self.kind).tobytes()
            end = 0
            for word, row in zip(part, ids):
                start, end = end, end + len(row) * self.kind.itemsize
                self.known[word] = flat[start:end]
        for word in parted:
            self.known[word] = self.known[word[:-1]] + self.tails[word[-1:]]
        for i in open_:
            out[i] = self.known[words[i]]
        for word in fresh:
            if len(word) > LONGEST:
                self.known.pop(word)
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Words are cut out and numbered in Arrow, looked up once a block, and their ids put in a row there."""
        parts = [self._cased(t) for t in texts]
        data = np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)
        inside = ~_WHITE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            return [b""] * len(texts)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        known = self._ids_of(cut.dictionary.to_pylist())
        row = pa.array(known, pa.large_binary()).take(cut.indices)  # the words' ids, one after the other
        _, ends_at, out = row.buffers()
        bounds = np.frombuffer(ends_at, np.int64)[row.offset:row.offset + len(row) + 1]
        words = np.searchsorted(starts, 1 + np.cumsum([len(p) + 1 for p in parts]))  # words up to the end of each text
        stops, out = bounds[words].tolist(), memoryview(out) if out is not None else b""
        return [bytes(out[a:b]) for a, b in zip([int(bounds[0]), *stops], stops)]


#: White space of the ASCII range, which parts words.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


_HELD: dict[tuple[str, str], WordIds] = {}
KEPT.append(_HELD)


def width_of(size: int) -> int:
    """Bytes of an id in a vocabulary of `size` ids."""
    return 2 if size <= 65536 else 4


def library(path: str, lead: str = "") -> WordIds:
    """Ids as the library gives them without special tokens, truncation and padding; one instance a worker.

    With `lead` a space stands before every word, for vocabularies that keep white space; strings of
    special tokens are ordinary text then.
    """
    if (path, lead) not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        pieces = model.model
        model.encode_special_tokens = bool(lead)
        letters = byte_characters()
        mark = "\u0120" if lead else ""  # a space as byte-level vocabularies write it

        def whole(words):
            return [e.ids for e in model.encode_batch([lead + w for w in words], add_special_tokens=False)]

        def direct(word):
            if not word.isascii():
                word = word.encode("utf-8").decode("latin-1").translate(letters)
            return [t.id for t in pieces.tokenize(mark + word)]

        def lettered(word):
            """Whether a word is lower-case letters up to U+024F alone, composed."""
            return word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0250" and is_normalized("NFC", word))

        plain = ["a", "the", "zq", "internationalization", "é", "übergrößen", "ñandú", "œuvre", "łódź"]  # such words reach the merges as they are, if these do
        as_they_are = whole(plain) == [direct(w) for w in plain]

        def encode_words(words):
            out = [direct(w) if as_they_are and lettered(w) else None for w in words]
            rest = iter(whole([w for w, ids in zip(words, out) if ids is None]))
            return [next(rest) if ids is None else ids for ids in out]

        folds = whole(["AbC", "THE"]) == whole(["abc", "the"])
        added = [t.content for t in model.get_added_tokens_decoder().values()]
        _HELD[path, lead] = WordIds(encode_words, width_of(model.get_vocab_size(with_added_tokens=True)), added if folds else None)
    return _HELD[path, lead]


def encoded(docs: DataFrame, path: str, end: int | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = 2 << 20, remembered: int | None = None) -> DataFrame:
    """Columns `keep`, part, at (the ids of the part before the row), n_tokens and ids (little-endian, 2 bytes
    each while the vocabulary allows it) of every row; `end` is appended to each text. Null texts are empty. A word is looked up
    once in each `most` bytes of text; a worker remembers two generations of `remembered` words (None for REMEMBERED)."""
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text"))
    schema = rows.drop("_text").schema.add("part", "integer").add("at", "long").add("n_tokens", "long").add("ids", "binary")

    def run(batches):
        from pyspark import TaskContext
        encode, part, total = library(path), TaskContext.get().partitionId(), 0
        encode.remembered = remembered
        size = encode.kind.itemsize
        last = b"" if end is None else int(end).to_bytes(size, "little")
        for block, texts in blocks(batches, "_text", most):
            ids = [row + last for row in encode(texts)]
            counts = np.array([len(row) // size for row in ids], np.int64)
            yield pa.RecordBatch.from_arrays([*block.columns[:len(keep)], pa.array(np.full(len(ids), part, np.int32)), pa.array(total + np.cumsum(counts) - counts),
                                              pa.array(counts), pa.array(ids, pa.binary())], names=[*keep, "part", "at", "n_tokens", "ids"])
            total += int(counts.sum())

    return mapped(rows, run, schema)


def unpacked(ids: bytes, width: int = 2) -> np.ndarray:
    """Ids of a binary value as unsigned 32-bit numbers."""
    return np.frombuffer(ids, f"<u{width}").astype("<u4")


def id_width(path: str) -> int:
    from tokenizers import Tokenizer
    return width_of(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True))
