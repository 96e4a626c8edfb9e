"""Spelling variants: words one edit apart, found by search schemes over a pair of FM-indexes.

One edit leaves a word's left or its right half as it is. The vocabulary, each word between two delimiters, is
indexed in both directions: in the forward index a search starts at the closing delimiter, matches the right half
exactly and goes on leftwards over the other half, allowing one error; in the index of the turned words
the left half is matched first. A search holds suffix-rank intervals, all words of a block side by side in numpy.

Whoever shares a half shares its last characters, so each direction is dealt by these: words meet the words
they can be near, block by block, and never the rest. Keys with over BLOCK words are cut into blocks that
the key's words search one after the other. Pairs are folded to a count and the best one where they are found.
"""
from __future__ import annotations

from collections import Counter
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringside.llm.common import blocks, mapped, ship, store

LETTERS = "A-Za-zÀ-ÿ"
#: Shortest word, least occurrences, and one word in so many loses a letter.
SHORTEST, LEAST, DAMAGED = 5, 3, 97
#: Distinct words that a task holds while it counts, words meant for one index, queries that are searched at once.
HELD, BLOCK, LANES = 300_000, 40_000, 8192
#: (least length, greatest length, characters of the key) of the words that search; those they can be near are one shorter to one longer.
CLASSES = ((5, 7, 2), (8, 11, 4), (12, 1 << 30, 6))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(docs: DataFrame, text: str = "text", key: str = "doc_id", damaged: int | None = DAMAGED, shortest: int = SHORTEST) -> DataFrame:
    """word and n: all words of at least `shortest` characters, A-Z lower-cased, counted over all texts.

    With `damaged`, a word whose crc32 (of "key:word") that number divides loses the character crc32 % length.
    """
    rows = docs.select(F.coalesce(docs[f"`{key}`"].cast("string"), F.lit("")).alias("_key"), docs[f"`{text}`"].alias("_text"))
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}").findall

    def run(batches):
        met = Counter()

        def flush():
            found = list(met)
            for at in range(0, len(found), 50_000):
                part = found[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([met[w] for w in part], pa.int64())], names=["word", "n"])

        for block, texts in blocks(batches, "_text", 1 << 20):
            for name, body in zip(block.column(0).to_pylist(), texts):
                own = Counter(runs(body.translate(_LOWER).decode("utf-8", "replace")))
                if damaged:
                    before = zlib.crc32(f"{name}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), before) % damaged == 0]:
                        at = zlib.crc32(word.encode(), before) % len(word)
                        less = word[:at] + word[at + 1:]
                        n = own.pop(word)
                        if len(less) >= shortest:
                            met[less] += n
                for word, n in own.items():
                    met[word] += n
            if len(met) > HELD:
                yield from flush()
                met.clear()
        yield from flush()

    return mapped(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """FM-index of a sorted list of distinct words over one-byte letters, each word between delimiters (byte 0)."""

    def __init__(self, entries: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(entries) + b"\0", np.uint8)
        self.size = n = len(text)
        order = self._suffixes(text)
        last = text[order - 1].copy()
        last[order == 0] = 1  # what precedes the first delimiter is no delimiter
        self.last, self.letters = last, np.unique(text[text > 0]).astype(np.int64)
        # (letter, rank) of all rows in order: a look-up is the number of smaller letters plus the letter's rank at once
        self.steps = np.sort(last.astype(np.int64) * (n + 1) + np.arange(n))
        self.rows = len(entries) + 1

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffixes in order; delimiters count by their place, so that no comparison leaves its word."""
        n, ends = len(text), np.flatnonzero(text == 0)
        word = np.searchsorted(ends, np.arange(n))
        left = ends[word] - np.arange(n)  # letters before the next delimiter
        width = 7
        key = np.zeros(n, np.int64)
        for i in range(width):
            letter = np.zeros(n, np.int64)
            letter[:n - i] = text[i:]
            key = key << 8 | np.where(left > i, letter, 0)
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            after = rank[np.minimum(np.arange(n) + width, n - 1)]
            key = rank * (2 * n + 2) + np.where(left < width, word, n + after)
            if width > left.max():
                return np.argsort(key, kind="stable")
            width *= 2

    def extend(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.steps, letter * (self.size + 1) + rank)

    def near(self, queries: list[bytes], exact: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of all entries exactly one edit from a query whose last `exact` letters they share; `own`: the query is an entry."""
        pairs = [self._near(queries[at:at + LANES], exact[at:at + LANES], own[at:at + LANES], at) for at in range(0, len(queries), LANES)]
        codes = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        return codes // self.rows, codes % self.rows

    def _near(self, queries, exact, own, first):
        data = np.frombuffer(b"".join(queries) + b"\0", np.uint8).astype(np.int64)
        length = np.array([len(q) for q in queries], np.int64)
        end = np.cumsum(length) - 1
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), self.rows, np.int64)
        for step in range(int(exact.max(initial=0))):
            on = np.flatnonzero((exact > step) & (hi > lo))
            letter = data[end[on] - step]
            lo[on], hi[on] = self.extend(letter, lo[on]), self.extend(letter, hi[on])
        q, at = np.arange(len(queries)), exact.astype(np.int64)
        branches = []
        while True:
            # an interval that holds the query alone has nothing else to offer
            kept = (hi - lo) > own[q]
            q, at, lo, hi = q[kept], at[kept], lo[kept], hi[kept]
            if not len(q):
                break
            more = at < length[q]
            branches.append((q[more], at[more] + 1, lo[more], hi[more]))  # a letter left out
            lane, letter = self._letters(lo, hi)
            a, b = self.extend(letter, lo[lane]), self.extend(letter, hi[lane])
            branches.append((q[lane], at[lane], a, b))  # one put in
            other = (at[lane] < length[q[lane]]) & (data[end[q[lane]] - np.minimum(at[lane], length[q[lane]] - 1)] != letter)
            branches.append((q[lane[other]], at[lane[other]] + 1, a[other], b[other]))  # one replaced
            q, at, lo, hi = q[more], at[more], lo[more], hi[more]
            letter = data[end[q] - at]
            lo, hi, at = self.extend(letter, lo), self.extend(letter, hi), at + 1
        if not branches:
            return np.zeros(0, np.int64)
        q, at, lo, hi = (np.concatenate(x) for x in zip(*branches))
        found = []
        while len(q):
            over = at == length[q]
            a, b = self.extend(0, lo[over]), self.extend(0, hi[over])  # the whole word, from delimiter to delimiter
            found.append((q[over][b > a] + first) * self.rows + a[b > a])
            q, at, lo, hi = q[~over], at[~over], lo[~over], hi[~over]
            letter = data[end[q] - at]
            lo, hi, at = self.extend(letter, lo), self.extend(letter, hi), at + 1
            kept = hi > lo
            q, at, lo, hi = q[kept], at[kept], lo[kept], hi[kept]
        return np.concatenate(found)

    def _letters(self, lo, hi):
        """(lane, letter) of all letters that stand before a row of a lane's interval."""
        few = np.flatnonzero(hi - lo <= 2 * len(self.letters))
        size = (hi - lo)[few]
        lane = np.repeat(few, size)
        row = np.arange(len(lane)) - np.repeat(np.cumsum(size) - size, size) + lo[lane]
        codes = np.unique(lane << 8 | self.last[row])
        codes = codes[(codes & 255) > 1]
        many = np.flatnonzero(hi - lo > 2 * len(self.letters))
        lane, letter = np.repeat(many, len(self.letters)), np.tile(self.letters, len(many))
        there = self.extend(letter, hi[lane]) > self.extend(letter, lo[lane])
        return np.concatenate([codes >> 8, lane[there]]), np.concatenate([codes & 255, letter[there]])


def _dealt(vocabulary: DataFrame) -> DataFrame:
    """(place, turned, s, n, asks, holds): every word where it searches and where it is searched, in both directions."""
    length, roles = F.length("word"), []
    for turned in (False, True):
        s = F.reverse("word") if turned else F.col("word")
        for i, (least, most, wide) in enumerate(CLASSES):
            holds = length.between(max(least - 1, SHORTEST), most + 1)
            roles.append(F.when(holds, F.struct(F.lit(2 * i + turned).alias("role"), F.lit(turned).alias("turned"), s.alias("s"), F.right(s, F.lit(wide)).alias("end"), length.between(least, most).alias("asks"))))
    rows = vocabulary.select(F.explode(F.array_compact(F.array(*roles))).alias("r"), "n").select("r.*", "n")
    sizes = rows.groupBy("role", "end").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)  # a BLOCK-th of the rows at most
    rows = rows.join(F.broadcast(sizes), ["role", "end"], "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("s"), "blocks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("holds", F.col("block") == F.col("own")).where(F.col("asks") | F.col("holds"))
    places = max(1, -(-vocabulary.count() // BLOCK))
    place = F.col("role") * places + F.pmod(F.xxhash64("end", "block"), F.lit(places))
    return rows.select(place.alias("place"), "turned", "s", "n", "asks", "holds")


def _search(group: pa.Table) -> pa.Table:
    """word, near (how many), best_n and best (the most frequent one, ties by code point) of the words of a place that have near ones."""
    turned = group.column("turned")[0].as_py()
    s = [w.encode("latin-1") for w in group.column("s").to_pylist()]
    n, asks, holds = (group.column(c).to_numpy() for c in ("n", "asks", "holds"))
    of = {s[i]: int(n[i]) for i in np.flatnonzero(holds)}
    entries = sorted(of)
    queries = sorted({s[i] for i in np.flatnonzero(asks)})
    if not entries or not queries:
        return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    halves = [len(q) // 2 if turned else len(q) - len(q) // 2 for q in queries]
    q, t = Index(entries).near(queries, np.array(halves, np.int64), np.array([w in of for w in queries]))
    plain = [w[::-1].decode("latin-1") if turned else w.decode("latin-1") for w in entries]
    if turned:  # what also shares the right half has been found by the other direction
        new = [not entries[j].startswith(queries[i][:len(queries[i]) - len(queries[i]) // 2]) for i, j in zip(q.tolist(), t.tolist())]
        q, t = q[new], t[new]
    counts = np.array([of[w] for w in entries], np.int64)
    place = np.empty(len(plain), np.int64)
    place[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
    order = np.lexsort((place[t], -counts[t], q))
    q, t = q[order], t[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    return pa.table({"word": pa.array([(queries[i][::-1] if turned else queries[i]).decode("latin-1") for i in q[first].tolist()], pa.string()),
                     "near": pa.array(np.diff(np.append(first, len(q)))), "best_n": pa.array(counts[t[first]]),
                     "best": pa.array([plain[j] for j in t[first].tolist()], pa.string())})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near and best (struct of n and word of the most frequent near word, or null) of every word of (word, n)."""
    dealt = _dealt(vocabulary)
    ship(vocabulary.sparkSession)
    found = dealt.groupBy("place").applyInArrow(_search, "word string, near bigint, best_n bigint, best string")
    found = found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b"))
    return vocabulary.join(found, "word", "left").select("word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """`forms` (word, form, ...) with root: the last word along the forms. Ways are halved by each round of joins, and a
    way is no longer than the times a count can double, so there are few rounds."""
    ways = forms.where("form is not null").select("word", F.col("form").alias("root"))
    ways = store(ways, "ways")
    while True:
        step = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = store(ways.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return forms.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, damaged: int | None = DAMAGED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with at least `least` occurrences.

    A word's form is its most frequent near word (ties: first by code points), if at least twice as frequent. Null
    texts have no words, a null key counts as empty in the damage; repeated rows count again. Runs of letters may
    be as long as they like. Other columns aren't read; an empty table gives no rows.
    """
    vocabulary = store(words(docs, text, key, damaged).where(F.col("n") >= least), "vocabulary")
    near = near_words(vocabulary)
    grown = F.col("best_n") >= 2 * F.col("n")
    forms = store(near.select("word", F.when(grown, F.col("best")).alias("form"), "n", "n_near", F.when(grown, F.col("best_n")).alias("form_n")), "forms")
    return rooted(forms).select("word", "form", "root", "n", "n_near", "form_n")
