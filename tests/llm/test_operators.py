"""The operators on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""
import collections
import hashlib
import io
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ringside.llm import attention, bpe, collocations, common, components, exact_dedup, files, langid, lm, minhash, neighbours, packing, queries, ring, shingles, subwords, syncmers, token_files, warc

WORDS = queries.VOCABULARY
BYTES = queries.public_tokenizers.path("byte_bpe_50k.json")
#: names that the operators use themselves
CLASHING = ["rid", "row", "digest", "key", "ids", "part", "at", "bucket", "lang_pred", "score", "letters", "kept", "class_id", "tie"]


def prose(seed, n, vocabulary="the a of cat river stone walks slowly under bright morning cloud while seven birds sing old songs near quiet water"):
    pick = random.Random(seed)
    return " ".join(pick.choice(vocabulary.split()) + str(pick.randrange(40)) for _ in range(n))


TEXTS = [(1, prose(1, 60)), (2, prose(1, 60)), (3, prose(1, 60).replace(" ", "\n\t ", 3)), (4, None), (5, ""), (6, " \n"), (7, prose(2, 9000)), (8, "12 !? ..."), (None, prose(1, 60)),
         (None, None), (9, "héllo Wörld ΣΑΣ 日本 😀 don't <|endoftext|> x"), (10, "x" * 5000), (11, prose(3, 80)), (12, prose(3, 80) + " more"), (12, prose(3, 80) + " more"), (0, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t and len(t) > 20 else None, "s", None if t is None else len(t), *["z"] * len(CLASHING)) for i, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def shown(df):
    return [r.asDict() for r in df.collect()]


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    index = exact_dedup.PerfectHash(digests[:2000])
    slots = index.slots(digests)
    assert sorted(slots[:2000]) == list(range(2000)) and (slots[2000:] == -1).all()
    assert (index.digests[slots[:2000]] == digests[:2000]).all() and (index.order[slots[:2000]] == np.arange(2000)).all()
    index.rest, index.levels = {d.tobytes(): i for i, d in enumerate(index.digests)}, []
    assert (index.slots(digests[:5]) == slots[:5]).all()
    assert (exact_dedup.PerfectHash(digests[:0]).slots(digests[:3]) == -1).all()


def test_exact_dedup(docs, nothing):
    kept = shown(exact_dedup.distinct(docs))
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(exact_dedup.WHITE, " ", t or "")].append(i)
    want = sorted(min(g, key=lambda i: (i is None, i or 0)) for g in groups.values())
    assert sorted(r["doc_id"] for r in kept) == want and all(r["rid"] == "z" and r["row"] == "z" for r in kept)
    assert exact_dedup.distinct(nothing).count() == 0 and exact_dedup.distinct(nothing).columns == docs.columns


def test_exact_dedup_prefers_the_history(spark):
    rows = spark.createDataFrame([(0, 9, "a"), (1, 3, "a"), (2, 4, "b"), (3, 5, "b")], "rid long, doc_id long, t string").select("rid", "doc_id", exact_dedup.digest(F.col("t")).alias("digest"))
    found = {r.rid: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(rows, F.col("doc_id") == 9).collect()}
    assert found == {0: (9, 2, True), 1: (9, 2, False), 2: (4, 2, True), 3: (4, 2, False)}


def slow_bits(learnt, text):
    counts = [collections.defaultdict(collections.Counter) for _ in range(langid.ORDER + 1)]
    for t in learnt:
        for i in range(len(t)):
            for k in range(min(i, langid.ORDER) + 1):
                counts[k][t[i - k:i]][t[i]] += 1
    held = [{c: v for c, v in level.items() if sum(v.values()) >= (langid.MIN_COUNT if k else 1)} for k, level in enumerate(counts)]
    total = 0.0
    for i in range(len(text)):
        k, known, p = min(langid.ORDER, i), set(), 1.0
        while text[i - k:i] not in held[k]:
            k -= 1
        while True:
            if k < 0:
                p /= 256 - len(known)
                break
            here = {c: n for c, n in held[k][text[i - k:i]].items() if c not in known}
            n, u = sum(here.values()), len(here)
            if text[i] in here:
                p *= here[text[i]] / (n + u)
                break
            p *= u / (n + u) if n else 1
            known = set(held[k][text[i - k:i]])
            k -= 1
        total -= np.log2(p)
    return total


def test_code_lengths():
    learnt = {"en": [b"the river and the stone", b"there they are"], "fr": [b"la rivi\xc3\xa8re et la pierre", b"les voil\xc3\xa0"]}
    walk = langid.Walker(langid.Model(list(learnt), [langid.count_tree(t) for t in learnt.values()]))
    texts = [b"", b"the stones are there", b"la pierre \x00\xff", b"t" * 4000, prose(5, 300).encode()]
    got = walk.bits(texts)
    for i, t in enumerate(texts):
        for j, name in enumerate(learnt):
            assert got[i, j] == pytest.approx(slow_bits(learnt[name], t), rel=1e-5, abs=1e-4)


def test_language_id(spark, docs, nothing):
    rows = [(i, prose(i, 40, v), l) for i in range(60) for l, v in (("en", "the and river with stone there"), ("fr", "les et rivière avec pierre voilà"))]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    found = shown(langid.predict(docs, model))
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r["lang_pred"] for r in found}
    assert [by_id[i] for i in (4, 5, 6, 8)] == ["und"] * 4 and by_id[1] == "en"
    fresh = spark.createDataFrame([(1, prose(900, 30, "les avec voilà"))], "doc_id long, text string")
    assert langid.predict(fresh, model).first().lang_pred == "fr"
    stay = langid.accepted(docs, model)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} >= {1, 2, 7, 11} and not {r.doc_id for r in stay.collect()} & {4, 5, 6, 8}
    none = langid.learn(nothing)
    assert none.languages == [] and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"} and langid.accepted(docs, none).count() == len(TEXTS)
    assert langid.predict(nothing, model).count() == 0


def test_shingles_and_signatures():
    texts = [t for _, t in TEXTS if t is not None]
    for t, (hashes, counts) in zip(texts, shingles.shingle_sets([t.encode() for t in texts])):
        words = t.lower().split()
        want = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else collections.Counter([tuple(words)] if words else [])
        assert sorted(counts) == sorted(want.values()) and len(hashes) == len(want)
    draw = np.random.default_rng(1)
    agree = []
    for _ in range(60):  # weights 1 and 3: probability Jaccard by its definition
        u = draw.integers(0, 2**64, 200, dtype=np.uint64)
        a, b = np.where(np.arange(200) < 150, 1.0, 0.0), np.where(np.arange(200) >= 50, np.where(np.arange(200) < 100, 3.0, 1.0), 0.0)
        agree.append((minhash.signature(u[a > 0], a[a > 0]) == minhash.signature(u[b > 0], b[b > 0])).mean())
    exact = sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in range(50, 150))
    assert np.mean(agree) == pytest.approx(exact, abs=0.03)
    x, y = np.unique(draw.integers(0, 2**64, 500, dtype=np.uint64)), np.unique(draw.integers(0, 2**64, 400, dtype=np.uint64))
    differing = np.unpackbits((minhash.parities(x) ^ minhash.parities(y)).view(np.uint8)).sum()
    assert differing <= len(np.setxor1d(x, y)) and not minhash.parities(x[:0]).any()


def test_near_duplicates_against_all_pairs(spark):
    base, pick, rows = [f"w{i}" for i in range(120)], random.Random(4), []
    for i in range(60):  # a family around one text: many members aren't similar to each other
        words = base[:]
        for _ in range(pick.choice([1, 1, 2, 3, 4, 5])):
            words[pick.randrange(120)] = f"v{i}-{pick.randrange(999)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(50 + i // 2, 30) + (" tail" if i % 2 else "")) for i in range(30)] + [(200, rows[0][1]), (201, rows[0][1].upper()), (202, ""), (203, None), (204, "a b"), (205, "a  b")]
    sets = [s for s, _ in shingles.shingle_sets([(t or "").encode() for _, t in rows])]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if shingles.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                parent[b] = a
    found = {r.doc_id: r for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: found[i].class_id for i, _ in rows} == {rows[k][0]: min(rows[m][0] for m in range(len(rows)) if top(m) == top(k)) for k in range(len(rows))}
    assert all(r.kept == (r.doc_id == r.class_id) for r in found.values())


def test_near_duplicates_with_a_repeated_passage(spark):
    rows = []
    for i in range(12):  # one copy alone repeats a passage: shingle sets are alike at 0.83, weighted ones at less than 0.6
        words = [f"w{i}-{j}" for j in range(404)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + [f"p{i}-{j}" for j in range(80)] * 100))]
    sets = [s for s, _ in shingles.shingle_sets([t.encode() for _, t in rows])]
    assert all(shingles.jaccard(a, b) >= 0.8 for a, b in zip(sets[::2], sets[1::2]))
    found = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}


def test_near_duplicates_on_awkward_rows(docs, nothing):
    kept = minhash.distinct(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [0, 1, 4, 7, 8, 9, 10, 11]
    assert minhash.near_classes(docs).count() == len(TEXTS) and minhash.near_classes(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_ids_are_the_librarys():
    library, own = subwords.library(WORDS), bpe.codec(WORDS)
    whole, pick = Tokenizer.from_file(WORDS), random.Random(3)
    texts = [t or "" for _, t in TEXTS] + ["".join(pick.choice("abAB'stSrevmdl .,\n\t́éΣİ\x1c\x85 1२<|>endoftext日😀") for _ in range(40)) for _ in range(800)] + ["<|STARTOFTEXT|>a<|startoftext|>"]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for encode in (library, own[1]):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in texts])] == want
    assert [own[0].encode(t) for t in texts] == want
    assert [own[0].decode(x) for x in want] == [whole.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_jobs(docs, nothing):
    ids = bpe.encode(docs, WORDS, keep=("doc_id", "rid"))
    whole = Tokenizer.from_file(WORDS)
    rows = shown(bpe.decode(ids, WORDS, keep=("doc_id", "ids")))
    assert sorted((tuple(r["ids"]), r["text"]) for r in rows) == sorted((tuple(x), whole.decode(list(x), skip_special_tokens=False)) for x in (whole.encode(t or "", add_special_tokens=False).ids for _, t in TEXTS))
    assert bpe.encode(nothing, WORDS).count() == 0


def test_rank_coding():
    draw = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1003):
        ranks = draw.integers(0, 2**32, n).astype("<u4") >> draw.integers(0, 32, n).astype("u4")
        assert (token_files.unpack(*token_files.pack(ranks), n) == ranks).all()


def test_token_files(docs, nothing, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    rows = shown(token_files.read(*token_files.write(docs, WORDS)))
    rows.sort(key=lambda r: r["start"])
    encode = Tokenizer.from_file(WORDS).encode
    assert [r["key"] for r in rows] == sorted((i for i, _ in TEXTS if i is not None)) + [None, None]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    texts = collections.defaultdict(set)
    for i, t in TEXTS:
        texts[i].add(np.array(encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert all(bytes(r["ids"]) in texts[r["key"]] for r in rows)
    assert token_files.read(*token_files.write(nothing, WORDS)).count() == 0


@pytest.mark.parametrize("length", [7, 2048])
def test_packing(docs, nothing, length):
    pieces = shown(packing.packed(docs, WORDS, length=length))
    sequences, total = collections.defaultdict(list), 0
    for p in pieces:
        assert p["length"] * 2 == len(p["ids"]) > 0
        sequences[p["sequence_id"]].append((p["offset"], bytes(p["ids"])))
    for k, s in sequences.items():
        at = 0
        for offset, ids in sorted(s):
            assert offset == at
            at += len(ids) // 2
        assert at == length or k == max(sequences) and at <= length
        total += at
    encode = Tokenizer.from_file(WORDS).encode
    assert sorted(sequences) == list(range(len(sequences))) and total == sum(len(encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    stream = b"".join(ids for k in sorted(sequences) for _, ids in sorted(sequences[k]))
    ids = np.frombuffer(stream, "<u2")
    got = collections.Counter(tuple(x) for x in np.split(ids, np.flatnonzero(ids == 1) + 1) if len(x))
    assert got == collections.Counter(tuple(encode(t or "", add_special_tokens=False).ids + [1]) for _, t in TEXTS)
    assert packing.packed(nothing, WORDS).count() == 0


def slow_ring(spark, keys, shards, replicas):
    places = [(r.position, r.shard) for r in ring.places(spark, shards, replicas).orderBy("arc").collect() if r.position is not None]
    position = {r.k: r.p for r in spark.createDataFrame([(k,) for k in set(keys)], "k long").select("k", F.xxhash64(F.lit("key"), "k").alias("p")).collect()}
    shard = [s for _, s in places] + [places[0][1]]
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    arcs = [[] for _ in shard]
    for k in sorted(keys, key=lambda k: position[k]):
        arcs[sum(p < position[k] for p, _ in places)].append(k)
    out, over, queue = collections.Counter(), [], []
    for a, own in enumerate(arcs):
        stay = min(len(own), room[shard[a]])
        room[shard[a]] -= stay
        out.update((k, shard[a]) for k in own[:stay])
        over.append(own[stay:])
    for a in [*range(len(arcs))] * 2:
        take = min(len(queue), room[shard[a]])
        room[shard[a]] -= take
        out.update((k, shard[a]) for k in queue[:take])
        queue = queue[take:] + over[a]
        over[a] = []
    assert not queue
    return out


@pytest.mark.parametrize("n,shards,replicas", [(400, 7, 4), (3, 7, 2), (90, 5, 3)])
def test_ring(spark, n, shards, replicas):
    keys = [i % 60 if n == 90 else 3 * i for i in range(n)] + [None] * 0
    rows = ring.assign(spark.createDataFrame([(k,) for k in keys], "doc_id long"), shards, replicas=replicas).collect()
    assert collections.Counter((r.doc_id, r.shard) for r in rows) == slow_ring(spark, keys, shards, replicas)
    for s in range(shards):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(n // shards + (s < n % shards)))


def test_ring_on_awkward_rows(docs, nothing):
    rows = ring.assign(docs.select("doc_id", "text", "rid"), 4).collect()
    assert sorted(collections.Counter(r.shard for r in rows).values()) == [4, 4, 4, 4] and {r.rid for r in rows} == {"z"}
    assert ring.assign(nothing.select("doc_id"), 4).count() == 0
    loose = ring.assign(docs.select("doc_id"), 4, load=2.0).collect()
    assert max(collections.Counter(r.shard for r in loose).values()) <= 8


def slow_anchors(text):
    points = syncmers.mixed(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)).tolist()

    def hashed(i, width):
        h = 0
        for p in points[i:i + width]:
            h = (h * syncmers._M + p) % 2**64
        return int(syncmers.mixed(np.array([h], np.uint64))[0])

    inner, out = [hashed(i, syncmers.S) for i in range(len(text) - syncmers.S + 1)], {}
    for i in range(len(text) - syncmers.K + 1):
        window = inner[i:i + syncmers.K - syncmers.S + 1]
        if min(window) in (window[0], window[-1]):
            out.setdefault(hashed(i, syncmers.K) >> 32, i)
    return sorted(out.items())[:syncmers.SAMPLE]


def test_syncmers():
    texts = ["", "ab", "x" * 15, "y" * 16, "é日" * 40, prose(1, 300), "same words " * 200, prose(2, 20)]
    found = syncmers.anchors(texts)
    for t, (h, p) in zip(texts, found):
        assert list(zip(h.tolist(), p.tolist())) == slow_anchors(t) if len(t) >= syncmers.K else len(h) == bool(t)
    prints = [syncmers.parsed(syncmers.written(len(t), *a)) for t, a in zip(texts, found)]
    assert all(syncmers.likeness(p, p) == 1 for p in prints) and syncmers.likeness(prints[0], prints[1]) == 0
    moved = "a few words go before " + texts[5]
    assert syncmers.likeness(prints[5], syncmers.parsed(syncmers.written(len(moved), *syncmers.anchors([moved])[0]))) > 0.8 > 0.1 > syncmers.likeness(prints[5], prints[6])


def test_a_fingerprint_holds_every_anchor_of_a_long_text():
    """A passage of 30 words that two long texts share is seen, and so is a small edit; the texts have thousands of anchors."""
    shared, a, b = prose(31, 30), prose(32, 4000), prose(33, 4000)
    one, two = a + " " + shared, b + " " + shared
    (h, p), (g, q), (e, r) = syncmers.anchors([one, two, one.replace(shared, "")])
    assert len(h) == len(slow_anchors(one)) > 2000 and dict(zip(h.tolist(), p.tolist())) == dict(slow_anchors(one))
    assert set(syncmers.anchors([shared])[0][0].tolist()) <= set(h.tolist()) & set(g.tolist())
    assert 0.99 < syncmers.alike(len(one), h, p, len(one), e, r) < 1
    length, pairs = syncmers.parsed(syncmers.written(len(one), h, p))
    assert (length, pairs) == (len(one), dict(zip(h.tolist(), p.tolist())))
    assert syncmers.written(len(one), h, p) == " ".join([f"{len(one):x}", *(f"{x:08x}.{y:x}" for x, y in zip(h.tolist(), p.tolist()))])

    def slow(n, x, m, y):
        shifts = sorted(x[k] - y[k] for k in x.keys() & y.keys())
        usual = shifts[len(shifts) // 2]
        return sum(abs(s - usual) <= max(n, m) * syncmers.DRIFT for s in shifts) / len(x.keys() | y.keys())
    fresh = dict(zip(e.tolist(), r.tolist()))
    assert syncmers.likeness((len(one), pairs), (len(one), fresh)) == slow(len(one), pairs, len(one), fresh)


def test_neighbours(spark, docs, nothing):
    def pairs(keys, bodies, nexts):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies), pa.array(nexts)], names=["key", "text", "next"])

    def run(df):
        return [(r.key, bytes(r.text).decode(), bytes(r.next).decode()) for r in neighbours.with_next(df, pairs, "key bigint, text binary, next binary").collect()]

    found = run(docs)
    assert collections.Counter((k, t) for k, t, _ in found) == collections.Counter((i, t or "") for i, t in TEXTS)
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("doc_id"), F.col("id").cast("string").alias("text"))
    own = {r.doc_id: r.text for r in rows.collect()}
    assert {(k, t, n) for k, t, n in run(rows)} == {(k, own[k], own[(k + 1) % 1000]) for k in own}
    assert run(nothing) == [] and run(spark.createDataFrame([(5, "a")], "doc_id long, text string")) == [(5, "a", "a")]


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    long = "<p>" + prose(1, 200)
    pages = [(5, "http://a/x y\r\nz", long), (3, "http://b", long), (None, None, long), (7, None, None), (8, "u", ""), (9, "u", "short"), (2, "u", "short"), (11, "ü", "é\r\n\r\n" * 60), (12, "u", "é\r\n\r\n" * 60), (12, "u", "é\r\n\r\n" * 60)]
    rows = warc.read(*warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert collections.Counter((r.key, r.url) for r in rows) == collections.Counter((k, u) for k, u, _ in pages)
    for r in rows:
        body = next(h or "" for k, _, h in pages if k == r.key).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == body)
    assert collections.Counter((r.key, r.record_type, r.refers_to) for r in rows if r.payload_bytes > 99) == collections.Counter(
        [(3, "response", None), (5, "revisit", 3), (None, "revisit", 3), (11, "response", None), (12, "revisit", 11), (12, "revisit", 11)])
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 100)
    assert warc.read(*warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_reader_finds_faults():
    good = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"x" * 200_000)
    assert [len(b) for _, b in warc.records(io.BytesIO(good * 3))] == [200_000] * 3
    for bad in (good[:-9], good + b"rubbish"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


def test_attention_gradients():
    f = attention.Frequencies.of(np.arange(80, 0, -1).astype(float), np.arange(80) % 3 == 0, np.ones((attention.OWN + 2, attention.OWN + 1)))
    draw, w = np.random.default_rng(2), attention.start()
    ranks, lengths = draw.integers(0, 80, 100), np.array([70, 30])
    trie = draw.random(100).astype(np.float32), draw.integers(0, attention.TRUSTS, 100)
    text, first = attention.windows(lengths)
    *inputs, scored = attention.gathered(ranks, trie, lengths, text, first)
    assert scored.sum() == 100  # every target once
    p, kept = attention.forward(w, f, *inputs, keep=True)
    g = attention.backward(w, f, kept, p, scored, aside=0.0)
    for name in w:
        i = np.unravel_index(np.abs(g[name]).argmax(), w[name].shape)
        sides = []
        for step in (1e-2, -1e-2):
            other = {k: v.astype(np.float64) for k, v in w.items()}
            other[name][i] += step
            sides.append(-(np.log(attention.forward(other, f, *inputs)) * scored.ravel()).sum() / scored.sum())
        assert g[name][i] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=1e-2, abs=1e-5)


def test_attention_is_a_distribution_and_causal():
    size = 60
    f = attention.Frequencies.of(np.arange(size, 0, -1).astype(float), np.arange(size) % 3 == 0, np.zeros((attention.OWN + 2, attention.OWN + 1)))
    w, ranks = attention.start(), np.random.default_rng(2).integers(0, size, 40)
    for place in (0, 5, 31, 39):
        total = 0
        for last in range(size):
            changed = ranks.copy()
            changed[place] = last
            trie = np.full(40, 0.0, np.float32), np.zeros(40, np.int64)  # word continuations left out: less than a whole
            text, first = attention.windows(np.array([40]))
            *inputs, scored = attention.gathered(changed, trie, np.array([40]), text, first)
            p = attention.forward(w, f, *inputs).reshape(scored.shape)
            at = first[:, None] + np.arange(attention.WINDOW)
            total += p[(at == place) & scored].sum()
            if last == 0:
                before = p[(at < place) & scored]
            assert np.allclose(before, p[(at < place) & scored])
        assert total <= 1 + 1e-4 and total > 0.9


def test_attention_is_what_plain_loops_say():
    size, draw = 3 * attention.OWN, np.random.default_rng(4)
    starts = np.arange(size) % 3 == 0
    f = attention.Frequencies.of(np.arange(size, 0, -1).astype(float), starts, draw.integers(0, 9, (attention.OWN + 2, attention.OWN + 1)).astype(float))
    w, lengths = {k: v + draw.normal(0, 0.1, v.shape).astype(np.float32) for k, v in attention.start().items()}, np.array([45, 1])
    ranks, trie = draw.integers(0, size, 46), (draw.random(46).astype(np.float32), draw.integers(0, attention.TRUSTS, 46))
    text, first = attention.windows(lengths)
    previous, target, likely, trust, scored = attention.gathered(ranks, trie, lengths, text, first)
    found, kept = attention.forward(w, f, previous, target, likely, trust, keep=True)
    for b in range(len(text)):
        inputs = [w["input"][attention.input_rows(previous[b, i:i + 1])[0]] + w["place"][i] for i in range(attention.WINDOW)]
        looks = [np.split(x @ w["look"], 3) for x in inputs]
        for i in range(attention.WINDOW):
            heed = np.exp([looks[i][0] @ looks[j][1] / attention.WIDTH**0.5 for j in range(i + 1)])
            state = inputs[i] + sum(h * looks[j][2] for j, h in enumerate(heed / heed.sum())) @ w["mix"]
            e, t, before = np.exp(state @ w["head"] + w["bias"][0]), target[b, i], previous[b, i]
            classes, gates = e[:attention.CLASSES], e[attention.CLASSES:] * np.exp(w["trust"][trust[b, i]])
            begins, c = starts[t], f.classes[t]
            row = attention.OWN + 1 if before < 0 else min(before, attention.OWN)
            ways = [classes[c] / classes.sum() * f.inside[t], f.after[row, min(t, attention.OWN)] * f.share[t],
                    likely[b, i] * (classes[c] / classes[:f.start_classes].sum() * f.inside[t] if begins else 1), f.alone[t]]
            assert found[b * attention.WINDOW + i] == pytest.approx(gates @ ways / gates.sum(), rel=1e-3)
    g = attention.backward(w, f, kept, found, scored)
    met = set(attention.input_rows(previous.ravel()).tolist())
    assert set(np.flatnonzero(np.abs(g["input"]).sum(1)).tolist()) <= met and g["input"].shape == w["input"].shape


def test_lm_prefixes_hold_little_beside_their_results():
    starts = np.arange(65536) % 3 == 0
    ids = np.random.default_rng(1).integers(0, 5000, 600_000).astype("<u2")
    ids[0] = 0
    lm.prefixes(ids, starts)
    tracemalloc.start()
    hashes, tails = lm.prefixes(ids, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * len(ids)  # 89 bytes an id when a million ids were hashed at once
    for at in (0, lm._CHUNK - 1, lm._CHUNK, 599_000):  # and they are the same wherever a chunk ends
        low = int(np.flatnonzero(starts[ids[:at]])[-1]) if at else 0
        some = lm.prefixes(ids[low:at + 50], starts)
        assert (some[0][at - low + 1:] == hashes[at + 1:at + 50]).all() and (some[1][at - low + 2:] == tails[at + 2:at + 50]).all()
    keys = hashes[:5000].view(np.uint64)
    assert (lm._distinct(keys) == np.unique(keys)).all() and len(lm._distinct(keys[:0])) == 0


def test_lm_words():
    starts = lm.vocabulary(BYTES, 50256)
    encode = subwords.library(BYTES, " ")
    ids = np.concatenate([np.frombuffer(encode([t])[0] + (50256).to_bytes(2, "little"), "<u2") for t in (b"the rivers rivers", b"", b"the riverbed")])
    hashes, tails = lm.prefixes(ids, starts)
    ends = np.flatnonzero((tails & 0xFFFF) == lm._NEXT_WORD)
    words = [hashes[i] for i in ends if i and ids[i - 1] != 50256]
    assert len(words) == 5 and words[0] == words[3] and words[1] == words[2] and len(set(words)) == 3
    table = lm.Table(keys := lm.mixed(np.arange(5000, dtype=np.uint64)), np.arange(5000, dtype=np.float32), np.zeros(5000, np.uint8))
    assert (table.values[table.find(keys)] == np.arange(5000)).all() and (table.find(lm.mixed(np.arange(9000, 9999, dtype=np.uint64))) < 0).mean() > 0.99


def test_lm_scores(docs, nothing):
    rows = lm.encoded(docs, F.col("doc_id") != 11, BYTES, 50256)
    found = shown(lm.scored(rows, *lm.learn(rows, BYTES, 50256)))
    counts = collections.Counter()
    for i, t in TEXTS:
        if i is not None and i != 11:
            counts.update([*lowered(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in TEXTS:
        words = [*lowered(t), "\n"]
        want[i, len(words), sum(w in counts for w in words), round(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 3)] += 1
    assert collections.Counter((r["key"], r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in found) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in found)
    none = lm.encoded(nothing, F.lit(True), BYTES, 50256)
    assert lm.scored(none, *lm.learn(none, BYTES, 50256)).count() == 0
    untaught = lm.encoded(docs, F.lit(False), BYTES, 50256)
    assert {r["n_known"] for r in shown(lm.scored(untaught, *lm.learn(untaught, BYTES, 50256)))} == {0}


def test_lm_scores_whatever_is_held(docs, monkeypatch):
    found = []
    for edges in (lm.EDGES, 5):  # rarer ways on are joined, not left to shorter contexts
        monkeypatch.setattr(lm, "EDGES", edges)
        rows = lm.encoded(docs, F.col("doc_id") != 11, BYTES, 50256)
        found.append(sorted((r["key"] is None, r["key"], r["n_tokens"], r["score"]) if r["key"] is not None else (True, 0, r["n_tokens"], r["score"]) for r in shown(lm.scored(rows, *lm.learn(rows, BYTES, 50256)))))
    assert [x[:3] for x in found[0]] == [x[:3] for x in found[1]]
    assert [x[3] for x in found[0]] == pytest.approx([x[3] for x in found[1]], rel=1e-3)


def test_lm_weights_are_trained_on_every_training_text(docs):
    rows = lm.encoded(docs, F.col("doc_id") != 11, BYTES, 50256)
    model, _ = lm.learn(rows, BYTES, 50256)
    assert model.trained_ids == sum(len(r["ids"]) // 2 for r in shown(rows) if r["learns"]) > 0


def test_lm_keeps_no_intermediate_tables_or_shuffle_files(spark, docs, monkeypatch):
    folder, context = common.shared_folder(spark).removeprefix("file:"), spark.sparkContext

    def tables():
        return collections.Counter(name.rsplit("-", 1)[0].split("-")[0] for name in os.listdir(folder))

    def shuffled():
        files = context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in files if "shuffle_" in f}

    monkeypatch.setattr(lm, "EDGES", 5)
    before, kept = tables(), shuffled()
    rows = lm.encoded(docs, F.col("doc_id") != 11, BYTES, 50256)
    model, words = lm.learn(rows, BYTES, 50256)
    assert tables() - before == {"ids": 1, "edges": 1, "ways": 1}
    for _ in range(50):  # they are removed beside the work
        if not shuffled() - kept:
            break
        time.sleep(0.2)
    assert not shuffled() - kept
    scores = lm.scored(rows, model, words)
    assert tables() - before == {"ids": 1, "edges": 1, "ways": 1, "scores": 1}
    # nine bytes for each way on that isn't held, whatever the text
    ways = [(len(r["values"]), len(r["spared"]), len(r["marks"])) for r in shown(model.answered[1])]
    assert all(a == b == 4 * c for a, b, c in ways) and sum(c for _, _, c in ways) > 50
    assert scores.count() == docs.count()


def test_lm_scores_other_rows_like_its_own(docs, monkeypatch):
    monkeypatch.setattr(lm, "EDGES", 5)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    monkeypatch.setattr(lm, "RANGE_BYTES", 100)
    rows = lm.encoded(docs, F.col("doc_id") % 3 == 0, BYTES, 50256)
    model, words = lm.learn(rows, BYTES, 50256)
    own = shown(lm.scored(rows, model, words))
    others = shown(lm.scored(lm.encoded(docs, F.lit(False), BYTES, 50256), model, words))

    def told(found):
        return sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in found)

    assert [x[:2] for x in told(own)] == [x[:2] for x in told(others)]
    assert np.allclose([x[2:] for x in told(own)], [x[2:] for x in told(others)], rtol=1e-6)


def test_packing_remembers_few_words(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 300, raising=False)
    taken = []
    monkeypatch.setattr(subwords, "mapped", lambda rows, run, schema: taken.append(run) or rows)
    monkeypatch.setattr(packing, "store", lambda df, label: df)
    monkeypatch.setattr(packing, "placed", lambda tokens: tokens)
    monkeypatch.setattr(packing, "cut", lambda *a: None)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("", (), {"partitionId": lambda self: 0})())
    subwords._HELD.clear()
    packing.packed(spark.createDataFrame([], "doc_id long, text string"), WORDS)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["doc_id", "_text"]) for i, t in enumerate(texts)]
    found = [row for b in taken[0](iter(batches)) for row in b.column(4).to_pylist()]
    held = next(iter(subwords._HELD.values()))
    assert len(held.known) <= 300 and len(held.older) <= 300
    subwords._HELD.clear()
    assert found == [ids + (1).to_bytes(2, "little") for ids in subwords.library(WORDS)([t.encode() for t in texts])]


def test_packing_alone_encodes_a_word_once(spark, monkeypatch):
    taken, asked = [], collections.Counter()
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    monkeypatch.setattr(subwords, "mapped", lambda rows, run, schema: taken.append(run) or rows)
    monkeypatch.setattr(packing, "store", lambda df, label: df)
    monkeypatch.setattr(packing, "placed", lambda tokens: tokens)
    monkeypatch.setattr(packing, "cut", lambda *a: None)
    monkeypatch.setattr(queries, "table", lambda *a: spark.createDataFrame([], "doc_id long, text string"))
    monkeypatch.setattr(queries, "_with_crc", lambda rows, width: spark.range(0).selectExpr(*[f"id AS {c}" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("", (), {"partitionId": lambda self: 0})())
    subwords._HELD.clear()
    queries.op7_packing(spark, "")
    encode = subwords.library(WORDS)
    encode_words = encode.encode_words
    encode.encode_words = lambda words: asked.update(words) or encode_words(words)
    for turn in range(3):
        batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([" ".join(f"w{i}x{j}" for j in range(50))])], names=["doc_id", "_text"]) for i in range(20)]
        assert sum(b.num_rows for b in taken[0](iter(batches))) == 20
    subwords._HELD.clear()
    assert len(asked) == 1000 and set(asked.values()) == {1}


@pytest.mark.parametrize("bucket_bits", [3, 6, 8])
def test_mining_holds_its_phrases_once(spark, monkeypatch, bucket_bits):
    taken, width = [], 5
    monkeypatch.setattr(collocations, "HELD", 1_000_000)

    class Caught(Exception):
        pass

    def caught(rows, run, schema):
        taken.append(run)
        raise Caught

    monkeypatch.setattr(collocations, "mapped", caught)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("", (), {"partitionId": lambda self: 1})())
    with pytest.raises(Caught):
        collocations.mine(None, [], 10, 20, bucket_bits, width)
    draw = np.random.default_rng(5)
    texts = [" ".join(map(str, draw.integers(0, 700_000, 10_000).tolist())) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["_lang", "_text"])
    sent, tracked = collections.Counter(), []
    tracemalloc.start()
    for b in taken[0](iter([batch])):
        tracked.append(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for b in tracked:
        for r in b.to_pylist():
            planes, n = np.frombuffer(r["keys"], np.uint8).reshape(width, -1).T, np.frombuffer(r["n"], np.uint8)
            whole = np.zeros((len(n), 8), np.uint8)
            whole[:, :width] = planes
            keys = whole.view("<u8").ravel()
            assert r["shard"] == 1 and (keys >> np.uint64(8 * width - bucket_bits) == r["bucket"]).all()
            sent.update(dict(zip(keys.tolist(), n.tolist())))
    salt = np.array([collocations.salt_of("en")], np.uint64)
    words = collections.Counter(w for t in texts for w in t.split())
    keys = collocations.Words([" ".join(words).encode()], salt).keys >> np.uint64(64 - 8 * width)
    want = collections.Counter()
    for k, n in zip(keys.tolist(), words.values()):
        want[k] += n
    assert sent == collections.Counter({k: min(n, 10) for k, n in want.items()}) and peak < 40_000_000


def test_signing_holds_few_texts_at_once(docs, monkeypatch):
    taken = []
    monkeypatch.setattr(minhash, "mapped", lambda rows, run, schema: taken.append(run))
    minhash.signed(docs.select(F.col("doc_id").alias("rid"), "text"))
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 50_000, 300)) for _ in range(2000)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["rid", "text"])
    tracemalloc.start()
    signed = list(taken[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in signed) == len(texts) and peak < 60_000_000


def test_a_worker_lets_go_of_other_operators_tables(docs):
    def held(batches):
        langid._WALKERS[0] = subwords._HELD["a", "b"] = "of the tasks before"
        common.take_over("ringside.llm.langid")
        langid._WALKERS[0] = "tables"
        common.take_over("ringside.llm.langid")
        same = len(langid._WALKERS)
        for batch in batches:
            pass
        common.take_over("ringside.llm.minhash")
        yield pa.RecordBatch.from_arrays([pa.array([same]), pa.array([len(langid._WALKERS) + len(subwords._HELD)])], names=["same", "others"])

    found = common.mapped(docs.coalesce(1).select("doc_id"), held, "same long, others long").first()
    assert (found.same, found.others) == (1, 0)


def test_words_are_looked_up_once_a_block():
    class Counting(dict):
        looks = 0

        def __getitem__(self, key):
            Counting.looks += 1
            return super().__getitem__(key)

        def get(self, key, other=None):
            Counting.looks += 1
            return super().get(key, other)

        def __contains__(self, key):
            Counting.looks += 1
            return super().__contains__(key)

    encode = subwords.WordIds(lambda words: [[len(w), 7] for w in words], 2, None)
    text = b" one  three\nthree five, " * 3
    want = encode([text, b"", b"five,"])
    assert [np.frombuffer(x, "<u2").tolist() for x in want] == [[3, 7, 5, 7, 5, 7, 5, 7] * 3, [], [5, 7]]
    encode.known = Counting(encode.known)
    assert encode([text, b"", b"five,"]) == want and Counting.looks == 3


def lowered(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def test_files(tmp_path):
    out = files.Writer(f"file://{tmp_path}/a.bin")
    out.write(b"xy")
    assert not (tmp_path / "a.bin").exists()
    out.close()
    with files.reader(f"file://{tmp_path}/a.bin") as stream:
        assert stream.read() == b"xy"


def test_pipeline(docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.store(stage(docs.sparkSession, kept, ""), name)
        assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert {1, 7, 11} <= {i for _, i in ids} <= {0, 1, 7, 9, 10, 11}
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r.doc_id for r in stage(docs.sparkSession, kept, "").collect()} == {i for _, i in ids}
