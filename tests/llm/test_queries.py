"""The registered queries themselves on a small folder, against plain Python; operators 11 to 13 on awkward rows."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ringside.llm import bpe, collocations, lm, queries, ring, spelling, syncmers, token_counts

WORDS = queries.VOCABULARY
BYTES = queries.public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ["rid", "row", "word", "n", "phrase", "rank", "key", "s", "end", "place", "best", "_key", "_text", "size"]
VOCABULARY = "river stone walking walkng walkin slowly slowley brght bright morning mornin clouds cloud seven éclair eclair éclairs ÉCLAIR Zürich zürich naïve".split()


def prose(seed, n):
    pick = random.Random(seed)
    return "".join(pick.choice(VOCABULARY) + pick.choice([" ", " ", " ", "  ", ", ", ".\n", "\t"]) for _ in range(n))


TEXTS = [(1, prose(1, 900), "en"), (2, prose(1, 900), "en"), (3, None, "en"), (4, "", None), (5, " \n.,;", "fr"), (6, prose(2, 400), None), (7, prose(3, 700), "fr"),
         (8, "x" * 5000 + " " + "x" * 5000, "en"), (9, "héllo 日本 😀 don't <|endoftext|> \x00 a\xa0b ՘  ", "fr"), (10, prose(4, 1500), "en"), (10, prose(4, 1500), "en"), (0, prose(5, 30), "de")]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in TEXTS]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def clashing(rows):
    return rows.select("*", *[F.lit("z").alias(c) for c in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Documents with distinct ids, as a folder that the queries read."""
    place = str(tmp_path_factory.mktemp("tables"))
    rows.dropDuplicates(["doc_id"]).repartition(3).write.parquet(f"{place}/documents.parquet")
    return place


def texts_of(folder, spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def run(name, spark, folder):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------------------ phrase collocations
def slow_collocations(texts, support=10, top=2000):
    """The definition, phrase by phrase."""
    out = []
    by_lang = collections.defaultdict(list)
    for _, t, lang in texts:
        by_lang[lang or "und"].append(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for lang, bodies in by_lang.items():
        f, n = collections.Counter(), 0
        for body in bodies:
            for piece in re.split("[.,;:!?\x0a-\x0d]", body):
                words = re.findall("[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i:i + size]) for size in (1, 2, 3) for i in range(len(words) - size + 1))
        ranked = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < support:
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            longer = [f[p] for p in f if len(p) == 3 and f[p] >= support and len(phrase) == 2 and phrase in (p[:2], p[1:])]
            if not any(100 * x >= 50 * a for x in longer):
                ranked.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def test_collocations(clashing):
    got = sorted(tuple(r) for r in collocations.collocations(clashing).collect())
    assert got == slow_collocations(TEXTS) and len(got) > 20
    assert sorted(tuple(r) for r in collocations.collocations(clashing, support=3, top=5).collect()) == slow_collocations(TEXTS, 3, 5)
    empty = collocations.collocations(clashing.limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_with_full_maps(clashing, monkeypatch):
    """Bits that many keys share only add candidates; tasks that send early and buckets of any number change nothing."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 9)
    monkeypatch.setattr(collocations, "BITS", 9)
    monkeypatch.setattr(collocations, "HELD", 200)
    monkeypatch.setattr(collocations, "STRINGS", 50)
    assert sorted(tuple(r) for r in collocations.collocations(clashing).collect()) == slow_collocations(TEXTS)


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", 2, "a b", 4 * 10**12), ("en", 1, "a", 9 * 10**12), ("en", 1, "b", 5 * 10**12 + 1)], "lang string, size int, phrase string, n long")
    assert collocations.scored(found).first().score == 10**6 * (4 * 10**12) ** 2 // (9 * 10**12 * (5 * 10**12 + 1))


def test_phrases_follow_the_maps():
    """A phrase is looked at where both its shorter parts are on their maps, and never across a break."""
    words = collocations.Words([b"a b c d, e f", b"a b"], np.zeros(2, np.uint64))
    every = np.full(1 << 10, 255, np.uint8)
    assert words.phrases([every])[1].tolist() == [0, 1, 2, 4, 6] and words.phrases([every, every])[1].tolist() == [0, 1]
    pairs = words.phrases([every])[0]
    assert pairs[0] == pairs[4] and len(set(pairs.tolist())) == 4


# --------------------------------------------------------------------------- spelling variants
def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(texts, least=3):
    counts = collections.Counter()
    for ident, t in texts:
        for word in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{ident}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 5:
                counts[word] += 1
    held = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in held if one_apart(w, v)] for w in held}
    form = {}
    for w, n in held.items():
        best = min(near[w], key=lambda v: (-held[v], v), default=None)
        form[w] = best if best is not None and held[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), held[form[w]] if form[w] else None) for w, n in held.items()}


def found_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_variants(clashing, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD", 7)
    got = found_variants(spelling.variants(clashing))
    assert got == slow_variants([(i, t) for i, t, _ in TEXTS]) and any(v[0] for v in got.values()) and any(v[3] > 1 for v in got.values())
    assert spelling.variants(clashing.limit(0)).count() == 0


def test_variants_of_random_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 50)
    pick = random.Random(6)
    vocabulary = ["".join(pick.choice("abé") for _ in range(pick.randrange(5, 14))) for _ in range(250)]
    texts = [(i, " ".join(pick.choice(vocabulary) for _ in range(200))) for i in range(12)]
    got = found_variants(spelling.variants(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == slow_variants(texts)


def test_index_finds_all_within_one_edit():
    pick = random.Random(9)
    entries = sorted({"".join(pick.choice("abÿ") for _ in range(pick.randrange(2, 9))).encode("latin-1") for _ in range(400)})
    queries_ = entries[::2] + [b"abab" + bytes([c]) for c in b"xyz"]
    exact = np.array([len(q) - len(q) // 2 for q in queries_])
    q, t = spelling.Index(entries).near(queries_, exact, np.array([w in entries for w in queries_]))
    want = {(i, j) for (i, a), (j, b) in itertools.product(enumerate(queries_), enumerate(entries))
            if b.endswith(a[len(a) - exact[i]:]) and one_apart(a[:len(a) - exact[i]], b[:len(b) - exact[i]])}
    assert set(zip(q.tolist(), t.tolist())) == want and len(q) == len(want)


def test_roots_of_a_long_way(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)] + [("x", "w20"), ("alone", None)], "word string, form string")
    assert {r.word: r.root for r in spelling.rooted(forms).collect()} == {**{f"w{i}": "w40" for i in range(41)}, "x": "w40", "alone": "alone"}


# ------------------------------------------------------------------------------- token counts
def test_token_counts(clashing):
    whole = Tokenizer.from_file(BYTES)
    got = collections.Counter(tuple(r) for r in token_counts.counted(clashing, BYTES, limit=40).collect())
    want = collections.Counter()
    for i, t, _ in TEXTS:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 40] += 1
    assert got == want and token_counts.counted(clashing.limit(0), BYTES).count() == 0
    keyless = clashing.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.n_tokens for r in token_counts.counted(keyless, BYTES).collect()) == sorted(n for (_, _, n, _), k in want.items() for _ in range(k))


def test_token_lengths_equal_the_librarys(monkeypatch):
    monkeypatch.setattr(token_counts, "MISSES", 2000)
    whole, pick = Tokenizer.from_file(BYTES), random.Random(7)
    lengths = token_counts.Lengths(BYTES, {" a": 1, "b": 1}, token_counts.odd_characters(BYTES))
    parts = ["a", " b", "'s", "'ll", "  ", "\n", "é", "日", "😀", "12", "٣", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|", "!", "ͅ", "՘", "֋", "ꟑ", "Ⅷ", "²", "​"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(12)))
        assert lengths.count(text) == len(whole.encode(text, add_special_tokens=False).ids), text
    assert lengths[" a"] == 1


def test_the_most_frequent_rows_are_bounded(spark):
    for counts in ([100_000] * 20, [10**6 + i for i in range(20)], [3] * 12 + [9] * 3 + [10**9] * 5, [1] * 20, []):
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "id long, n long")
        for limit in (0, 1, 5, 7, 19, 20, 50):
            kept = sorted(r.n for r in lm._most(rows, limit).collect())
            assert min(limit, len(counts)) - 2 <= len(kept) <= limit
            if max(counts, default=0) < 100_000 or counts[:1] == [3]:
                assert kept == sorted(counts)[len(counts) - len(kept):]


# ----------------------------------------------------------------------------- the queries
def test_op1_and_op9_have_sql():
    assert {"op1_exact_dedup", "op9_warc", "op11_collocations"} <= queries.ORACLES.keys()


def test_op2_token_files(spark, folder):
    encode, start = Tokenizer.from_file(WORDS).encode, 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run("op2_token_files", spark, folder)}
    for i, t in sorted(texts_of(folder, spark).items()):
        ids = encode(t, add_special_tokens=False).ids + [1]
        assert got.pop(i) == (start, len(ids), crc_of(ids))
        start += len(ids)
    assert not got


def test_op5_ring_shards(spark, folder):
    got, texts = run("op5_ring_shards", spark, folder), texts_of(folder, spark)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) <= 1 and all(r["law"] == "rows" and r["slot"] == 0 and r["grown_shard"] is None for r in got)


@pytest.mark.parametrize("load,moved,exchanged", [(1.0, 0.06, 0.04), (1.25, 0.04, 0.02)])
def test_ring_moves_few_rows(spark, load, moved, exchanged):
    rows = spark.range(10_000).withColumnRenamed("id", "doc_id").withColumns({"shard": F.lit("old"), "ring_arc": F.lit(1), "slot": F.lit(2)})
    small = {r.doc_id: r for r in ring.assign(rows, 40, load=load).collect()}
    large = {r.doc_id: r for r in ring.assign(rows, 41, load=load).collect()}
    changed = [(small[i].shard, large[i].shard) for i in small if small[i].shard != large[i].shard]
    assert len(changed) <= moved * 10_000 and sum(b != 40 for _, b in changed) <= exchanged * 10_000
    assert max(collections.Counter(r.shard for r in small.values()).values()) <= load * 250
    assert small[0].ring_arc == 1 and ring.assign(rows, 40).columns == ["doc_id", "ring_arc", "shard", "slot"]


def test_op6_syncmers(spark, folder):
    texts = texts_of(folder, spark)
    order = sorted(texts)
    got = {r["doc_id"]: r for r in run("op6_syncmers", spark, folder)}

    def print_of(t):
        return syncmers.written(len(t), *next(iter(syncmers.anchors([t]))))
    assert sorted(got) == order
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        a, b, c = (syncmers.parsed(print_of(t)) for t in (text, edited, after))
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == print_of(text) and got[i]["edited_fingerprint"] == print_of(edited)
        assert got[i]["near_edited"] == syncmers.likeness(a, b) and got[i]["near_next"] == syncmers.likeness(a, c)


def test_op7_packing(spark, folder):
    encode = Tokenizer.from_file(WORDS).encode
    ids = {i: encode(t, add_special_tokens=False).ids + [1] for i, t in texts_of(folder, spark).items()}
    got = run("op7_packing", spark, folder)
    covered = collections.Counter()
    for r in got:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == crc_of(piece) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["offset"] + r["length"] <= 2048
        covered.update((r["doc_id"], j) for j in range(r["start"], r["start"] + r["length"]))
    assert set(covered.values()) == {1} and len(covered) == sum(map(len, ids.values()))


def test_op8_bpe(spark, folder):
    whole = Tokenizer.from_file(WORDS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run("op8_bpe", spark, folder)}
    want = {i: whole.encode(t, add_special_tokens=False).ids for i, t in texts_of(folder, spark).items()}
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(whole.decode(x, skip_special_tokens=False))) for i, x in want.items()}


def test_round_trip_equals_the_two_jobs(clashing):
    both = sorted((tuple(r.ids), r.decoded) for r in bpe.round_trip(clashing, WORDS, keep=("doc_id", "word")).collect())
    ids = bpe.encode(clashing, WORDS, keep=("doc_id",))
    assert both == sorted((tuple(r.ids), r.text) for r in bpe.decode(ids, WORDS, keep=("doc_id", "ids")).collect())
    assert bpe.round_trip(clashing.limit(0), WORDS).count() == 0


def test_op12_and_op13(spark, folder):
    texts = texts_of(folder, spark)
    assert found_variants(queries.QUERIES["op12_spelling_variants"](spark, folder)) == slow_variants(sorted(texts.items()))
    whole = Tokenizer.from_file(BYTES)
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run("op13_token_counts", spark, folder)} == {
        i: (len(t.encode()), want[i], want[i] > 512) for i, t in texts.items()}


def test_pipeline(spark, folder, rows, tmp_path):
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    encode = Tokenizer.from_file(WORDS).encode
    texts = texts_of(folder, spark)
    ids = {i: encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    # 2 repeats 1; 3, 4 and 5 have no letters
    assert {r["doc_id"] for r in got} == {0, 1, 6, 7, 8, 9, 10} & {r["doc_id"] for r in got} and {1, 6, 7, 10} <= {r["doc_id"] for r in got}
    assert all(np.frombuffer(r["ids"], "<u2").tolist() == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] for r in got)
    rows.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
