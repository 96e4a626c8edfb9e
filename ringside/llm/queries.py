"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ringside.llm import bpe, collocations, exact_dedup, langid, lm, minhash, neighbours, packing, ring, spelling, syncmers, token_counts, token_files, warc
from ringside.llm.common import crc_mod, mapped, store, table

QUERIES, ORACLES = {}, {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = store(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", exact_dedup.digest(docs.text).alias("digest")), "exact")
    found = exact_dedup.assign(rows, exact_dedup.lower_half(rows))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op1_exact_dedup"] = r"""
    WITH digests AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, text_sha256
    FROM digests WINDOW same AS (PARTITION BY text_sha256)"""


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.read(*token_files.write(table(spark, sf_dir, "documents"), VOCABULARY, end=1))
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, end = public_tokenizers.path("byte_bpe_50k.json"), 50256
    rows = lm.encoded(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1, path, end)
    return lm.scored(rows, *lm.learn(rows, path, end)).select(F.col("key").alias("doc_id"), (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, seen=crc_mod("doc_id", 3) != 1)
    return langid.predict(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def _with_crc(rows: DataFrame, width: int) -> DataFrame:
    """`ids` of `width` bytes each replaced by the crc32 of the same ids in four bytes."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches):
        for batch in batches:
            crcs = [zlib.crc32(np.frombuffer(x.as_py(), f"<u{width}").astype("<u4").tobytes()) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crcs, pa.int64())], names=[*kept, "ids_crc32"])

    return mapped(rows.select(*kept, "ids"), run, rows.select(*kept).schema.add("ids_crc32", "long"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), VOCABULARY, end=1, remembered=packing.subwords.REMEMBERED, most=token_files.BLOCK)
    return _with_crc(pieces, packing.subwords.id_width(VOCABULARY)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(decimal, "utf-8"), 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read(*warc.write(table(spark, sf_dir, "pages")))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, strlen(html) AS payload_bytes FROM payloads)
    SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM firsts"""


@query
def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return ring.assign(rows, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(keys, bodies, following):
        texts = [t.decode("utf-8", "replace") for t in bodies]
        nexts = [n.decode("utf-8", "replace") for n in following]
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, nexts)]
        # what follows a text is mostly the block's next text, so its anchors are there already
        shared = [i + 1 < len(texts) and following[i] == bodies[i + 1] for i in range(len(texts))]
        more = [n for n, s in zip(nexts, shared) if not s]
        every = [*texts, *edited, *more]
        found = [(len(t), *a) for t, a in zip(every, syncmers.anchors(every))]
        own, changed, rest = found[:len(texts)], found[len(texts):2 * len(texts)], iter(found[2 * len(texts):])
        after = [own[i + 1] if s else next(rest) for i, s in enumerate(shared)]
        alike = lambda pairs: pa.array([syncmers.alike(*a, *b) for a, b in pairs], pa.float64())
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
            pa.array([syncmers.written(*x) for x in own]), pa.array([syncmers.written(*x) for x in changed]),
            alike(zip(own, changed)), alike(zip(own, after))], names=names)

    return neighbours.with_next(table(spark, sf_dir, "documents"), run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
    WITH pieces AS (SELECT lang, trim(piece, e' \t') AS piece FROM (SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    words AS (SELECT lang, string_split_regex(piece, '[\x20\x09]+') AS w FROM pieces WHERE piece <> ''),
    placed AS (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM words, range(1, 4) AS sizes(s)),
    f AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*) AS n FROM placed GROUP BY ALL HAVING n >= 10),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    cuts AS (SELECT lang, s, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, s)) AS k FROM f WHERE s >= 2),
    scores AS (SELECT c.lang, c.s, c.phrase, c.a, c.k, h.n AS l, t.n AS r, (1000000::HUGEINT * c.a * c.a) // (h.n::HUGEINT * t.n) AS score FROM cuts c
      JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:], ' ')),
    least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, phrase, max(n) AS n FROM (SELECT lang, n, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase FROM f, (VALUES (1), (2)) v(i) WHERE s = 3) GROUP BY ALL),
    kept AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE longer.n IS NULL OR 100 * longer.n < 50 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, totals.n, score::BIGINT AS score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
