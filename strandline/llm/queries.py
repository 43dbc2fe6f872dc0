"""The registered query of each operator, and SQL that DuckDB can run for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import alignment, bpe, decontaminate, hmm, hnsw, htmltree, jaccard, langid, licenses, linechunks, packing, vocabularies, warc, whitening
from strandline.llm.work import small_batches

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int):
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string")) % n


# --- 1: decontamination


@query
def op1_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


# --- 2: main text of pages


@query
def op2_site_style_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltree.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# --- 3: license scans


@query
def op3_license_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


# --- 4: repeated chunks of lines


@query
def op4_content_defined_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL["op4_content_defined_line_chunks"] = linechunks.SQL.format(docs="documents")


# --- 5: near duplicates by n-gram overlap


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


# --- 6: near-duplicate vectors


@query
def op6_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


# --- 7: hidden Markov language model


@query
def op7_hidden_markov_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold("doc_id", 7) != 2, F.lit(True)).alias("train"))
    return hmm.score_documents(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 8: content-addressed archive


@query
def op8_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    return archived(spark, path)


def archived(spark: SparkSession, path: str) -> DataFrame:
    """What an archive's records are, from the payloads and records read back."""
    read = warc.read(spark, path)
    kind = read.schema["key"].dataType
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").try_cast(kind).alias("refers_to"))


_SQL["op8_content_addressed_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, sha256(payload) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s, h, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


# --- 9: byte-pair encoding


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id with the digests of its token ids and of the text decoded from them."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    vocabulary = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary_bytes(path))
    small_batches(docs.sparkSession)
    both = bpe.round_trip(docs.select("doc_id", "text"), vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


# --- 10: language identification


@query
def op10_bidirectional_gru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    net = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


# --- 11: packing along a curve


def vocabulary(spark: SparkSession, name: str):
    """A broadcast of the bytes of one of the public vocabulary files."""
    return spark.sparkContext.broadcast(vocabularies.content(public_tokenizers.path(name)))


@query
def op11_hilbert_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(spark, "byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# --- 12: alignment of two tokenizers


@query
def op12_token_end_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vocabulary(spark, "byte_bpe_50k.json"), vocabulary(spark, "piece_bpe_32k.model")
    return alignment.report(table(spark, sf_dir, "documents"), a, b)


# --- 13: whitened vectors


@query
def op13_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("z", "explained")).alias("i", "c")
    rows = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("c.z").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
