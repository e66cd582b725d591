"""One query ``opN_<name>`` for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, byte_bpe, chat_format, decontam, exact_dedup, filter_audit, html_extract, lm_score, merkle, near_dedup, quality, sql, token_file, toxicity
from framewright.llm.labelled import split_remainder
from framewright.llm.lineage import checkpoint_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Digest columns of ``bpe.round_trip``'s ids and texts."""
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_documents(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _predictions(scored: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    """A null doc_id is neither held out nor learned from; a score at the threshold is predicted 1."""
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = _documents(spark, sf_dir), split_remainder(F.col("doc_id"), 5)
    model = quality.train(docs, _labels(spark, sf_dir), remainder != 0)
    return _predictions(quality.score(docs, model, keep=["doc_id"]), remainder == 0, 0.3)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = _documents(spark, sf_dir), split_remainder(F.col("doc_id"), 3)
    model = toxicity.train(docs, _labels(spark, sf_dir), remainder != 1)
    return _predictions(toxicity.score(docs, model, keep=["doc_id"]), remainder == 1, 0.7)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), size=2, percent=80)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(_documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/framewright-token-ids-{uuid.uuid4().hex}"
    coded = token_file.encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    token_file.write(coded, path)
    return token_file.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = _documents(spark, sf_dir), split_remainder(F.col("doc_id"), 10)
    model = lm_score.train(docs.filter(F.coalesce(remainder != 0, F.lit(True))))
    scored = lm_score.score(docs, model, keep=["doc_id"])
    held_out = F.coalesce(remainder == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.matches(_documents(spark, sf_dir), items)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    texts = html_extract.extract(pages, keep=["page_id", "url"])
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, _labels(spark, sf_dir))


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    """Digest columns of ``byte_bpe.round_trip``'s ids and bytes."""
    coded = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id"])
    return coded.select("doc_id", byte_bpe.count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(_documents(spark, sf_dir))


#: Columns of ``documents`` that its manifest vouches for.
VOUCHED = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_manifest(docs: DataFrame) -> merkle.Manifest:
    """The manifest of documents, with a tampered text as the candidate of each row that 5 divides the checksum of."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.build(docs, VOUCHED, candidate={"text": lower}, candidate_where=split_remainder(F.col("doc_id"), 5) == 0, keep=["doc_id"])


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = tampered_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*VOUCHED)).proofs()
    proof = F.sha2("proof", 256).alias("proof_sha256")
    return proofs.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_token_file": op7_token_file,
    "op8_lm_score": op8_lm_score,
    "op9_decontam": op9_decontam,
    "op10_html_extract": op10_html_extract,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle": op13_merkle,
}

_LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op9_decontam": f"""
        WITH dw AS (SELECT id, {_WORDS} AS w FROM (SELECT doc_id AS id, {_LOWER_ASCII} AS t FROM documents)),
             bw AS (SELECT id, w, least(len(w), 5) AS k FROM (SELECT id, {_WORDS} AS w FROM (SELECT item_id AS id, {_LOWER_ASCII} AS t FROM benchmark))),
             b AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM bw WHERE k > 0),
             n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
             d AS (SELECT DISTINCT id, s.k AS k, unnest(list_transform(range(1, len(w) - s.k + 2), lambda i: array_to_string(w[i:i + s.k - 1], ' '))) AS g
                   FROM dw, (SELECT DISTINCT k FROM b) AS s WHERE len(w) >= s.k)
        SELECT d.id AS doc_id, b.id AS item_id, any_value(n_item)::INT AS n_item, count(*) AS n_shared
        FROM d JOIN b USING (k, g) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) * 100 >= any_value(n_item) * 80""",
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({_LOWER_ASCII}) AS text_sha256 FROM documents),
             g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_filter_audit": sql.FILTER_AUDIT,
    "op13_merkle": sql.merkle(),
}
