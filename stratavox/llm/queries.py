"""The queries that apply each operator of this subpackage to the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard, langid, lm, merkle, mixing, quality_model, quality_rules, secrets, sp_codec, sql, token_counts, toxicity, vector_codes
from .common import documents, id_remainder, labels, shared_path

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    digest = F.sha2(secrets.span_text(F.col("base_spans")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marks = labels(spark, sf_dir).select("doc_id", "quality").filter(id_remainder(3) != 1)
    scored = quality_model.classify(docs, marks)
    return scored.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(documents(spark, sf_dir))
    return pairs.withColumns({c: fingerprints.fingerprint_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(labels(spark, sf_dir))
    return quality_rules.apply_rules(documents(spark, sf_dir), trusted)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_in_batches(documents(spark, sf_dir), TOKENIZER, shared_path(spark, "token_cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sp_codec.model_bytes(TOKENIZER)
    docs = sp_codec.encode(documents(spark, sf_dir).select("doc_id", "text"), model).select("doc_id", "ids")
    docs = sp_codec.decode(docs, model)
    ids_text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = lm.score_marked(docs, learnt=F.coalesce(id_remainder(7) != 2, F.lit(False)), asked=F.lit(True))
    return scored.withColumn("held_out", id_remainder(7) == 2)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir), percent=90, width=3)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_remainder(5) == 0
    model = langid.fit(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predict(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = labels(spark, sf_dir).select("doc_id", "toxic").filter(id_remainder(4) != 2)
    scored = toxicity.classify(documents(spark, sf_dir), marks)
    return scored.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", "predicted", "restored")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), tampered=id_remainder(3) == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_lm_scores": op7_lm_scores,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_source_mixing": op10_source_mixing,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op12_merkle_manifest": sql.manifest_sql(),
    "op13_vector_codes": sql.vector_codes_sql(),
}
