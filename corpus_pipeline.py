"""A corpus pipeline over documents; each stage applies one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of ``docs``; ``run`` writes each stage's result to the shared folder
and rereads it as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.llm import jaccard, langid, mixing, secrets, sp_codec
from stratavox.llm.common import materialise

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
#: A document whose language is less certain than this is rejected.
LEAST_CERTAIN = 0.5


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its further columns under private names, and those names by column."""
    names = {c: f"__d_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns]), names


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learnt language, told with certainty; those without text or letters go.

    The model learns from the rows of ``docs`` that name their language. Empty tables stay empty.
    """
    model = langid.fit(docs)
    hidden, names = _hidden(docs)
    kept = hidden.withColumn("__found", langid.predict(F.col("text"), model))
    kept = kept.filter((F.col("__found.lang_pred") != langid.UNDETERMINED) & (F.col("__found.score") >= LEAST_CERTAIN))
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, ids that are null last.

    Five-word shingles, similarity 0.8 or more. Rows are told apart by id and text, so texts under
    one id are documents of their own; of rows that repeat both, one stays. Documents without words
    are copies of nothing and stay, all of them.
    """
    own = F.xxhash64("doc_id", "text")
    rows = docs.select(own.alias("doc_id"), "text")
    linked = jaccard.link(rows, percent=80, width=5).select(F.col("doc_id").alias("__row"), "component_id", "n_shingles").distinct()
    named = docs.select("doc_id", own.alias("__row")).distinct().join(linked, "__row")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row", "n_shingles")).alias("__least")
    kept = named.groupBy("component_id").agg(least).select("__least.__row", "__least.n_shingles")
    hidden, names = _hidden(docs)
    found = hidden.withColumn("__row", own).join(kept.hint("shuffle_hash"), "__row")
    first = F.row_number().over(Window.partitionBy("__row").orderBy("doc_id"))
    found = found.withColumn("__first", first).filter("__first = 1 or n_shingles = 0")
    return found.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; n_chars follows the text.

    The spans are found and the text is rewritten by row, so nothing is joined. Null texts stay null.
    """
    hidden, names = _hidden(docs)
    masked = secrets.mask(hidden, F.col("text"), "__masked")
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("__masked")).alias("text")}
    if "n_chars" in docs.columns:
        own = F.col(names["n_chars"])
        changed["n_chars"] = F.when(F.col("text") != F.col("__masked"), F.length("__masked")).otherwise(own).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return masked.select(*[changed[c] if c in changed else F.col(names.get(c, c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, so that sources come near their targets."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (an end id last) of every row."""
    model = sp_codec.model_bytes(TOKENIZER)
    # The ids replace the text, so that it does not travel back.
    coded = sp_codec.encode(docs.select("doc_id", "text"), model, to="text").withColumnRenamed("text", "ids")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_languages),
    ("near_copies", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("encoding", encode),
]

#: No stage of this pipeline can be written as SQL in full; the tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
