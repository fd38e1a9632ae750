"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_or_empty

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's version: its file and the library that reads it."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version(library)}\n".encode() + f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of the normalised content.

    Normalisation must not change a count. Null reads as empty; anything further (case, white
    space) would change what some tokenizer sees, so the rest of the text stands as it is.
    """
    return F.unhex(F.sha2(text, 256))


def _counter(data: bytes, library: str):
    """A function from texts to their numbers of tokens, without special tokens around them."""
    if library == "tokenizers":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(data)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


def count_column(text: Column, path: str, chars_a_call: int = 2_000_000) -> Column:
    """Tokens of each text, by the library; the tokenizer file goes along with the function."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        data = f.read()

    @F.pandas_udf(T.LongType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(data, library)
        for batch in batches:
            out, group, size = [], [], 0
            for text in batch:
                group.append(text)
                size += len(text)
                if size >= chars_a_call:
                    out += count(group)
                    group, size = [], 0
            yield pd.Series(out + (count(group) if group else []), dtype="int64")

    return counts(text)


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; none where there is no cache yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs may have appended the same digest; their counts are equal.
    return cache.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens; each distinct new text is encoded once and cached.

    Digests of content and tokenizer version are joined to the cache at ``cache_path`` (a shared
    folder). Of the digests that it lacks, one document each is picked by its id; only those texts
    are shuffled and encoded, and their counts appended. Counts then go back to all documents by
    digest. A third of all rows may share one digest: picking is a map-side aggregate, and the
    join back is a plain equi-join of two tables, whose large partitions Spark splits. Null texts
    count as empty ones; null ids and repeated rows keep their rows; an empty table gives none;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key")
    text = text_or_empty()
    keyed = materialise(docs.select("doc_id", key, content_digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    misses = keyed.groupBy("digest").agg(F.min("key").alias("key")).join(read_cache(spark, cache_path, tokenizer), "digest", "left_anti")
    # Id and digest together: rows of one id, or of none, meet only the miss of their own text.
    texts = docs.select(key, text.alias("text"), content_digest(text).alias("digest")).join(misses.hint("shuffle_hash"), ["key", "digest"])
    fresh = texts.select("digest", F.lit(tokenizer).alias("tokenizer"), count_column(F.col("text"), tokenizer_path).alias("n_tokens"))
    # Repeated rows of one id and text have passed the join; the cache gets one row.
    fresh = fresh.groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.write.mode("append").parquet(cache_path)
    counts = materialise(read_cache(spark, cache_path, tokenizer), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def count_in_batches(docs: DataFrame, tokenizer_path: str, cache_path: str, batches: int = 2) -> DataFrame:
    """``count_tokens`` over ``docs`` in batches, one after the other over one cache, as a growing corpus is counted.

    Documents are dealt to batches by the hash of their ids, null ids to one of them; a copy in a
    later batch finds the count that an earlier one has stored. Every row is in one batch.
    """
    batch = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(batches))
    counted = [materialise(count_tokens(docs.filter(batch == k), tokenizer_path, cache_path), "batch") for k in range(batches)]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out
