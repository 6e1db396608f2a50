"""Token counts through a digest cache: what was ever counted with a vocabulary is not encoded again.

The cache is a Parquet table (digest, version, n_tokens). The digest is SHA-256 of the text with its runs of
blanks, tabs and line ends turned into one blank, which the vocabulary does itself, so counts are the same; the
version is the digest of the vocabulary file. Counting joins documents with the cache, encodes one text of each
missing digest and appends the new counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import tokens
from gleaner.llm.common import attach, in_batches

VOCABULARY = "word_bpe_49k.json"
CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"
CACHE_ROW = 120  # bytes of memory for a row of the cache in a broadcast


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\t\n\r ]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts of this version, one row per digest; empty where nothing was stored yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(name: str):
    def make():
        count = tokens.lower_counts(name)
        return lambda digests, texts: (digests, [count(t) for t in texts])

    return make


def add_missing(docs: DataFrame, cache_path: str, vocabulary: str = VOCABULARY) -> None:
    """Encode one text of every digest that the cache lacks, and append the counts.

    The append is one job: it adds all its rows or, if it fails, none; a repeated run encodes what is missing then.
    """
    spark, version = docs.sparkSession, tokens.version(vocabulary)
    texts = docs.select(digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("text"))
    cache = read_cache(spark, cache_path, version)
    misses = attach(texts, cache, cache.count() * CACHE_ROW, ["digest"], "left_anti")
    one = misses.groupBy("digest").agg(F.first("text").alias("text"))  # copies meet on the map side already
    made = in_batches(one, _counter(vocabulary), "digest binary, n_tokens bigint")
    made.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)


def token_counts(
    docs: DataFrame, cache_path: str, vocabulary: str = VOCABULARY, limit: int = 2048, id_col: str = "doc_id"
) -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    cache_path is a folder that all executors see. A null text counts as an empty one: no bytes, no tokens.
    Repeated rows and rows with null ids each get a row. Only id_col and text are read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    add_missing(docs, cache_path, vocabulary)
    cache = read_cache(docs.sparkSession, cache_path, tokens.version(vocabulary))
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), digest(F.col("text")).alias("digest"))
    counted = attach(rows, cache, cache.count() * CACHE_ROW, ["digest"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
