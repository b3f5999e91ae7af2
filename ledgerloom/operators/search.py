"""Search of many queries at once by an inverted index.

A query's word has no blank, so a text holds it just if one of its blank-separated tokens does. Two tables say where:
`postings` (token, chunk_id, created_at) and `grams` (gram, token), each distinct token by its runs of three letters. A word
is looked up by its rarest gram, compared with the tokens of that gram alone, and never with texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The least length of a word, the words of a query, the chunks of an answer.
LEAST, WORDS, KEPT = 4, 6, 50
BLANK = r"[\x09-\x0D ]+"


def long_tokens(text: Column) -> Column:
    """The distinct tokens of LEAST letters or more, lower-cased, in order; a null text has none."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK)), lambda w: F.char_length(w) >= LEAST)


def grams_of(word: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(word, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def search_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings and grams of chunks (chunk_id, title, content, chunk_type, created_at)."""
    text = F.concat_ws("\n", "title", "content", "chunk_type")
    postings = chunks.select(F.explode(long_tokens(text)).alias("token"), "chunk_id", "created_at")
    grams = postings.select("token").distinct().select(F.explode(grams_of(F.col("token"))).alias("gram"), "token")
    return postings, grams


def write_search_index(chunks: DataFrame, path: str) -> None:
    """Both tables under path, sorted by their keys, so that a look-up reads the row groups of its keys; a second call replaces them."""
    postings, _ = search_index(chunks)
    postings.repartitionByRange("token", "chunk_id").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.parquet(f"{path}/postings").select("token").distinct()
    grams = stored.select(F.explode(grams_of(F.col("token"))).alias("gram"), "token")
    grams.repartitionByRange("gram", "token").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def read_search_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/grams")


def search_many(queries: DataFrame, index: tuple[DataFrame, DataFrame], k: int = KEPT) -> DataFrame:
    """P23, L5 for all queries (query_id, query): query_id, chunk_id, rank of the k newest chunks with any of the query's words.

    The k newest chunks of a query are among the k newest of its words, so common tokens are cut to k
    before they meet words, and common words before they meet queries. Queries without a long word, and words that no chunk holds, find nothing. Equal times rank by the larger chunk_id.
    """
    postings, grams = index
    asked = queries.select("query_id", F.explode(F.slice(long_tokens(F.col("query")), 1, WORDS)).alias("word"))
    words = asked.select("word").distinct()
    parts = words.select("word", F.explode(grams_of(F.col("word"))).alias("gram"))
    sizes = grams.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(sizes, "gram").groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    held = grams.join(rarest, "gram").where(F.col("token").contains(F.col("word"))).select("word", "token")
    newest = [F.desc("created_at"), F.desc("chunk_id")]
    # what is new among a word's chunks is new among some token's, so tokens are cut before they meet words; equal postings share a rank
    kept = postings.join(held.select("token").distinct(), "token", "left_semi").withColumn("rank", F.dense_rank().over(W.partitionBy("token").orderBy(*newest))).where(F.col("rank") <= k).drop("rank")
    found = kept.join(held, "token").select("word", "chunk_id", "created_at").distinct()
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("word").orderBy(*newest))).where(F.col("rank") <= k).drop("rank")
    answers = asked.join(best, "word").select("query_id", "chunk_id", "created_at").distinct()
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*newest)))
    return ranked.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")
