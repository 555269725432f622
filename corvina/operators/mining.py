"""Training pairs and hard negatives of the retrieval project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_corpus(pairs: DataFrame) -> DataFrame:
    """M1. (doc_id, text): of each non-blank corpus_id the code of its smallest pair_id; a null code is ''."""
    p = pairs.filter("trim(corpus_id) <> ''")
    return p.groupBy(F.col("corpus_id").alias("doc_id")).agg(F.min_by(F.coalesce("code", F.lit("")), "pair_id").alias("text"))


def qrels(pairs: DataFrame) -> DataFrame:
    """M6. Distinct (query_id, doc_id) of rows with both ids."""
    return pairs.filter("trim(query_id) <> '' AND trim(corpus_id) <> ''").select("query_id", F.col("corpus_id").alias("doc_id")).distinct()


def pair_texts(rel: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """S2. Judgements (query_id, doc_id, score) with their texts: missing text '', missing score 1."""
    j = rel.join(queries, "query_id", "left").join(corpus, "doc_id", "left")
    return j.select("query_id", "doc_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("code"), F.coalesce("score", F.lit(1)).alias("score"))


def hash_split(key: Column, parts: int = 10, seed: str = "42") -> Column:
    """S3. train or valid (one part in ``parts``) by a hash of the key: the same on every run and every partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.when(h % parts == 0, "valid").otherwise("train")


def ingest(docs: DataFrame) -> DataFrame:
    """S9. (doc_id, text) of (doc_id, title, text, body): body if text is empty, the title on a line before it; an id given twice
    is an error when the rows are read."""
    body = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("body"), F.lit(""))
    text = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat_ws("\n", "title", body)).otherwise(body)
    g = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text).alias("text"))
    return g.select("doc_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col("doc_id").cast("string"))).cast("string")).otherwise(F.col("text")).alias("text"))


def hard_negatives(ranking: DataFrame, positives: DataFrame, corpus: DataFrame, n: int = 1, depth: int = 50, fallback: bool = True) -> DataFrame:
    """M2, M3. (query_id, doc_id, place): of each query's first ``depth`` candidates the first n that are neither a positive nor
    the same text, trimmed, as one. positives is (query_id, doc_id); a query without positives is asked for all the same.

    With fallback a query of positives or ranking whose candidates are all excluded gets one other document: the first in order of
    id that is none of its positives, if the corpus has any."""
    text = corpus.select("doc_id", F.md5(F.trim("text")).alias("h"))
    pos = positives.join(text, "doc_id", "left").select("query_id", F.col("doc_id").alias("p"), "h")
    c = ranking.filter(F.col("rank") <= depth).join(text, "doc_id", "left")
    c = c.join(pos.select("query_id", F.col("p").alias("doc_id")), ["query_id", "doc_id"], "left_anti").join(pos.select("query_id", "h"), ["query_id", "h"], "left_anti")
    c = c.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    got = c.filter(F.col("place") <= n).select("query_id", "doc_id", "place")
    if not fallback:
        return got
    most = positives.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    first = corpus.select("doc_id").distinct().orderBy("doc_id").limit(most + 1).agg(F.array_sort(F.collect_list("doc_id")).alias("first"))  # one row, one id more than any query has positives
    asked = positives.select("query_id").unionByName(ranking.select("query_id")).distinct().join(got.select("query_id").distinct(), "query_id", "left_anti")
    own = positives.groupBy("query_id").agg(F.collect_set("doc_id").alias("own"))
    spare = asked.join(own, "query_id", "left").crossJoin(F.broadcast(first))
    spare = spare.select("query_id", F.get(F.array_except("first", F.coalesce("own", F.array().cast(dict(own.dtypes)["own"]))), F.lit(0)).alias("doc_id"), F.lit(1).alias("place"))
    return got.unionByName(spare.filter("doc_id IS NOT NULL"))
