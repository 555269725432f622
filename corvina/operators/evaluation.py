"""Evaluation (E1-E8, E10, E12): metrics over the rank of the first relevant text of each query."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mrr(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1 / rank).otherwise(0.0)


def ndcg(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def first_relevant(ranking: DataFrame, qrels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, query_id, rank) for each query with relevance judgements and a ranking; rank is null where none was reached."""
    best = ranking.join(qrels, ["query_id", "doc_id"], "left_semi").groupBy(*by, "query_id").agg(F.min("rank").alias("rank"))
    asked = ranking.select(*by, "query_id").distinct().join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return asked.join(best, [*by, "query_id"], "left")


def evaluate(ranks: DataFrame, by: list[str] = [], k: int = 10) -> DataFrame:  # noqa: B006
    """E1-E6. (by, n_queries, mrr, ndcg, recall_1, recall_5, recall_k)."""
    r = F.coalesce(F.col("rank"), F.lit(1 << 30)).cast("double")
    aggs = [F.count("*").alias("n_queries"), F.avg(mrr(r, k)).alias("mrr"), F.avg(ndcg(r, k)).alias("ndcg"), F.avg(hit(r, 1)).alias("recall_1"), F.avg(hit(r, 5)).alias("recall_5"), F.avg(hit(r, k)).alias("recall_k")]
    return ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)


def compare(old: DataFrame, new: DataFrame, metrics: list[str]) -> DataFrame:
    """E12. (metric, old, new, delta, percent) of two one-row results; percent is null where old is 0."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select("x.*")
    j = long(old, "old").join(long(new, "new"), "metric")
    return j.withColumn("delta", F.col("new") - F.col("old")).withColumn("percent", F.when(F.col("old") != 0, (F.col("new") - F.col("old")) / F.nullif("old", F.lit(0.0)) * 100))


def rank_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """E8, N11. (query_id, doc_id, old_rank, new_rank, delta, kind): new, gone, changed by 2 or more, or steady."""
    j = a.select("query_id", "doc_id", F.col("rank").alias("old_rank")).join(b.select("query_id", "doc_id", F.col("rank").alias("new_rank")), ["query_id", "doc_id"], "full_outer")
    d = F.col("old_rank") - F.col("new_rank")
    kind = F.when(F.col("old_rank").isNull(), "new").when(F.col("new_rank").isNull(), "gone").when(F.abs(d) >= 2, "changed").otherwise("steady")
    return j.withColumn("delta", d).withColumn("kind", kind)


def latency(run, queries: list, warmup: int = 5) -> dict[str, float]:
    """E10. Percentiles of the time of run(query), in ms, and queries a second; the first queries run once more to warm up."""
    import numpy as np

    for q in queries[:warmup]:
        run(q)
    took = []
    for q in queries:
        at = time.perf_counter()
        run(q)
        took.append((time.perf_counter() - at) * 1000)
    if not took:
        return {"n": 0, "p50": 0.0, "p95": 0.0, "p99": 0.0, "qps": 0.0}
    p = np.percentile(took, [50, 95, 99])
    return {"n": len(took), "p50": float(p[0]), "p95": float(p[1]), "p99": float(p[2]), "qps": 1000 * len(took) / sum(took)}


def plan_size(df: DataFrame) -> int:
    """E11. Spark's estimate of a result's bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def guard_split(path: str, split: str) -> None:
    """E14. Refuse to evaluate on a test split."""
    if "test" in split.lower() or "test" in path.lower().rsplit("/", 1)[-1]:
        raise ValueError("the test split is not for validation")
