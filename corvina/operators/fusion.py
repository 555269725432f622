"""Fusion and normalisation of rankings (F1-F9). Rankings are (query_id, source, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(r: DataFrame) -> DataFrame:
    """A ranking's first occurrence of each text; ranks keep counting the others."""
    return r.groupBy("query_id", "source", "doc_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for s, w in weights.items():
        out = F.when(F.col("source") == s, float(w)).otherwise(out)
    return out


def _fuse(r: DataFrame, part: Column, limit: int | None) -> DataFrame:
    s = first_seen(r).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"), F.min("rank").alias("best"))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "best", "doc_id")))
    return s.filter(F.col("rank") <= limit) if limit else s


def rrf(r: DataFrame, weights: dict[str, float], rrf_k: int = 60, limit: int | None = None) -> DataFrame:
    """F1. Weighted reciprocal ranks."""
    return _fuse(r, _weight(weights) / (F.col("rank") + rrf_k), limit)


def linear_decay(r: DataFrame, weights: dict[str, float], decay: float = 0.05, limit: int | None = None) -> DataFrame:
    """F3. Weights that fall linearly with rank, not below 0."""
    return _fuse(r, _weight(weights) * F.greatest(F.lit(0.0), 1 - decay * (F.col("rank") - 1)), limit)


def min_max(c: str, by: list[str]) -> Column:
    """F4. To [0, 1] within each group; a constant group gives 1."""
    w = W.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi - lo < 1e-12, 1.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))


def z_score(c: str, by: list[str]) -> Column:
    """F5. By the population deviation; a constant group gives 0."""
    w = W.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return F.when(sd < 1e-12, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / F.nullif(sd, F.lit(0.0)))


def sigmoid(z: Column, temperature: float = 1.0) -> Column:
    """F6."""
    return 1 / (1 + F.exp(-z / max(temperature, 1e-4)))


def convex(r: DataFrame, first: str, second: str, alpha: float = 0.85, limit: int | None = None) -> DataFrame:
    """F2. alpha times the first source's normalised score plus the rest of the second's; absent is 0."""
    n = first_seen(r.filter(F.col("source").isin(first, second))).withColumn("s", min_max("score", ["query_id", "source"]))
    part = F.when(F.col("source") == first, alpha).otherwise(1 - alpha) * F.col("s")
    s = n.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")))
    return s.filter(F.col("rank") <= limit) if limit else s


def provenance(fused: DataFrame, r: DataFrame) -> DataFrame:
    """F7. Fused rows with dense_score, sparse_score and the sources that found them."""
    f = first_seen(r)
    p = f.groupBy("query_id", "doc_id").agg(F.max(F.when(F.col("source") == "dense", F.col("score"))).alias("dense_score"), F.max(F.when(F.col("source") == "sparse", F.col("score"))).alias("sparse_score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return fused.join(p, ["query_id", "doc_id"])


def restrict(r: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """F8. Only allowed (query_id, doc_id), after ranking, then the first k."""
    s = r.join(allowed, ["query_id", "doc_id"], "left_semi")
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


def dense_gate(fused: DataFrame, least: float = 0.2) -> DataFrame:
    """F9. Fused rows whose dense score is there and at least ``least``; ranks stay, so the gate comes after the cut to k."""
    return fused.filter(F.col("dense_score").isNotNull() & ~F.isnan("dense_score") & (F.col("dense_score") >= least))
