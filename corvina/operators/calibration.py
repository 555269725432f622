"""Routing, reranking, calibration and confidence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvina.runtime import Scratch


#: R1. The scores of a candidate in the order in which they count.
SCORE_ORDER = ("dense_score", "fusion_score", "score", "sim")


def margins(r: DataFrame) -> DataFrame:
    """R1. (query_id, n, margin): gap between the first two candidates, at least 0; infinite for fewer than two.

    Of the columns of SCORE_ORDER that r has, a candidate's first one that is not null is its score; without any it is 0."""
    s = F.coalesce(*(F.col(c).cast("double") for c in SCORE_ORDER if c in r.columns), F.lit(0.0))
    g = r.filter("rank <= 2").select("query_id", "rank", s.alias("s")).groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("s"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("s"))).alias("s2"))
    return g.select("query_id", "n", F.when(F.col("n") < 2, float("inf")).otherwise(F.greatest(F.lit(0.0), F.col("s1") - F.col("s2"))).alias("margin"))


def route(r: DataFrame, tau: float = 0.05) -> DataFrame:
    """R1. Margins with decision fast_path (margin >= tau) or escalated."""
    return margins(r).withColumn("decision", F.when(F.col("margin") >= tau, "fast_path").otherwise("escalated"))


Scorer = Callable[[DataFrame], DataFrame]


def rerank(r: DataFrame, scorer: Column | Scorer, top: int = 20) -> DataFrame:
    """R2. The first ``top`` candidates by scorer (ties by prior rank), the others behind them as they were, unscored.

    scorer is a column, or a function that adds a column rerank_score to the rows it is given: only the first ``top`` of each
    list, so that texts are fetched and scored for no others."""
    head = r.filter(F.col("rank") <= top)
    head = head.withColumn("rerank_score", scorer) if isinstance(scorer, Column) else scorer(head)
    s = head.unionByName(r.filter((F.col("rank") > top) | F.col("rank").isNull()).withColumn("rerank_score", F.lit(None).cast("double")))
    order = [F.when(F.col("rank") <= top, 0).otherwise(1), F.desc_nulls_last(F.round("rerank_score", 9)), F.col("rank")]
    return s.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def cascade(r: DataFrame, scorer: Column | Scorer, tau: float = 0.05, top: int = 20) -> DataFrame:
    """R1. r with margin, decision, rerank_score and new_rank: lists of sure margin stay as they are, the others are reranked.

    Lists are parted before the scorer, which sees rows of escalated lists alone. r is read three times: pass a table."""
    j = r.join(route(r, tau).select("query_id", "margin", "decision"), "query_id")
    fast = j.filter("decision = 'fast_path'").withColumn("rerank_score", F.lit(None).cast("double")).withColumn("new_rank", F.col("rank").cast("int"))
    return rerank(j.filter("decision = 'escalated'"), scorer, top).unionByName(fast)


def score_pairs(pairs: DataFrame, scorer, batch: int = 16) -> DataFrame:
    """R3. (query, text) rows scored by a callable on batches: list of pairs -> list of floats, as a column rerank_score."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        both = list(zip(q, t))
        return pd.Series([float(x) for at in range(0, len(both), batch) for x in scorer(both[at : at + batch])])

    return pairs.withColumn("rerank_score", run("query", "text"))


def with_cache(pairs: DataFrame, cache: DataFrame, scorer, scratch: Scratch, batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """R4. (pairs (query, doc_id, text) with rerank_score, cache afterwards): scores come from cache (query, doc_id,
    rerank_score) where it has them; only other pairs go to the scorer, each once, and their scores join the cache.

    New scores are written before they are used, so that no pair is scored again by a later reader."""
    asked = pairs.select("query", "doc_id", "text").dropDuplicates(["query", "doc_id"])
    fresh = scratch.keep(score_pairs(asked.join(cache, ["query", "doc_id"], "left_anti"), scorer, batch).select("query", "doc_id", "rerank_score"))
    known = cache.select("query", "doc_id", "rerank_score").unionByName(fresh)
    return pairs.join(known, ["query", "doc_id"]), known


def truncate_pair(query: Column, text: Column) -> Column:
    """T19. Without a tokenizer: pairs of up to 1000 characters pass, of longer ones the text keeps 1500."""
    n = F.coalesce(F.char_length(query), F.lit(0)) + F.char_length(text)
    return F.when(n <= 1000, text).otherwise(F.substring(text, 1, 1500))


def truncate_pair_tokens(query: Column | str, text: Column | str, load: Callable[[], object], max_length: int) -> Column:
    """T19. With a tokenizer: of pairs above 1000 characters the text keeps the tokens that max_length leaves beside the query and
    three marks, at least one character. load() gives an object with encode(text) -> ids and decode(ids) -> text, once per worker."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokenizer = load()

        def cut(q: str | None, t: str | None) -> str | None:
            if t is None or len(q or "") + len(t) <= 1000:
                return t
            room = max_length - len(tokenizer.encode(q or "")) - 3
            if room <= 0:
                return t[:1]
            ids = tokenizer.encode(t)
            return t if len(ids) <= room else tokenizer.decode(ids[:room]) or t[:1]

        for q, t in parts:
            yield pd.Series([cut(x, y) for x, y in zip(q, t)], dtype="object")

    return run(query, text)


def overlap_score(q_tokens: Column, d_tokens: Column) -> Column:
    """A deterministic scorer: part of the query's distinct terms that the text has."""
    q = F.array_distinct(q_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d_tokens)) / F.size(q)).otherwise(0.0)


def abstention(r: DataFrame, top: int = 20, threshold: float = 0.35) -> DataFrame:
    """C1. (query_id, n, variance, should_abstain): variance of the softmax over its greatest possible value; below the
    threshold, or with fewer than two scores, abstain."""
    s = r.filter(f"rank <= {top} AND score IS NOT NULL")
    e = s.withColumn("e", F.exp(F.col("score") - F.max("score").over(W.partitionBy("query_id"))))
    g = e.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("e").alias("t"), F.sum(F.col("e") * F.col("e")).alias("t2"))
    p2, n = F.col("t2") / (F.col("t") * F.col("t")), F.col("n")
    v = F.when(n < 2, 0.0).otherwise(((p2 / n) - 1 / (n * n)) / F.nullif((n - 1) / (n * n), F.lit(0.0)))
    return g.select("query_id", "n", v.alias("variance")).withColumn("should_abstain", (n < 2) | (F.round("variance", 12) < threshold))


def temperature_softmax(r: DataFrame, temperature: float = 1.0) -> DataFrame:
    """C2. p per candidate within its query."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    w = W.partitionBy("query_id")
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    return r.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def bins(p: Column, n: int = 10) -> Column:
    """C3, C8. Number (from 0) of the equal-width bin of a value within [0, 1]; edges are i / n, the last bin is closed."""
    out = F.lit(n - 1)
    for i in range(n - 1, 0, -1):
        out = F.when(p < i / n, i - 1).otherwise(out)
    return out


def ece(df: DataFrame, n: int = 10) -> DataFrame:
    """C3. One row (ece) from (p, y)."""
    g = df.filter("p IS NOT NULL AND y IS NOT NULL").groupBy(bins(F.col("p"), n).alias("bin")).agg(F.count("*").alias("c"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    return g.agg(F.coalesce(F.sum(F.col("c") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("c"), F.lit(0.0)).alias("ece"))


def loss(df: DataFrame, grid: list[float]) -> DataFrame:
    """C4. (temperature, loss): mean cross-entropy of sigmoid(z / T) against y for all temperatures in one pass."""
    def bce(t: float) -> Column:
        p = F.least(F.greatest(1 / (1 + F.exp(-F.greatest(F.least(F.col("z") / t, F.lit(50.0)), F.lit(-50.0)))), F.lit(1e-12)), F.lit(1 - 1e-12))
        return F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)))

    one = df.agg(*[bce(t).alias(f"l{i}") for i, t in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(grid)])).alias("x")).select("x.*")


def fit_temperature(df: DataFrame, rounds: int = 5) -> float:
    """C4. The temperature within [0.05, 10] of least cross-entropy, by grids that narrow (one aggregate row each)."""
    lo, hi = 0.05, 10.0
    for _ in range(rounds):
        grid = [lo * (hi / lo) ** (i / 16) for i in range(17)]
        rows = sorted(loss(df, grid).collect(), key=lambda r: (r["loss"], r["temperature"]))
        at = grid.index(rows[0]["temperature"])
        lo, hi = grid[max(0, at - 1)], grid[min(16, at + 1)]
    return math.sqrt(lo * hi)


def fit_platt(df: DataFrame):
    """C5. Logistic regression of y on score without penalty; (slope, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    m = LogisticRegression(regParam=0.0, maxIter=100, featuresCol="f", labelCol="y").fit(df.select(array_to_vector(F.array(F.col("score").cast("double"))).alias("f"), F.col("y").cast("double").alias("y")))
    return float(m.coefficients[0]), float(m.intercept)


def predict_platt(score: Column, slope: float, intercept: float) -> Column:
    z = F.greatest(F.least(score * slope + intercept, F.lit(50.0)), F.lit(-50.0))
    return 1 / (1 + F.exp(-z))


def fit_isotonic(df: DataFrame, score: str = "score", label: str = "y"):
    """C6. A fitted isotonic model; ``transform`` gives column prediction, to be clamped to [0, 1]."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    rows = df.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression().fit(rows)


def bootstrap(df: DataFrame, values: list[str], key: str, by: list[str] = [], rounds: int = 1000, level: float = 0.95) -> DataFrame:  # noqa: B006
    """C7, E9. (by, metric, n, mean, low, high, std): percentile interval of the mean of each column of ``values``.

    Each row enters each of the rounds with a Poisson(1) count drawn from a hash of key and round, so that rounds need no rows to
    be gathered or drawn by position: one pass, in which the rounds' sums are combined map-side. key must be unique, else rows are
    drawn together. Sums are decimals of 9 places: the same in whatever order they are added. Null and NaN values do not count."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    edges, cum = [], 0.0
    for n in range(8):
        cum += math.exp(-1) / math.factorial(n)
        edges.append(cum)
    count = F.lit(8)
    for n in range(7, -1, -1):  # the count is the number of cumulative probabilities that u has reached
        count = F.when(F.col("u") < edges[n], n).otherwise(count)
    exact = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).cast("decimal(28,9)")
    rows = df.select(*by, key, F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), exact(v).alias("x")) for v in values))).alias("s")).select(*by, key, "s.*").filter("x IS NOT NULL")
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", u).withColumn("c", count).filter("c > 0")
    means = drawn.groupBy(*by, "metric", "b").agg((F.sum(F.col("x") * F.col("c")).cast("double") / F.sum("c")).alias("m"))
    a = (1 - level) / 2
    ci = means.groupBy(*by, "metric").agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"), F.stddev_samp("m").alias("std"))
    point = rows.groupBy(*by, "metric").agg(F.count("*").alias("n"), (F.sum("x").cast("double") / F.count("*")).alias("mean"))
    return point.join(ci, [*by, "metric"])


def median(df: DataFrame, value: str, places: int = 6) -> DataFrame:
    """C7. One row (median): the median of values rounded to ``places``, from counts per distinct value: what one task orders is the
    distinct values, not the rows. Null and NaN do not count; no rows give null."""
    x = F.round(F.col(value).cast("double"), places)
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    return n.agg(F.percentile("x", F.lit(0.5), F.col("n")).alias("median"))
