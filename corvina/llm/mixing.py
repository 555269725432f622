"""Problem 8: combining sources to target shares of all tokens, with capped repetition.

Tokens are summed per source (map-side first), a source's repetition rate is its target tokens over its own tokens, at most
its cap, and every text comes out floor(rate) times and once more if a hash of its id falls below the fraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.packing import token_count


def rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, all_tokens, rate, short): one row per target.

    docs has source and tokens. The whole is the tokens of all texts, those of null or untargeted sources included. short
    says that max_repeats times the source's tokens is below its target. A null share counts as 0, a null cap as 0."""
    own = docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = own.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("all_tokens"))
    t = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("max_repeats"))
    j = t.join(own, "source", "left").crossJoin(F.broadcast(total))  # one row: the sum
    j = j.withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    want = F.col("target_share") * F.col("all_tokens")
    rate = F.when(F.col("source_tokens") > 0, F.least(want / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return j.withColumn("rate", rate).withColumn("short", F.col("max_repeats") * F.col("source_tokens") < want)


def mix(docs: DataFrame, rate: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tokens, copy_no): each text floor(rate) times and once more with probability of the fraction.

    docs has doc_id, source and tokens; rate has a row per target, a table fixed in size by the caller, and is broadcast: a
    source that holds most texts stays where it lies. Texts of null or untargeted sources, and null ids, do not come out."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    j = docs.select("doc_id", "source", "tokens").filter("doc_id IS NOT NULL").join(F.broadcast(rate.select("source", "rate")), "source")
    n = (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    j = j.withColumn("n", n).filter("n > 0")
    return j.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))


def shares(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, all_tokens, mixed_tokens, reached_share): reached_share is of all tokens that
    came out, in as many copies as they did."""
    got = mixed.select("source", "tokens").groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"))
    out = rate.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = F.sum("mixed_tokens").over(_all())
    return out.select("source", "target_share", "max_repeats", "source_tokens", "all_tokens", "mixed_tokens", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0).alias("reached_share"))


def exhausted(reached: DataFrame) -> DataFrame:
    """The rows of ``shares`` whose source came out as often as it may, every text of it, and yet below its target."""
    return reached.filter("mixed_tokens = max_repeats * source_tokens AND mixed_tokens < target_share * all_tokens")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # over the rows of the report, one per target


def documents(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, tokens) of texts; a null text has no tokens."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), token_count(text_col).alias("tokens"))
