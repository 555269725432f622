"""Streaming forms of the incremental operators (N3, N5, L5): Structured Streaming with foreachBatch, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions import text
from corvina.operators.versioning import Snapshots, update_index


def unique_chunks(stream: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """N5 on a stream: the first text of each fingerprint within the watermark; state older than that is dropped."""
    return stream.withWatermark(ts, delay).withColumn("fp", text.chunk_hash("text")).dropDuplicatesWithinWatermark(["fp"])


def upsert_index(stream: DataFrame, snapshots: Snapshots, encode, checkpoint: str):
    """N3 on a stream of (doc_id, text, deleted): each batch makes the next snapshot of (doc_id, hash, v).

    Of several rows for an id within a batch the one of the greatest ``seq`` counts. A batch that is run again after a failure
    leads to the same index. Returns the streaming query."""

    def step(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct("text", "deleted"), "seq").alias("x")).select("doc_id", "x.*")
        last = last.persist()
        index = snapshots.read()
        rest = index.join(last.select("doc_id"), "doc_id", "left_anti")
        touched = index.join(last.select("doc_id"), "doc_id", "left_semi")
        fresh, _status = update_index(touched, last.filter("NOT coalesce(deleted, false)").select("doc_id", "text"), encode)
        snapshots.write(rest.unionByName(fresh))
        last.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are left out."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")
