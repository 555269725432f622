"""Versions and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvina.functions import text, vectors
from corvina.runtime import Scratch


def diff_hashes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """N1. (key, status): added, removed, changed or unchanged, of (key, hash) tables."""
    j = old.select(key, F.col("hash").alias("h0")).join(new.select(key, F.col("hash").alias("h1")), key, "full_outer")
    s = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed").otherwise("unchanged")
    return j.select(key, s.alias("status"))


class Snapshots:
    """N2-N4, S10. A table kept as immutable snapshots in a folder: ``snapshot-<n>`` folders, each complete once Spark's _SUCCESS
    mark is in it. The highest complete number is the current one, so there is no pointer that could be lost: a write that dies
    leaves an unmarked folder, and readers keep the snapshot before. Only a folder without any complete snapshot reads as empty;
    every other failure is raised. ``keep`` older snapshots stay for readers that have begun."""

    def __init__(self, spark: SparkSession, base: str, schema: str, keep: int = 2):
        self.spark, self.base, self.schema, self.keep = spark, base.rstrip("/"), schema, keep

    def _fs(self):
        p = self._path("")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))

    def numbers(self) -> tuple[list[int], int]:
        """Numbers of the complete snapshots, ascending, and the highest number in use, complete or not."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return [], 0
        names = [f.getPath().getName() for f in fs.listStatus(self._path(""))]
        found = sorted(int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-") and n.removeprefix("snapshot-").isdigit())
        return [n for n in found if fs.exists(self._path(f"snapshot-{n}/_SUCCESS"))], max(found, default=0)

    def read(self) -> DataFrame:
        done, _ = self.numbers()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/snapshot-{done[-1]}")

    def write(self, df: DataFrame) -> None:
        """df as the next snapshot; of two writers of one number the later fails. Snapshots beyond ``keep`` older ones go."""
        _, last = self.numbers()
        df.write.mode("error").parquet(f"{self.base}/snapshot-{last + 1}")
        for n in self.numbers()[0][: -1 - self.keep]:
            self._fs().delete(self._path(f"snapshot-{n}"), True)


def update_index(index: DataFrame, corpus: DataFrame, encode, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """N3. (new index (key, hash, v), status (key, status)): only added and changed texts are encoded, by encode((key, text)) ->
    (key, v); unchanged vectors are reused and removed ones dropped."""
    hashed = corpus.select(key, "text", text.content_hash("text").alias("hash"))
    status = diff_hashes(index, hashed, key)
    todo = hashed.join(status.filter("status IN ('added', 'changed')"), key, "left_semi")
    kept = index.join(status.filter("status = 'unchanged'"), key, "left_semi").select(key, "hash", "v")
    fresh = todo.select(key, "hash").join(encode(todo.select(key, "text")), key).select(key, "hash", "v")
    return kept.unionByName(fresh), status


def unique_chunks(df: DataFrame, order: str = "ord") -> DataFrame:
    """N5. First text of each fingerprint; empty fingerprints are one."""
    fp = df.withColumn("fp", text.chunk_hash("text"))
    first = fp.groupBy("fp").agg(F.min(order).alias(order))
    return fp.join(first, ["fp", order], "left_semi")


def near_pairs(df: DataFrame, tau: float, key: str = "id") -> DataFrame:
    """N6. (a, b, score) of all vectors whose cosine reaches tau, a < b; blocks against blocks, exact. The threshold is applied
    within the product, so that only pairs that reach it leave it."""
    got = vectors.pairs_above(df.select(F.col(key).alias("id"), "v"), tau)
    return got.select(F.col("qid").alias("a"), F.col("id").alias("b"), "score")


def clusters(ids: DataFrame, pairs: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """N6. (id, cluster): the smallest id joined to each by pairs; smallest labels spread until nothing changes."""
    both = scratch.keep(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(both.select(F.col("a").alias("id")).distinct().withColumn("cluster", F.col("id")))
    none = F.lit(None).cast(dict(labels.dtypes)["id"])
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "cluster"), "b").select(F.col("a").alias("id"), "cluster", none.alias("was"))
        new = near.unionByName(labels.select("id", "cluster", F.col("cluster").alias("was"))).groupBy("id").agg(F.min("cluster").alias("cluster"), F.max("was").alias("was"))
        # a label's own label is at least as small: paths halve at every round
        hop = new.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        new = scratch.keep(new.join(hop, "cluster", "left").select("id", F.coalesce("next", "cluster").alias("cluster"), "was"))
        moved = new.filter("cluster <> was").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            break
    else:
        raise RuntimeError(f"clusters not stable after {rounds} rounds")
    return ids.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def collapse(members: DataFrame) -> DataFrame:
    """N7. (cluster, canonical, size, versions) of (id, cluster, text): the shortest text, then smallest id, stands for all."""
    g = members.groupBy("cluster").agg(F.min(F.struct(F.char_length("text").alias("n"), "id")).alias("m"), F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("ids"))
    return g.select("cluster", F.col("m.id").alias("canonical"), "size", F.concat(F.array("m.id"), F.array_except("ids", F.array("m.id"))).alias("versions"))


def is_deleted(entries: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    """N8. Entries with a column ``deleted``: whether a tombstone names them."""
    return entries.join(tombstones.select(key).distinct().withColumn("deleted", F.lit(True)), key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def compact(entries: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """N8. (entries without the deleted ones, one row (purged) that counts those, tombstones afterwards: none).

    A tombstone that names no entry, or names one twice, purges nothing more. The caller writes all three, the entries first."""
    marked = is_deleted(entries, tombstones, key)
    return marked.filter("NOT deleted").drop("deleted"), marked.agg(F.count(F.when(F.col("deleted"), 1)).alias("purged")), tombstones.limit(0)


def diff_lines(diffs: DataFrame) -> DataFrame:
    """N9. (diff_id, file_path, line) modified by unified diffs (diff_id, diff); a removal marks the line that follows it."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\r\n|\n")).alias("pos", "s"))
    w = W.partitionBy("diff_id").orderBy("pos")
    file = F.when(F.col("s").startswith("+++ b/"), F.trim(F.substring("s", 7, 4096))).when(F.col("s").startswith("+++ /dev/null"), "")
    start = F.when(F.col("s").rlike(r"^@@ -\d+(,\d+)? \+\d+"), F.regexp_extract("s", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int"))
    l = lines.withColumn("file", file).withColumn("start", start)
    l = l.withColumn("file_path", F.last("file", True).over(w)).withColumn("hunk", F.count("start").over(w)).withColumn("base", F.last("start", True).over(w))
    head = F.col("s").startswith("+++") | F.col("s").startswith("---") | F.col("start").isNotNull()
    plus, minus = F.col("s").startswith("+") & ~head, F.col("s").startswith("-") & ~head
    step = F.when(~head & (plus | F.col("s").startswith(" ")), 1).otherwise(0)
    wh = W.partitionBy("diff_id", "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    l = l.withColumn("step", step).withColumn("line", F.col("base") + F.coalesce(F.sum("step").over(wh), F.lit(0)))
    return l.filter((plus | minus) & F.col("file_path").isNotNull() & (F.col("file_path") != "") & F.col("base").isNotNull()).select("diff_id", "file_path", F.col("line").cast("int").alias("line")).distinct()


def impacted(modified: DataFrame, chunks: DataFrame, width: int = 64) -> DataFrame:
    """N10. Chunks (chunk_id, file_path, start_line, end_line) that hold a modified (file_path, line).

    Ranges are laid over bins of ``width`` lines, so that the range join is an equi-join on file and bin."""
    c = chunks.filter("start_line <= end_line").withColumn("bin", F.explode(F.expr(f"sequence(start_line DIV {width}, end_line DIV {width})")))
    m = modified.select("file_path", "line").distinct().withColumn("bin", F.expr(f"line DIV {width}"))
    return c.join(m, ["file_path", "bin"]).filter("line BETWEEN start_line AND end_line").select("chunk_id", "file_path").distinct()
