"""The queries of the training-data problems, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.llm import boundaries, formatting, mixing, neardup, overlap, packing, residue, splits, topn
from corvina.llm.sql import oracle_sql  # noqa: F401  (part of this module's interface)
from corvina.runtime import Scratch, load

FIELDS = ("download.code", "download.query")


def _limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    """Of the fixed table size_limits: field -> (max_size, overlap)."""
    return {r["field_name"]: (r["max_size"], r["overlap"]) for r in load(spark, d, "size_limits").collect()}


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits, out = _limits(spark, d), None
    for field in FIELDS:
        column = field.split(".")[1]
        got = boundaries.split_oversized(load(spark, d, "download"), column, *limits[field], keep=["pair_id"])
        got = got.select("pair_id", F.lit(field).alias("field_name"), "piece_no", "char_from", "char_to", "piece")
        out = got if out is None else out.unionByName(got)
    return out


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any division: texts divided, pieces above the limit, neighbours without the exact overlap, and texts whose
    pieces, laid over each other, are not the text."""
    limits, out = _limits(spark, d), None
    for field in FIELDS:
        column, (size, overlap_) = field.split(".")[1], limits[field]
        df = load(spark, d, "download")
        pieces = boundaries.split_oversized(df, column, size, overlap_, keep=["pair_id"])
        w = Window.partitionBy("pair_id").orderBy("piece_no")
        p = pieces.withColumn("before", F.lag("char_to").over(w)).withColumn("own", F.substring("piece", F.when(F.col("piece_no") > 0, overlap_ + 1).otherwise(1), 1 << 30))
        bad = (F.col("char_from") != F.coalesce(F.col("before") - overlap_, F.lit(0))) | (F.char_length("piece") != F.col("char_to") - F.col("char_from"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")  # the pieces of one text
        per = p.groupBy("pair_id").agg(F.sum((F.char_length("piece") > size).cast("int")).alias("over"), F.sum(bad.cast("int")).alias("misplaced"), F.md5(text).alias("h"))
        j = per.join(df.select("pair_id", F.md5(column).alias("h0")), "pair_id")
        got = j.agg(F.count("*").alias("texts"), F.sum("over").alias("over"), F.sum("misplaced").alias("misplaced"), F.sum((F.col("h") != F.col("h0")).cast("int")).alias("not_whole"))
        got = got.select(F.lit(field).alias("field_name"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("texts", "over", "misplaced", "not_whole")))
        out = got if out is None else out.unionByName(got)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).filter("piece_no = 1").select("pair_id", "field_name")


def _top(spark: SparkSession, d: str, n: int) -> DataFrame:
    return topn.top_n_per_group(load(spark, d, "hard_negative_mining"), "query_id", "hard_negative_corpus_id", "bm25_score", n)


def p2_top3(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 3).select("query_id", "hard_negative_corpus_id")


TEXTS = (("download", "pair_id", "code"), ("hard_negative_mining", "mine_id", "hard_negative_code"))


def _keys(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    out = None
    for table, key, text in TEXTS:
        got = formatting.record_keys(load(spark, d, table), key, text).select(F.lit(table).alias("table_name"), "id", "k1", "k2")
        out = got if out is None else out.unionByName(got)
    return scratch.keep(out)


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys(spark, d, Scratch(spark, "p3"))
    return formatting.classes(keys, "table_name").select("table_name", "keep_id", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(_keys(spark, d, Scratch(spark, "p3")), "table_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, d, "download"), "pair_id", "code", Scratch(spark, "p4")).select("id_a", "id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every class of same code with its group of near-duplicate classes and its number of links."""
    s = Scratch(spark, "p4")
    links = s.keep(neardup.near_duplicates(load(spark, d, "download"), "pair_id", "code", s).select("id_a", "id_b"))
    roots = splits.hash_to_min(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), s).select(F.col("node").alias("keep_id"), "root")
    n = links.select(F.explode(F.array("id_a", "id_b")).alias("keep_id")).groupBy("keep_id").agg(F.count("*").alias("links"))
    return n.join(roots, "keep_id").select(F.col("root").alias("group_id"), "keep_id", "links")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "p5")
    return splits.connected(load(spark, d, "download"), "pair_id", ("query_id", "corpus_id"), s)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("group_id < pair_id").select("group_id", "pair_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    groups = Scratch(spark, "p5").keep(_groups(spark, d))
    targets = {r["split"]: r["target_share"] for r in load(spark, d, "split_targets").collect()}  # fixed, 3 rows
    return splits.assign_splits(groups, targets)


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each split reached of its target, and its largest group."""
    return splits.split_shares(p5_splits(spark, d), load(spark, d, "split_targets")).withColumn("reached_share", F.round("reached_share", 9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.Leakage(load(spark, d, "download"), Scratch(spark, "p6")).pairs()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the other splits that are in training as well, per split and source, by each kind of overlap and by any, and their
    mean overlap fraction with the training record nearest to each (0 for a row without any)."""
    df = load(spark, d, "download")
    hit = overlap.Leakage(df, Scratch(spark, "p6")).rows().groupBy("id").agg(F.collect_set("by").alias("by"), F.max("fraction").alias("fraction"))
    j = df.filter("coalesce(split, '') <> 'train'").select("pair_id", "split", "source").join(hit.withColumnRenamed("id", "pair_id"), "pair_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    kinds = [count(F.array_contains("by", k)).alias(f"by_{k}") for k in ("query", "code", "corpus_id")]
    return j.groupBy("split", "source").agg(F.count("*").alias("n_rows"), *kinds, count(F.col("by").isNotNull()).alias("overlapping"), F.round(F.avg(F.coalesce("fraction", F.lit(0.0))), 6).alias("mean_fraction"))


def p6_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Overlap fraction with the other side of each class of same texts that has any."""
    got = overlap.overlap_fractions(overlap.Leakage(load(spark, d, "download"), Scratch(spark, "p6")).shared)
    return got.select("field", "cid", F.round("fraction", 6).alias("fraction"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(spark, d, "documents"), "doc_id", "text", _limits(spark, d)["documents.text"][0], Scratch(spark, "p7"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    size = _limits(spark, d)["documents.text"][0]
    per = _packed(spark, d).groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.round(F.sum("t") / F.count("*") / size, 4).alias("filled"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: texts, tokens and pieces placed, containers above capacity, texts not placed whole."""
    size, packed = _limits(spark, d)["documents.text"][0], Scratch(spark, "p7").keep(_packed(spark, d))
    n = load(spark, d, "documents").select("doc_id", packing.token_count("text").alias("n")).filter("n > 0")
    per = packed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    lost = n.join(per, "doc_id", "left").filter("t IS NULL OR t <> n").agg(F.count("*").alias("not_whole"))
    over = packed.groupBy("container").agg(F.sum("tokens").alias("t")).filter(F.col("t") > size).agg(F.count("*").alias("over"))
    total = per.agg(F.count("*").alias("texts"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"))
    return total.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(over))  # one row each


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).filter("piece_no = 1").select("doc_id")


def _mix_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.documents(load(spark, d, "documents"), "doc_id", "text", "source")
    return docs, mixing.rates(docs, load(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_mix_inputs(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, rate = _mix_inputs(spark, d)
    got = mixing.shares(mixing.mix(docs, rate), rate)
    return got.select("source", "target_share", "source_tokens", "mixed_tokens", F.round("reached_share", 9).alias("reached_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, rate = _mix_inputs(spark, d)
    return mixing.exhausted(mixing.shares(mixing.mix(docs, rate), rate)).select("source")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return residue.judged(load(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("verdict IS NOT NULL").select("doc_id")


def p9_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("verdict").agg(F.count("*").alias("n_docs"), F.sum("filler").alias("filler"), F.sum("notice").alias("notice"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}
