"""Problem 6: the same or almost the same records in two splits, by content-defined chunks and overlap fractions.

A record is normalised to its lower-cased words. A rolling hash runs over every window of three words, and the record is cut after
each window whose hash falls on a fixed residue of ``grain``: a chunk is the run of windows between two cuts, so that an edit moves no
cut but those beside it. Chunk digests are joined across the splits, and the summed lengths of the chunks that two records share,
over the length of each, are their overlap fractions.

Grain 1 cuts after every window. It decides which records are nearly the same: a record of ten words has one or two chunks at any
coarser grain, and one edit can change them all, so only at grain 1 is no pair lost. The fractions of a pair are then parts of
its distinct windows, and sim follows from them: 1 / (1/f + 1/g - 1). Of each record only the rarest chunks are joined to find pairs (``prefixes``);
the fractions are taken over all. A coarser grain gives each record's fraction against the whole other side (``overlap_fractions``). No
chunk is capped."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import prefixes
from corvina.llm.keyed import join_keyed
from corvina.llm.neardup import shingle_sets
from corvina.llm.textkit import Hasher, mix, record_key, slices, words
from corvina.runtime import Scratch

GRAIN = 6  # windows between cuts, on average, of the chunks behind a record's fraction
_P = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """The rolling hash of each ``size`` consecutive words, from their hashes h."""
    n = max(0, len(h) - size + 1)
    s = h[:n]
    for k in range(1, size):
        s = mix(s * _P + h[k : n + k])
    return s


def chunks(h: np.ndarray, size: int = 3, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray]:
    """(digests, lengths in windows) of the distinct chunks of a record with word hashes h; a record of fewer than ``size`` words is one
    chunk of length 1."""
    w = windows(h, size)
    if not len(w):
        w = windows(h, len(h))
    n = len(w)
    ends = np.union1d(np.flatnonzero(mix(w) % np.uint64(grain) == 0) + 1, [n])
    starts = np.concatenate(([0], ends[:-1]))
    at = np.arange(n, dtype=np.uint64) - np.repeat(starts, ends - starts).astype(np.uint64)
    d = mix(np.add.reduceat(mix(w + (at + np.uint64(1)) * _P), starts) + (ends - starts).astype(np.uint64))
    d, first = np.unique(d, return_index=True)
    return d.view(np.int64), (ends - starts)[first]


def heads(df: DataFrame, id_col: str, train: F.Column, fields: list[str], size: int, counts: np.ndarray, threshold: float) -> DataFrame:
    """(field, id, train, k1, k2, n, head): one row per record and non-blank field; n counts its distinct chunks of grain 1, head has
    those to join, apart by field."""
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for f, name in enumerate(names):
                code = b.column(2 + f).dictionary_encode()
                texts, at = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
                own = at[rows].astype(np.int64)
                for part in slices(texts):
                    keys = [record_key(t) for t in texts[part]]
                    good = np.array([k is not None for k in keys], bool)
                    n, s, row = prefixes.heads([t if g else None for t, g in zip(texts[part], good)], size, hasher, counts, threshold)
                    head = prefixes.head_lists(mix(s + np.uint64(f)), row, len(keys))
                    mine = (own >= part.start) & (own < part.stop)
                    mine[mine] = good[own[mine] - part.start]
                    take, i = pa.array(own[mine] - part.start), pa.array(rows[mine])
                    k = [pa.array([x[j] if x else None for x in keys], pa.int64()).take(take) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), b.column(0).take(i), b.column(1).take(i), *k, pa.array(n.astype(np.int32)).take(take), head.take(take)], names=["field", "id", "train", "k1", "k2", "n", "head"])

    return _texts(df, id_col, train, fields).mapInArrow(run, "field string, id bigint, train boolean, k1 bigint, k2 bigint, n int, head array<bigint>")


def _texts(df: DataFrame, id_col: str, train: F.Column, fields: list[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), *(F.col(f).cast("string").alias(f) for f in fields)).filter("id IS NOT NULL")


def records(df: DataFrame, id_col: str, train: F.Column, fields: list[str], size: int) -> DataFrame:
    """(field, id, train, k1, k2, weight, chunks): one row per record and non-blank field; weight is the length of its distinct chunks of
    grain GRAIN, chunks an array of (d, w)."""
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids, trains = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            ds, ls, offsets = [], [], [0]
            for f in range(len(names)):
                code = b.column(2 + f).dictionary_encode()
                done = []
                for t in code.dictionary.to_pylist():
                    key = record_key(t)
                    if key is None:
                        done.append(None)
                        continue
                    h = hasher(words(t))
                    done.append((key, *chunks(h, size)))
                for i, at in enumerate(code.indices.to_pylist()):
                    if at is None or done[at] is None:
                        continue
                    key, d, w = done[at]
                    for c, v in zip(out, (names[f], ids[i], trains[i], *key, int(w.sum()))):
                        c.append(v)
                    ds.append(d), ls.append(w)
                    offsets.append(offsets[-1] + len(d))
            d, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ds, ls))
            item = pa.StructArray.from_arrays([pa.array(d), pa.array(w.astype(np.int32))], names=["d", "w"])
            types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), item)], names=["field", "id", "train", "k1", "k2", "weight", "chunks"])

    return _texts(df, id_col, train, fields).mapInArrow(run, "field string, id bigint, train boolean, k1 bigint, k2 bigint, weight int, chunks array<struct<d: bigint, w: int>>")


def classes(rec: DataFrame, keep: list[str]) -> DataFrame:
    """(field, k1, k2, cid, copies, in_train, outside, keep): classes of same texts, with columns ``keep`` of the smallest id, and how
    many members lie in the training split and outside it."""
    best = F.min_by(F.struct(*keep), "id").alias("x")
    inside = F.count(F.when(F.col("train"), 1)).alias("in_train")
    return rec.groupBy("field", "k1", "k2").agg(F.min("id").alias("cid"), F.count("*").alias("copies"), inside, best).select("field", "k1", "k2", "cid", "copies", "in_train", (F.col("copies") - F.col("in_train")).alias("outside"), "x.*")


def shared_chunks(cls: DataFrame) -> DataFrame:
    """(field, cid, in_train, outside, weight, d, w, df): the chunks of each class that occur on both sides, be it in this class alone."""
    occ = cls.select("field", "cid", "in_train", "outside", "weight", F.explode("chunks").alias("c")).select("*", "c.d", "c.w").drop("c")
    any_t, any_e = (F.max(F.col(c) > 0) for c in ("in_train", "outside"))
    both = occ.groupBy("field", "d").agg(F.count("*").alias("df"), any_t.alias("t"), any_e.alias("e")).filter("t AND e").select("field", "d", "df")
    return join_keyed(occ, both, ["field", "d"], "df")


def overlap_fractions(shared: DataFrame) -> DataFrame:
    """(field, cid, fraction): the part of each class's content that the other side has too, in any records."""
    return shared.groupBy("field", "cid").agg((F.sum("w") / F.first("weight")).alias("fraction"))


def pair_fractions(pairs: DataFrame, sets: DataFrame, on: tuple[str, ...] = ("field",)) -> DataFrame:
    """(on, id_a, id_b, part_a, part_b): of each pair the overlap fractions, the length of the chunks of grain 1 that both have over the
    length of each. sets is (on, id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                rows.append((both / max(len(p), 1), both / max(len(q), 1)))
            f = np.array(rows).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(f[:, 0]), pa.array(f[:, 1])], names=[*on, "id_a", "id_b", "part_a", "part_b"])

    for side in "ab":
        pairs = pairs.join(sets.select(*on, F.col("id").alias(f"id_{side}"), F.col("shingles").alias(f"s_{side}")), [*on, f"id_{side}"])
    kept = pairs.select(*on, "id_a", "id_b", "s_a", "s_b")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(on)]) + "id_a bigint, id_b bigint, part_a double, part_b double"
    return kept.mapInArrow(run, schema)


class Leakage:
    """The overlaps between the training rows of a table and its other rows; parts are computed once and kept as tables.

    A row counts as training if its split equals ``train``; a null split does not. Blank texts and blank keys match nothing; a text
    of fewer than ``size`` words is near nothing, and the same as its copies. Null ids are left out."""

    def __init__(self, df: DataFrame, scratch: Scratch, id_col: str = "pair_id", split_col: str = "split", train: str = "train", fields: tuple[str, ...] = ("query", "code"), key_col: str = "corpus_id", threshold: float = 0.7, size: int = 3):
        self.df, self.s, self.key, self.fields, self.size, self.threshold = df, scratch, key_col, list(fields), size, threshold
        self.id, self.train = F.col(id_col).cast("bigint"), F.coalesce(F.col(split_col) == train, F.lit(False))
        self.id_col = id_col

    @cached_property
    def rec(self) -> DataFrame:
        counts = prefixes.frequencies(self.df, self.fields, self.size)
        return self.s.keep(heads(self.df, self.id_col, self.train, self.fields, self.size, counts, self.threshold))

    @cached_property
    def cls(self) -> DataFrame:
        return self.s.keep(classes(self.rec, ["n", "head"]))

    @cached_property
    def shared(self) -> DataFrame:
        rec = self.s.keep(records(self.df, self.id_col, self.train, self.fields, self.size))
        return self.s.keep(shared_chunks(self.s.keep(classes(rec, ["weight", "chunks"]))))

    @cached_property
    def near(self) -> DataFrame:
        """(field, id_a of a class in training, id_b of one outside, part_a, part_b) with sim of at least the threshold."""
        side = lambda c: self.cls.filter(f"{c} > 0 AND n > 0").select("field", F.col("cid").alias("id"), "n", "head")
        crowd = self.s.keep(prefixes.crowded(self.cls))
        found = self.s.keep(prefixes.candidates(side("in_train"), side("outside"), crowd, self.threshold, on=("field",)))
        need = found.select("field", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
        sets = None
        for f in self.fields:
            ids = need.filter(F.col("field") == f).select("id")
            text = self.df.select(self.id.alias("id"), F.col(f).cast("string").alias("text")).join(ids, "id", "left_semi")
            got = shingle_sets(text, self.size).withColumn("field", F.lit(f))
            sets = got if sets is None else sets.unionByName(got)
        f, g = F.col("part_a"), F.col("part_b")
        sim = f * g / F.nullif(f + g - f * g, F.lit(0.0))  # 1 / (1/f + 1/g - 1)
        return self.s.keep(pair_fractions(found, sets).filter(sim >= self.threshold - 1e-9))

    def _keyed(self) -> DataFrame:
        key = F.col(self.key).cast("string")
        return self.df.select(self.id.alias("id"), self.train.alias("train"), F.when(F.trim(key) != "", key).alias("key")).filter("key IS NOT NULL AND id IS NOT NULL")

    def _text_pairs(self) -> DataFrame:
        """(x in training, y outside) of linked classes. Members of a class lie in blocks of bounded size, and a link is as many cells as
        its two classes have pairs of blocks, so a class of any size is spread over tasks."""
        links = self.near.select("field", "id_a", "id_b").unionByName(self.cls.filter("in_train > 0 AND outside > 0").select("field", F.col("cid").alias("id_a"), F.col("cid").alias("id_b")))
        used = links.select("field", F.explode(F.array("id_a", "id_b")).alias("cid")).distinct()
        blocks = lambda c: F.ceil(F.col(c) / prefixes.BLOCK).cast("int")
        cls = self.s.keep(self.cls.select("field", "k1", "k2", "cid", "copies", blocks("in_train").alias("parts_a"), blocks("outside").alias("parts_b")).join(used, ["field", "cid"], "left_semi"))
        j = join_keyed(self.rec.select("field", "id", "train", "k1", "k2"), cls, ["field", "k1", "k2"], "copies")
        members = self.s.keep(j.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("train"), F.col("parts_a")).otherwise(F.col("parts_b"))).cast("int")).select("field", "id", "train", "cid", "block"))
        sizes = [cls.select("field", F.col("cid").alias(f"id_{s}"), f"parts_{s}") for s in "ab"]
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        cell = self.s.keep(links.join(sizes[0], ["field", "id_a"]).join(sizes[1], ["field", "id_b"]).withColumn("sa", every("parts_a")).withColumn("sb", every("parts_b")).select("field", "id_a", "id_b", "sa", "sb"))
        a = members.filter("train").select("field", F.col("cid").alias("id_a"), F.col("block").alias("sa"), F.col("id").alias("x"))
        b = members.filter("NOT train").select("field", F.col("cid").alias("id_b"), F.col("block").alias("sb"), F.col("id").alias("y"))
        at = ["field", "id_a", "id_b", "sa", "sb"]
        return cell.join(a, ["field", "id_a", "sa"]).join(cell.join(b, ["field", "id_b", "sb"]), at).select("x", "y")

    def _key_pairs(self) -> DataFrame:
        """(x in training, y outside) of equal keys; keys of many rows are joined in blocks."""
        k = self._keyed()
        n = k.groupBy("key").agg(F.count("*").alias("n"), F.max("train").alias("t"), F.min("train").alias("every")).filter("t AND NOT every")
        n = n.withColumn("p", F.ceil(F.col("n") / prefixes.BLOCK).cast("int"))
        k = join_keyed(k, n.select("key", "n", "p"), ["key"], "n").select("id", "train", "key", "p")
        a, b = (prefixes.cells(k.filter(c), "id", F.col("p"), i == 0).select("key", "sa", "sb", F.col("id").alias("xy"[i])) for i, c in enumerate(("train", "NOT train")))
        return a.join(b, ["key", "sa", "sb"]).select("x", "y")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: rows of which exactly one is in training and which are the same or nearly so."""
        return self._text_pairs().unionByName(self._key_pairs()).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def rows(self) -> DataFrame:
        """(id, by, fraction): rows outside training that overlap with it, by key or a field; a row once for each. fraction is the
        greatest part of the field's content that one training record has as well, 1 for the same text, null for a key."""
        near = self.near.groupBy("field", F.col("id_b").alias("cid")).agg(F.max("part_b").alias("fraction"))
        same = self.cls.filter("in_train > 0 AND outside > 0").select("field", "cid", F.lit(1.0).alias("fraction"))
        hit = near.unionByName(same).groupBy("field", "cid").agg(F.max("fraction").alias("fraction"))
        cls = self.cls.filter("outside > 0").select("field", "k1", "k2", "cid", "copies").join(hit, ["field", "cid"])
        rows = self.rec.filter("NOT train").select("field", "id", "k1", "k2")
        text = join_keyed(rows, cls, ["field", "k1", "k2"], "copies").select("id", F.col("field").alias("by"), "fraction")
        k = self._keyed()
        key = k.filter("NOT train").join(k.filter("train").select("key").distinct(), "key", "left_semi").select("id", F.lit(self.key).alias("by"), F.lit(None).cast("double").alias("fraction"))
        return text.unionByName(key)

    def row_fractions(self) -> DataFrame:
        """(id, fraction): of each row outside training the greatest part of a field's content that training has too."""
        f = overlap_fractions(self.shared)
        own = self.cls.filter("outside > 0").select("field", "k1", "k2", "cid", "copies").join(f, ["field", "cid"])
        rows = self.rec.filter("NOT train").select("field", "id", "k1", "k2")
        return join_keyed(rows, own, ["field", "k1", "k2"], "copies").groupBy("id").agg(F.max("fraction").alias("fraction"))
