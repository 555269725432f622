"""Exact similarity joins of shingle sets by their rarest shingles, shared by problems 4 and 6.

Two sets of n and m shingles with a similarity of at least the threshold have at least threshold * n in common, so each of the two
has a common one among its first n - ceil(threshold * n) + 1, in any order that all sets share: its head. Only heads are joined,
rarest shingles first by counts over all rows; the order decides the cost alone, and no pair is lost at any length. A shingle that
is in so many heads that one task could not hold their pairs is joined in blocks of rows against blocks of rows; these are counted too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.textkit import Hasher, shingle_rows, slices

BITS = 18  # the size of the table of counts
BLOCK = 5_000  # rows of one key that a task joins with as many others


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(df: DataFrame, fields: list[str], size: int) -> np.ndarray:
    """In how many texts of all rows shingles occur, copies included, a table of 2^BITS entries by their first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for column in b.columns:
                code = column.drop_null().dictionary_encode()
                texts, times = code.dictionary.to_pylist(), np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary))
                for part in slices(texts):
                    s, n = shingle_rows(texts[part], size, hasher)
                    np.add.at(total, bucket(s), np.repeat(times[part], n))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["g", "n"])

    texts = df.select(*(F.col(f).cast("string").alias(f) for f in fields))
    rows = texts.mapInArrow(run, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[rows["g"].to_numpy()] = rows["n"].to_numpy()
    return out


def heads(texts: list[str | None], size: int, hasher: Hasher, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, s, row): the number of distinct shingles of each text, and the heads of all texts, one after the other."""
    s, n = shingle_rows(texts, size, hasher)
    row = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((s, counts[bucket(s)], row))
    s, row = s[order], row[order]
    at = np.arange(len(s)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    keep = at < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[row]
    return n, s[keep], row[keep]


def crowded(sets: DataFrame) -> DataFrame:
    """(d, p): the shingles in the heads of more than BLOCK of the rows (head), and into how many blocks those rows are to be split. There
    are at most as many as BLOCK goes into the shingles of all heads."""
    n = sets.select(F.explode("head").alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    return n.select("d", F.ceil(F.col("n") / BLOCK).cast("int").alias("p"))


def cells(df: DataFrame, key: str, parts: Column, first: bool) -> DataFrame:
    """df with columns sa, sb: the blocks in which a row meets the rows of the other side. A row of the first side lies in one block sa
    and is repeated for each sb, one of the second the other way round; with parts 1 a row stays single."""
    own, other = ("sa", "sb") if first else ("sb", "sa")
    return df.withColumn(own, F.pmod(F.xxhash64(key), parts.cast("bigint")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))


def candidates(a: DataFrame, b: DataFrame, crowd: DataFrame, threshold: float, same: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (on, id_a, id_b) of sides (on, id, n, head array<bigint>) whose heads have enough in common; if ``same``, of one side
    with itself, id_a < id_b. crowd is the kept table of what is ``crowded``.

    The head that ends first in the order is compared whole, so beyond the c common shingles no more are to come than the
    rest of that set, ceil(threshold * n) - 1; pairs that cannot reach the threshold so are left out."""
    near = (F.col("n_a") >= F.col("n_b") * threshold - 1e-6) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-6)
    apart = F.col("id_a") < F.col("id_b") if same else F.col("id_a") != F.col("id_b")

    def joined(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        x, y = x.withColumnsRenamed({"id": "id_a", "n": "n_a"}), y.withColumnsRenamed({"id": "id_b", "n": "n_b"}).drop(*on)
        return x.join(y, keys).filter(apart & near).select(*on, "id_a", "id_b", "n_a", "n_b")

    every = [x.select(*on, "id", "n", F.explode("head").alias("d")) for x in (a, b)]
    cold = joined(*(x.join(F.broadcast(crowd.select("d")), "d", "left_anti") for x in every), ["d"])
    hot = [x.join(F.broadcast(crowd), "d") for x in every]
    hot = joined(*(cells(x, "id", F.col("p"), i == 0).drop("p") for i, x in enumerate(hot)), ["d", "sa", "sb"])
    both = cold.unionByName(hot).groupBy(*on, "id_a", "id_b").agg(F.count("*").alias("c"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    rest = F.ceil(F.greatest("n_a", "n_b") * threshold - 1e-9) - 1
    return both.filter((F.col("c") + rest) * (1 + threshold) >= (F.col("n_a") + F.col("n_b")) * threshold - 1e-6).select(*on, "id_a", "id_b")


def head_lists(s: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """The column head of ``rows`` rows, from the shingles of their heads."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.view(np.int64)))


def self_candidates(texts: DataFrame, size: int, threshold: float, keep) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of texts (id, text) whose heads have enough in common; keep(df) writes the heads once."""
    counts = frequencies(texts, ["text"], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in (b.slice(p.start, p.stop - p.start) for b in batches for p in slices(b.column(1).to_pylist())):
            n, s, row = heads(b.column(1).to_pylist(), size, hasher, counts, threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), head_lists(s, row, b.num_rows)], names=["id", "n", "head"])

    side = keep(texts.select("id", "text").mapInArrow(run, "id bigint, n int, head array<bigint>").filter("n > 0"))
    return candidates(side, side, keep(crowded(side)), threshold, same=True)
