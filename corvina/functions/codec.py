"""Variable-byte codes and delta gaps of postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_numbers(values: np.ndarray) -> bytes:
    """Seven bits a byte, high groups first, the top bit set on the last byte of each number; negatives are an error."""
    v = np.asarray(values, np.int64)
    if not len(v):
        return b""
    if (v < 0).any():
        raise ValueError("negative numbers have no code")
    n = np.ones(len(v), np.int64)
    for k in range(1, 9):
        n += v >= (1 << (7 * k))
    ends = np.cumsum(n)
    out = np.zeros(ends[-1], np.uint8)
    for k in range(int(n.max())):
        has = n > k
        out[ends[has] - 1 - k] = (v[has] >> (7 * k)) & 127
    out[ends - 1] |= 128
    return out.tobytes()


def decode_numbers(code: bytes) -> np.ndarray:
    b = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(b & 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    at = np.arange(ends[-1] + 1)
    shift = ends[np.searchsorted(ends, at)] - at
    return np.add.reduceat((b[: ends[-1] + 1] & 127).astype(np.int64) << (7 * shift), np.concatenate(([0], ends[:-1] + 1)))


def vbyte_encode(c: Column | str) -> Column:
    """T10. array<bigint> -> binary; null stays null."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else encode_numbers(x))

    return F.pandas_udf(run, "binary")(c)


def vbyte_decode(c: Column | str) -> Column:
    """T10. binary -> array<bigint>; null stays null."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else decode_numbers(x))

    return F.pandas_udf(run, "array<bigint>")(c)


def gaps(ids: Column) -> Column:
    """T11. Gaps of an ascending array: the first value, then differences."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1)))


def from_gaps(g: Column) -> Column:
    """T11. The array whose gaps are g: running sums, in one pass over each array."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.cumsum(x))

    return F.pandas_udf(run, "array<bigint>")(g)


BLOCK = 4096


def postings_blocks(postings: DataFrame, by: str, key: str, block: int = BLOCK) -> DataFrame:
    """T10, T11. (by, block, n, first, code): postings (by, key), key a distinct non-negative integer, as variable-byte codes of
    gaps, in blocks of keys: block is key DIV ``block``, so a list of any length is many rows of at most ``block`` numbers and no
    task gathers it. The first gap of a block is the key itself; within a block the codes stand for the differences."""
    p = postings.select(by, F.floor(F.col(key) / block).alias("block"), F.col(key).cast("bigint").alias("k"))
    g = p.groupBy(by, "block").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    return g.select(by, "block", F.size("ks").alias("n"), F.get("ks", F.lit(0)).alias("first"), vbyte_encode(gaps(F.col("ks"))).alias("code"))


def postings_of(blocks: DataFrame, by: str, key: str) -> DataFrame:
    """T10, T11. The rows (by, key) behind ``postings_blocks``."""
    return blocks.select(by, F.explode(from_gaps(vbyte_decode("code"))).alias(key))
