"""Problem 4: near-duplicate records, by banded signatures and sequential Bayesian verification.

A signature of 128 minimum hashes of a text's word shingles is cut into 32 bands of 4; texts that agree in a band are
candidates. The signatures of a candidate pair are then compared in batches: after each batch the posterior probability that
the similarity reaches the threshold (uniform prior) decides whether the pair is given up, at a chosen probability of missing
a true pair; what survives is compared exactly on its shingles. Rows that are the same but for formatting are one node, so a
group of copies of any size is a single signature.

A band that many different texts share (a common licence head, say) would be joined with itself in one task. Texts in such bands
are compared another way, which is exact: by their rarest shingles (``prefixes``), among which the common head does not count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvina.llm import prefixes
from corvina.llm.textkit import Hasher, mix, record_key, shingle_rows, slices
from corvina.runtime import Scratch

HASHES, ROWS, STEP = 128, 4, 32
HOT = 2_000  # members above which a band is not joined with itself
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = (_SEEDS | np.uint64(1)).astype(np.uint32)
_B = (_SEEDS >> np.uint64(32)).astype(np.uint32)


def signatures(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minimum hashes, a row of HASHES 32-bit numbers for each text with n > 0 shingles."""
    some = n > 0
    starts = np.concatenate(([0], np.cumsum(n[some])))[:-1]
    out = np.empty((int(some.sum()), HASHES), np.uint32)
    if not len(out):
        return out
    lo, hi = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(HASHES):
        x = (lo ^ _B[k]) * _A[k]
        x ^= hi
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= _A[k]
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, different for every band."""
    x = np.zeros((len(sig), HASHES // ROWS), np.uint64)
    for k in range(ROWS):
        x = mix((x + sig[:, k::ROWS]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return mix(x + np.arange(HASHES // ROWS, dtype=np.uint64)).view(np.int64)


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, least agreements): with fewer, the posterior probability that the similarity is at least threshold is below miss.

    Signatures are compared by one byte each, so unequal values agree with probability 1/256."""
    s = (np.arange(4000) + 0.5) / 4000
    r = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            w = m * np.log(r) + (n - m) * np.log1p(-r)
            w = np.exp(w - w.max())
            if w[s >= threshold].sum() / w.sum() >= miss:
                out.append((n, m))
                break
    return out


def nodes(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(k1, k2, id, n, sig, bands) of each class of same texts, taken on its smallest id; n shingles, 0 for short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in (b.slice(p.start, p.stop - p.start) for b in batches for p in slices(b.column(1).to_pylist())):
            texts = b.column(1).to_pylist()
            keys = [record_key(t) for t in texts]
            at = [i for i, k in enumerate(keys) if k is not None]
            s, n = shingle_rows([texts[i] for i in at], size, hasher)
            sig = signatures(s, n)
            bands = band_keys(sig)
            some = np.flatnonzero(n > 0)
            offsets = np.zeros(len(at) + 1, np.int32)
            offsets[1:] = np.cumsum((n > 0) * bands.shape[1])
            small = (sig & np.uint32(255)).astype(np.uint8)
            sigs: list[bytes | None] = [None] * len(at)
            for row, i in enumerate(some.tolist()):
                sigs[i] = small[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i][j] for i in at], pa.int64()) for j in (0, 1)]
                + [b.column(0).take(pa.array(at, pa.int64())), pa.array(n.astype(np.int32)), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))],
                names=["k1", "k2", "id", "n", "sig", "bands"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    every = rows.mapInArrow(run, "k1 bigint, k2 bigint, id bigint, n int, sig binary, bands array<bigint>")
    return every.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min_by(F.struct("n", "sig", "bands"), "id").alias("x")).select("k1", "k2", "id", "x.n", "x.sig", "x.bands")


def shared_bands(node: DataFrame) -> DataFrame:
    """(id, n, band, members): the bands of nodes that more than one node has; counted and filtered by one shuffle."""
    rows = node.filter("n > 0").select("id", "n", F.explode("bands").alias("band"))
    return rows.withColumn("members", F.count("*").over(W.partitionBy("band"))).filter("members > 1")


def candidates(bands: DataFrame, threshold: float, hot: int) -> DataFrame:
    """Distinct (id_a, id_b) that agree in a band of at most ``hot`` members and whose numbers of shingles allow the threshold."""
    rows = bands.filter(F.col("members") <= hot)
    a, b = rows.select("band", F.col("id").alias("id_a"), F.col("n").alias("n_a")), rows.select("band", F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    near = (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)
    return a.join(b, "band").filter((F.col("id_a") < F.col("id_b")) & near).select("id_a", "id_b").distinct()


def prune(pairs: DataFrame, node: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs that sequential comparison of the signatures does not give up."""
    table = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            alive = np.arange(b.num_rows)
            same = np.zeros(b.num_rows, np.int64)
            for n, least in table:
                same[alive] += (x[alive, n - STEP : n] == y[alive, n - STEP : n]).sum(1)
                alive = alive[same[alive] >= least]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["id_a", "id_b"])

    for side in "ab":
        pairs = pairs.join(node.select(F.col("id").alias(f"id_{side}"), F.col("sig").alias(f"sig_{side}")), f"id_{side}")
    return pairs.select("id_a", "id_b", "sig_a", "sig_b").mapInArrow(run, "id_a bigint, id_b bigint")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of rows (id, text): sorted distinct 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in (b.slice(p.start, p.stop - p.start) for b in batches for p in slices(b.column(1).to_pylist())):
            s, n = shingle_rows(b.column(1).to_pylist(), size, hasher)
            at = np.concatenate(([0], np.cumsum(n))) * 8
            raw = s.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=["id", "shingles"])

    return rows.mapInArrow(run, "id bigint, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, id_a, id_b, sim) of the pairs whose exact similarity, intersection over union of the shingle sets, is >= threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - both
                if union and both >= threshold * union - 1e-9:
                    keep.append(i), sims.append(both / union)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(b.num_columns - 2)), pa.array(sims, pa.float64())], names=[*on, "id_a", "id_b", "sim"])

    for side in "ab":
        pairs = pairs.join(sets.select(*on, F.col("id").alias(f"id_{side}"), F.col("shingles").alias(f"s_{side}")), [*on, f"id_{side}"])
    kept = pairs.select(*on, "id_a", "id_b", "s_a", "s_b")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(on)]) + "id_a bigint, id_b bigint, sim double"
    return kept.mapInArrow(run, schema)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, scratch: Scratch, threshold: float = 0.7, size: int = 3, miss: float = 1e-4, hot: int = HOT) -> DataFrame:
    """(id_a, id_b, sim): pairs of classes of same texts, each named by its smallest id, with sim >= threshold; id_a < id_b.

    Null and blank texts, and texts of fewer than ``size`` words, are near nothing; null ids are left out. A pair exactly at 0.7
    shares no band with probability 2e-4, one at 0.75 with 5e-6; the verification gives up a true pair with probability miss at
    most. Texts in a band of more than ``hot`` members are compared with each other by an exact join in place of that band, so
    there is no cap on the members of a band, and no pair is lost for it."""
    node = scratch.keep(nodes(df, id_col, text_col, size).select("id", "n", "sig", "bands"))
    bands = scratch.keep(shared_bands(node))
    left = scratch.keep(prune(candidates(bands, threshold, hot), node.select("id", "sig"), threshold, miss))
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    if bands.filter(F.col("members") > hot).limit(1).count():
        crowd = scratch.keep(texts.join(bands.filter(F.col("members") > hot).select("id").distinct(), "id", "left_semi"))
        left = scratch.keep(left.unionByName(prefixes.self_candidates(crowd, size, threshold, scratch.keep)).distinct())
    need = left.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    return verify(left, shingle_sets(texts.join(need, "id", "left_semi"), size), threshold)
