"""Problem 7: filling containers of fixed capacity, by shortest-pack-first over the histogram of lengths.

Only the histogram (at most ``capacity`` numbers) reaches the driver. There lengths are placed from the longest to the
shortest, each into the packs with the most room, as counts of packing patterns; the patterns then meet the texts again by
their rank within their length. Ranks come from counts per bucket of texts, so no length is gathered in one task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvina.llm.keyed import join_keyed
from corvina.runtime import Scratch

BUCKETS = 1024  # into which texts are hashed to be ranked; more than one task has cores for
TOKEN = r"[a-z_][a-z0-9_]*|[0-9]+"


def token_count(c: str) -> F.Column:
    """Tokens of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.lower(F.col(c)), F.lit(TOKEN)), F.lit(0))


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns: (number of containers, {length: items per container}); shortest pack first, longest length first."""
    room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        for free in range(capacity, length - 1, -1):
            while left and room[free]:
                n, pattern = room[free].pop()
                take = min(n, left)
                if take < n:
                    room[free].append((n - take, pattern))
                room[free - length].append((take, {**pattern, length: pattern.get(length, 0) + 1}))
                left -= take
            if not left:
                break
        if left:
            per = capacity // length
            if left >= per:
                room[capacity - per * length].append((left // per, {length: per}))
            if left % per:
                room[capacity - (left % per) * length].append((1, {length: left % per}))
    return [x for free in sorted(room) for x in room[free]]


def slots(found: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per segment of items of one length in one pattern: length, first rank, first container, items per container."""
    base, rank, rows = 0, defaultdict(int), []
    for n, pattern in found:
        for length, per in sorted(pattern.items()):
            rows.append((length, rank[length], base, per))
            rank[length] += n * per
        base += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int, scratch: Scratch, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, piece_no, tokens, container): every text with a token in exactly one container, none above capacity.

    Texts above capacity, and only those, are divided into pieces of capacity tokens and a rest. Null texts and texts without
    tokens take no room and do not come out; null ids are kept as they are. Equal lengths are placed by bucket (a hash of id and
    piece), then by id and piece: the same on every cluster, as long as ``buckets`` is."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = df.select(F.col(id_col).cast("bigint").alias("doc_id"), token_count(text_col).alias("n")).filter("n > 0")
    items = items.select("doc_id", F.expr(f"posexplode(transform(sequence(0, CAST((n - 1) DIV {capacity} AS INT)), k -> CAST(least({capacity}, n - k * {capacity}) AS INT)))").alias("piece_no", "tokens"))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            key = np.column_stack([b.column(3).to_numpy(), b.column(2).to_numpy()])
            place = np.empty(len(key), np.int64)
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)])) if len(key) else np.zeros(1, int)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                at = at if tuple(key[s]) == last else 0
                place[s:e] = np.arange(at, at + e - s)
                last, at = tuple(key[s]), at + e - s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "place"])

    ordered = items.repartition(F.col("bucket")).sortWithinPartitions("bucket", "tokens", "doc_id", "piece_no")
    numbered = scratch.keep(ordered.mapInArrow(number, "doc_id bigint, piece_no int, tokens int, bucket int, place bigint"))
    per = scratch.keep(numbered.groupBy("tokens", "bucket").agg(F.count("*").alias("n")))
    first = per.withColumn("first", F.sum("n").over(W.partitionBy("tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    histogram = {r["tokens"]: r["n"] for r in per.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    length, rank, container, each = slots(patterns(histogram, capacity))
    # Segments are ordered by (length, rank): one search finds the segment of an item.
    order_key = length * (1 << 44) + rank
    ranked = join_keyed(numbered, first, ["tokens", "bucket"], "n").select("doc_id", "piece_no", "tokens", (F.coalesce("first", F.lit(0)) + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, r = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            k = np.searchsorted(order_key, size * (1 << 44) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(container[k] + (r - rank[k]) // each[k])], names=["doc_id", "piece_no", "tokens", "container"])

    return ranked.mapInArrow(place, "doc_id bigint, piece_no int, tokens int, container bigint")
