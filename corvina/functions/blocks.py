"""Block products: a stated query set against all rows, as pairs of blocks instead of pairs of rows, each leaving its best k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def column(values: list) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them (texts by code point)."""
    return np.array(values, np.int64) if not values or isinstance(values[0], int) else np.array(values, dtype="U")


def first_k(s: np.ndarray, k: int) -> np.ndarray:
    """For each row of s the positions of its k highest values, the first positions among equals; not in order."""
    if s.shape[1] <= k:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(s, at, 1).min(1)
    for i in np.flatnonzero((s >= least[:, None]).sum(1) > k).tolist():  # ties at the cut
        at[i] = np.argsort(-s[i], kind="stable")[:k]
    return at


PLACES = 9  # scores are ranked by so many places, so that the order does not hang on the order of addition


class Best:
    """The best k of each query over all the blocks that a task meets; absent entries have the score -inf."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, name: object, qids: list, ids: np.ndarray, s: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, s = ids[order], s[:, order]
        at = first_k(np.round(s, PLACES), self.k)
        new_s, new_ids = np.take_along_axis(s, at, 1), ids[at]
        if name in self.held:
            _, old_s, old_ids = self.held[name]
            new_s, new_ids = np.concatenate([old_s, new_s], 1), np.concatenate([old_ids, new_ids], 1)
            at = np.lexsort((new_ids, -np.round(new_s, PLACES)), axis=1)[:, : self.k]
            new_s, new_ids = np.take_along_axis(new_s, at, 1), np.take_along_axis(new_ids, at, 1)
        self.held[name] = qids, new_s, new_ids

    def rows(self) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        for qids, s, ids in self.held.values():
            q, c = np.nonzero(s > -np.inf)
            yield [qids[i] for i in q.tolist()], ids[q, c], s[q, c]


def best_of_blocks(a: DataFrame, b: DataFrame, k: int, score: Callable[[tuple, tuple], tuple[list, np.ndarray, np.ndarray]], qid: str, did: str) -> DataFrame:
    """(qid, id, score, rank): over all pairs of a block of a and a block of b, score(row of a, row of b) -> (query ids, ids, matrix).

    qid and did are the types of the ids. A task keeps k rows per query, whatever the number of its blocks; the rest is one
    ranking of k rows per query and task, ties by id. Neither side is broadcast or collected."""
    width = len(a.columns)
    types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                qids, ids, s = score(row[:width], row[width:])
                best.add((qids[0], qids[-1], len(qids)), qids, ids, s)
        for q, d, s in best.rows():
            yield pa.RecordBatch.from_arrays([pa.array(q, types[qid]), pa.array(d.tolist(), types[did]), pa.array(s)], names=["qid", "id", "score"])

    a, b = a.toDF(*(f"a{i}" for i in range(width))), b.toDF(*(f"b{i}" for i in range(len(b.columns))))
    pairs = a.hint("shuffle_replicate_nl").crossJoin(b)  # of blocks
    out = pairs.mapInArrow(run, f"qid {'bigint' if qid == 'int' else qid}, id {'bigint' if did == 'int' else did}, score double")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", PLACES)), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)
