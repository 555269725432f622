"""Lexical retrieval (L1-L5): an index with a row per document, and scores as products of blocks of queries and of documents.

A document's terms are 64-bit identifiers with their counts, in one row, so the index is partitioned by document and a search
shuffles neither postings nor scores: terms that every document holds are one column of a matrix, not a hot join key. Of the
collection only document frequencies, the number of documents and their total length are needed; all three are kept up to date
by the changed documents alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions.blocks import best_of_blocks, column
from corvina.functions.text import KEYWORDS
from corvina.functions.tokens import TermIds, term_id
from corvina.runtime import Scratch

Tokens = Callable[[str | None], list[str]]


@dataclass(frozen=True)
class Index:
    """docs (key, len, terms, tf), df (term, df), stats: one row (n, total)."""

    docs: DataFrame
    df: DataFrame
    stats: DataFrame
    key: str = "doc_id"


def term_rows(texts: DataFrame, tokens: Tokens, key: str, text: str, least_length: int = 0) -> DataFrame:
    """(key, len, terms, tf): the distinct terms of each text, as identifiers, with their counts; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds()
        for b in batches:
            lens, terms, counts, offsets = [], [], [], [0]
            for t in b.column(1).to_pylist():
                ts = tokens(t)
                x, n = np.unique(np.array(ids(ts), np.int64), return_counts=True)
                lens.append(max(len(ts), least_length)), terms.append(x), counts.append(n)
                offsets.append(offsets[-1] + len(x))
            at = pa.array(offsets, pa.int32())
            flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (terms, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int32()), pa.ListArray.from_arrays(at, pa.array(flat[0])), pa.ListArray.from_arrays(at, pa.array(flat[1].astype(np.int32)))], names=[key, "len", "terms", "tf"])

    rows = texts.select(key, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, len int, terms array<bigint>, tf array<int>")


def postings(texts: DataFrame, tokens: Tokens, key: str = "doc_id", text: str = "text") -> DataFrame:
    """L1. (term, key, tf): a row per term and document, terms as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, terms, tf = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                count: dict[str, int] = {}
                for x in tokens(t):
                    count[x] = count.get(x, 0) + 1
                own += [i] * len(count)
                terms += count
                tf += count.values()
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column(0).take(pa.array(own, pa.int64())), pa.array(tf, pa.int32())], names=["term", key, "tf"])

    rows = texts.select(key, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"term string, `{key}` {dict(rows.dtypes)[key]}, tf int")


def _frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))


def build(corpus: DataFrame, tokens: Tokens, scratch: Scratch, key: str = "doc_id", text: str = "text", least_length: int = 0) -> Index:
    """L1. The index of a corpus (key, text); texts are tokenised once. Texts without terms count in n and in the mean length."""
    docs = scratch.keep(term_rows(corpus, tokens, key, text, least_length))
    return Index(docs, _frequencies(docs), _stats(docs), key)


def maintain(index: Index, removed: DataFrame, upserts: DataFrame, tokens: Tokens, scratch: Scratch, text: str = "text", least_length: int = 0) -> Index:
    """L5. The index after removals (key) and insertions or updates (key, text); a key in both is updated.

    Only the upserts are tokenised. Frequencies and totals change by the documents that go and come, so the work beyond one
    pass over the index follows the change; ids that the index does not know are no error."""
    key = index.key
    gone = removed.select(key).unionByName(upserts.select(key)).distinct()
    old = scratch.keep(index.docs.join(gone, key, "left_semi"))
    new = scratch.keep(term_rows(upserts, tokens, key, text, least_length))
    docs = index.docs.join(gone, key, "left_anti").unionByName(new)
    change = _frequencies(new).unionByName(_frequencies(old).withColumn("df", -F.col("df")))
    df = index.df.unionByName(change).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    stats = index.stats.unionByName(_stats(new)).unionByName(_stats(old).select((-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
    return Index(scratch.keep(docs), scratch.keep(df), stats.agg(F.sum("n").alias("n"), F.sum("total").alias("total")), key)


def query_terms(queries: DataFrame, tokens: Tokens, key: str = "query_id", text: str = "query", counted: bool = False) -> DataFrame:
    """(key, term, w): the distinct terms of each query; w is 1, or the term's count if counted (L4)."""
    t = term_rows(queries, tokens, key, text).select(key, F.explode(F.arrays_zip("terms", "tf")).alias("x")).select(key, F.col("x.terms").alias("term"), F.col("x.tf").alias("w"))
    return t if counted else t.withColumn("w", F.lit(1))


#: L3. Weights of identifiers and of reserved words.
CODE_WEIGHTS = (2.5, 0.5)


def search(terms: DataFrame, index: Index, k: int, scratch: Scratch, k1: float = 1.5, b: float = 0.75, weights: tuple[float, float] | None = None, q: str = "query_id") -> DataFrame:
    """L2-L4. (q, key, score, rank): the k best texts of each query among those that share a term with it, ties by key.

    With ``weights`` (identifier, reserved word) a term counts by its kind (L3); lengths stay as they are. Scores are ranked by
    their first 9 places. Queries are packed into blocks of at most 256, documents into blocks of at most 4096."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b within [0, 1]")
    key, types = index.key, (dict(terms.dtypes)[q], dict(index.docs.dtypes)[index.key])
    n = F.col("n")
    weighted = terms.join(index.df, "term").crossJoin(F.broadcast(index.stats))  # one row
    weighted = weighted.select(F.col(q).alias("qid"), "term", (F.col("w") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    per = weighted.groupBy("qid").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("qid", F.col("x.term").alias("t"), F.col("x.w").alias("w"))  # a query's own terms

    def pack(size: int, ids: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    s = whole.slice(at, size)
                    counts = np.diff(s.column(1).offsets.to_numpy()).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s.column(0).to_pylist()], pa.list_(s.column(0).type)), *(pa.array([x.tobytes()]) for x in (counts, s.column(1).flatten().to_numpy(), s.column(2).flatten().to_numpy().astype(np.float64)))]
                        + [pa.array([s.column(i).to_numpy().astype(np.float64).tobytes()]) for i in range(3, s.num_columns)],
                        names=[ids, "n", "t", "w", "norm"][: s.num_columns + 1],
                    )

        return run

    keywords = np.sort(np.array([term_id(w) for w in KEYWORDS], np.int64))
    mean = F.greatest(F.col("total") / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0))
    docs = index.docs.filter(F.col(key).isNotNull() & (F.size("terms") > 0)).crossJoin(F.broadcast(index.stats)).select(F.col(key).alias("id"), "terms", "tf", (k1 * (1 - b + b * F.col("len") / mean)).alias("norm"))
    left = per.mapInArrow(pack(256, "qids"), f"qids array<{types[0]}>, n binary, t binary, w binary")
    right = scratch.keep(docs.mapInArrow(pack(4096, "ids"), f"ids array<{types[1]}>, n binary, t binary, w binary, norm binary"))

    def score(x: tuple, y: tuple) -> tuple[list, np.ndarray, np.ndarray]:
        qids, qn, qt, qw = x[0], *(np.frombuffer(v, d) for v, d in zip(x[1:], (np.int64, np.int64, np.float64)))
        ids, dn, dt, tf, norm = y[0], *(np.frombuffer(v, d) for v, d in zip(y[1:], (np.int64, np.int64, np.float64, np.float64)))
        vocabulary, col = np.unique(qt, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, dt), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == dt)
        row, at, f = np.repeat(np.arange(len(ids)), dn)[hit], at[hit], tf[hit]
        if weights:
            t = dt[hit]
            f = f * np.where(keywords[np.minimum(np.searchsorted(keywords, t), len(keywords) - 1)] == t, weights[1], weights[0])
        f = f * (k1 + 1) / (f + norm[row])
        out = np.zeros((len(qids), len(ids)))
        # terms of many queries by a matrix product, the others entry by entry
        per_term = np.bincount(col, minlength=len(vocabulary))
        common = per_term > max(4, len(qids) // 16)
        place = np.cumsum(common) - 1
        own = np.repeat(np.arange(len(qids)), qn)
        wq = np.zeros((len(qids), int(common.sum())))
        c = common[col]
        wq[own[c], place[col[c]]] = qw[c]
        order = np.argsort(col, kind="stable")
        starts = np.concatenate(([0], np.cumsum(per_term)))
        rare = ~common[at]
        r, a = row[rare], at[rare]
        m = per_term[a]
        flat = order[np.repeat(starts[a] - np.concatenate(([0], np.cumsum(m)))[:-1], m) + np.arange(m.sum())] if len(a) else np.zeros(0, np.int64)
        if len(flat):
            out += np.bincount(own[flat] * len(ids) + np.repeat(r, m), weights=qw[flat] * np.repeat(f[rare], m), minlength=out.size).reshape(out.shape)
        if wq.shape[1]:
            r, a, v = row[~rare], place[at[~rare]], f[~rare]
            step = max(1, 4_000_000 // wq.shape[1])
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                x0, x1 = np.searchsorted(r, (lo, hi))
                d = np.zeros((hi - lo, wq.shape[1]))
                d[r[x0:x1] - lo, a[x0:x1]] = v[x0:x1]
                out[:, lo:hi] += wq @ d.T
        return qids, column(ids), np.where(out > 0, out, -np.inf)

    got = best_of_blocks(left, right, k, score, types[0], types[1])
    return got.select(F.col("qid").alias(q), F.col("id").alias(key), "score", "rank")
