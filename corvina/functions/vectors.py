"""Vector expressions (V1, V2) and the block matrix products behind exact search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvina.functions.blocks import best_of_blocks, column
from corvina.runtime import Scratch

DIM = 64


def doubles(c: Column | str) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalize(c: Column | str) -> Column:
    """V2. Unit length; a zero vector stays zero."""
    v = doubles(c)
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def packed(df: DataFrame, key: str, block: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(ids, m, also): unit vectors of rows (key, v, also) in blocks of at most ``block`` rows; null keys and vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                s = b.slice(at, block)
                m = np.asarray(s.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(s.num_rows, -1)
                m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
                lists = [pa.array([s.column(i).to_pylist()], pa.list_(s.column(i).type)) for i in (0, *range(2, 2 + len(also)))]
                yield pa.RecordBatch.from_arrays([lists[0], pa.array([m.tobytes()]), *lists[1:]], names=["ids", "m", *also])

    rows = df.select(F.col(key).alias("key"), doubles("v").alias("v"), *also).filter("key IS NOT NULL AND v IS NOT NULL")
    t = dict(rows.dtypes)
    return rows.mapInArrow(run, f"ids array<{t['key']}>, m binary" + "".join(f", `{c}` array<{t[c]}>" for c in also))


def _products(qm: bytes, n: int, cm: bytes, k: int) -> np.ndarray:
    q, c = np.frombuffer(qm).reshape(n, -1), np.frombuffer(cm).reshape(k, -1)
    return np.round(q @ c.T, 9) + 0.0


def top_k(queries: DataFrame, corpus: DataFrame, k: int | None, block: int = 2048) -> DataFrame:
    """(qid, id, score, rank): the k corpus rows (all if k is None) of highest cosine for each query, ties by id ascending.

    queries (qid, v) and corpus (id, v), ids integers or texts, are packed into blocks; pairs of blocks, not of rows, are joined, and
    each is one matrix product. Neither side is broadcast or collected. Null vectors are left out; scores are rounded to
    9 places before ranking, so that the order does not hang on the order of addition."""
    a = packed(queries, "qid", block).select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    b = packed(corpus, "id", block).repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    qt, ct = dict(queries.dtypes)["qid"], dict(corpus.dtypes)["id"]
    if k is not None:
        return best_of_blocks(a, b, k, lambda x, y: (x[0], column(y[0]), _products(x[1], len(x[0]), y[1], len(y[0]))), qt, ct)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qm, ci, cm in zip(*(c.to_pylist() for c in batch.columns)):
                s = _products(qm, len(qi), cm, len(ci))
                yield pa.RecordBatch.from_arrays([pa.array([q for q in qi for _ in ci], batch.schema.field(0).type.value_type), pa.array(ci * len(qi), batch.schema.field(2).type.value_type), pa.array(s.ravel())], names=["qid", "id", "score"])

    every = a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(product, f"qid {qt}, id {ct}, score double")
    return every.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))


def pairs_above(df: DataFrame, tau: float, block: int = 2048) -> DataFrame:
    """(qid, id, score) of all pairs of rows (id, v) of which the cosine, rounded to 9 places, reaches tau; qid < id.

    Each pair of blocks is multiplied once, and only what reaches tau leaves the product. Ids are taken as unique."""
    t = dict(df.dtypes)["id"]
    b = packed(df, "id", block).withColumn("name", F.array_min("ids")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qm, ci, cm in zip(*(c.to_pylist() for c in batch.columns)):
                s = _products(qm, len(qi), cm, len(ci))
                x, y = np.nonzero(s >= tau)
                got = [(*sorted((qi[i], ci[j])), v) for i, j, v in zip(x.tolist(), y.tolist(), s[x, y].tolist()) if (qi[i] < ci[j] if qi == ci else qi[i] != ci[j])]
                q, d, v = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, batch.schema.field(0).type.value_type), pa.array(d, batch.schema.field(0).type.value_type), pa.array(v, pa.float64())], names=["qid", "id", "score"])

    x, y = b.select(F.col("ids").alias("i"), F.col("m").alias("n"), F.col("name").alias("first")), b
    pairs = x.hint("shuffle_replicate_nl").join(y, F.col("first") <= F.col("name")).select("i", "n", "ids", "m")
    return pairs.mapInArrow(product, f"qid {t}, id {t}, score double")


def _near(q: np.ndarray, c: np.ndarray, tau: float, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the rows of q and c of which the product, rounded to 9 places, reaches tau, a tile of q at a time. Single
    precision tells all but those within its error of tau; these are multiplied again in double precision."""
    q4, c4 = q.astype(np.float32), c.astype(np.float32).T
    far = (q.shape[1] + 8) * 2.0**-23 + 1e-9
    for at in range(0, len(q), tile):
        s = q4[at : at + tile] @ c4
        x, y = np.divmod(np.flatnonzero(s.ravel() >= np.float32(tau - far)), len(c))
        sure = s[x, y] > np.float32(tau + far)
        near = np.flatnonzero(~sure)
        for k in range(0, len(near), 1 << 15):
            i = near[k : k + (1 << 15)]
            sure[i] = np.round((q[at + x[i]] * c[y[i]]).sum(1), 9) >= tau
        yield at + x[sure], y[sure]


def _unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """up, the root of each place, after the places a were joined with the places b; a root is the smallest of its places."""
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return up
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        up[b] = a  # one of several; the others are apart still in the next turn
        while (up[up] != up).any():
            up = up[up]


def joined_above(df: DataFrame, tau: float, scratch: Scratch, block: int = 5000) -> DataFrame:
    """(a, b): pairs that join the same rows (id, v) into groups as all of ``pairs_above`` would, directly or over others, but not more
    of them than rows in each task.

    Of equal vectors only the one of smallest id is multiplied. All others are, each pair of blocks once; a task keeps the groups
    of its rows and returns one pair for each row, with its group's first. The blocks are written, so that both sides of the product have the same ones."""
    t = dict(df.dtypes)["id"]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, m in zip(*(c.to_pylist() for c in b.columns)):
                u = np.frombuffer(m).reshape(len(ids), -1) + 0.0
                same = np.round((u * u).sum(1), 9) >= tau  # a zero vector is not near itself
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type.value_type), pa.array([hashlib.sha256(x.tobytes()).digest() if ok else None for x, ok in zip(u, same.tolist())], pa.binary())], names=["id", "key"])

    keyed = scratch.keep(packed(df, "id", block).mapInArrow(key, f"id {t}, key binary"))
    first = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    twins = scratch.keep(keyed.join(first, "key").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    alone = df.select("id", "v").join(twins.select(F.col("b").alias("id")), "id", "left_anti") if twins.take(1) else df.select("id", "v")
    blocks = scratch.keep(packed(alone, "id", block).withColumn("no", F.monotonically_increasing_id()))
    n = blocks.count()
    parts = max(1, min(n, 16), -(-n // 4))  # 16 pairs of blocks a task, or fewer

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, up, types = {}, [], np.zeros(0, np.int64), pa.int64()
        for batch in batches:
            types = batch.schema.field(1).type.value_type
            for r in range(batch.num_rows):
                no, ids, m, no2, ids2, m2 = (batch.column(i)[r] for i in range(6))
                for k, v in ((no.as_py(), ids), (no2.as_py(), ids2)):
                    if k not in at:
                        at[k] = len(up)
                        names.append(v.values)
                        up = np.concatenate([up, np.arange(len(up), len(up) + len(v.values))])
                q, c = (np.frombuffer(x.as_buffer()).reshape(len(y.values), -1) for x, y in ((m, ids), (m2, ids2)))
                for x, y in _near(q, c, tau):
                    up = _unite(up, at[no.as_py()] + x, at[no2.as_py()] + y)
        if len(rest := np.flatnonzero(up != np.arange(len(up)))):
            every = pa.chunked_array(names).combine_chunks()
            yield pa.RecordBatch.from_arrays([every.take(pa.array(up[rest])).cast(types), every.take(pa.array(rest)).cast(types)], names=["a", "b"])

    x = blocks.select("no", "ids", "m").repartitionByRange(parts, "no")  # so that almost half of the pairs of parts are empty
    y = x.toDF("no2", "ids2", "m2")
    pairs = x.hint("shuffle_replicate_nl").join(y, F.col("no") <= F.col("no2"))
    return pairs.mapInArrow(product, f"a {t}, b {t}").unionByName(twins)


def best_per_label(queries: DataFrame, corpus: DataFrame, block: int = 2048) -> DataFrame:
    """V13. (qid, label, id, score): of corpus rows (id, v, label) the one of highest cosine for each query and label, ties by id.

    A block leaves one row per query and label. Null labels are one label."""
    a = packed(queries, "qid", block).select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    b = packed(corpus, "id", block, ("label",)).repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = {"qid": dict(queries.dtypes)["qid"], "id": dict(corpus.dtypes)["id"], "label": dict(corpus.dtypes)["label"]}

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(i).type.value_type for i in (0, 4, 2)]
            for qi, qm, ci, cm, labels in zip(*(c.to_pylist() for c in batch.columns)):
                order = sorted(range(len(ci)), key=lambda i: (labels[i] is None, labels[i], ci[i]))
                s = _products(qm, len(qi), cm, len(ci))[:, order]
                starts = [k for k, i in enumerate(order) if k == 0 or labels[i] != labels[order[k - 1]]]
                top = np.maximum.reduceat(s, starts, axis=1)
                width = np.diff([*starts, len(order)])
                first = np.minimum.reduceat(np.where(s == np.repeat(top, width, axis=1), np.arange(len(order)), len(order)), starts, axis=1)
                cols = [[q for q in qi for _ in starts], [labels[order[k]] for k in starts] * len(qi), [ci[order[k]] for k in first.ravel().tolist()]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, x) for c, x in zip(cols, types)), pa.array(top.ravel())], names=["qid", "label", "id", "score"])

    every = a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(product, f"qid {t['qid']}, label {t['label']}, id {t['id']}, score double")
    g = every.groupBy("qid", "label").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("x"))
    return g.select("qid", "label", F.col("x.id").alias("id"), "score")


def maxsim_top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = 512) -> DataFrame:
    """V6. (qid, id, score, rank): the k texts of highest MaxSim for each query, ties by id; queries (qid, vs), corpus (id, vs) with the
    token vectors of each. A block product gives all token pairs; maxima are taken per text and summed per query. A query or text
    without tokens scores 0."""

    def pack(df: DataFrame, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, block):
                    s = b.slice(at, block)
                    n = np.array([len(x) for x in s.column(1).to_pylist()], np.int64)
                    m = np.asarray(s.column(1).flatten().flatten().to_numpy(zero_copy_only=False), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([s.column(0).to_pylist()], pa.list_(s.column(0).type)), pa.array([n.tobytes()]), pa.array([m.tobytes()])], names=["ids", "n", "m"])

        rows = df.select(F.col(key).alias("key"), F.coalesce(F.col("vs").cast("array<array<double>>"), F.array().cast("array<array<double>>")).alias("vs")).filter("key IS NOT NULL")
        return rows.mapInArrow(run, f"ids array<{dict(rows.dtypes)['key']}>, n binary, m binary")

    def score(x: tuple, y: tuple) -> tuple[list, np.ndarray, np.ndarray]:
        (qi, qn, qm), (ci, cn, cm) = x, y
        qn, cn = np.frombuffer(qn, np.int64), np.frombuffer(cn, np.int64)
        out = np.zeros((len(qi), len(ci)))
        if qn.sum() and cn.sum():
            q, c = np.frombuffer(qm).reshape(qn.sum(), -1), np.frombuffer(cm).reshape(cn.sum(), -1)
            some_q, some_c = np.flatnonzero(qn), np.flatnonzero(cn)
            starts = lambda n: np.concatenate(([0], np.cumsum(n)[:-1]))
            best = np.maximum.reduceat(q @ c.T, starts(cn[some_c]), axis=1)
            out[np.ix_(some_q, some_c)] = np.add.reduceat(best, starts(qn[some_q]), axis=0)
        return qi, column(ci), np.round(out, 9) + 0.0

    a = pack(queries, "qid").toDF("q_ids", "q_n", "q_m")
    b = pack(corpus, "id").repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return best_of_blocks(a, b, k, score, dict(queries.dtypes)["qid"], dict(corpus.dtypes)["id"])


def hash_encode(texts: DataFrame, key: str, text: str, tokens: Callable[[str | None], list[str]], dim: int = DIM) -> DataFrame:
    """V1 stand-in. (key, v): counts of a text's tokens by bucket of their MD5, signed, unit length; texts without tokens have no row.

    A trained encoder may take its place through ``encode``. A term is hashed once per worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ts = tokens(t)
                if not ts:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                for x in set(ts):
                    if x not in seen:
                        h = hashlib.md5(x.encode()).hexdigest()
                        seen[x] = (int(h[:4], 16) % dim) * 2 + (int(h[4], 16) >= 8)
                n = np.bincount([seen[x] for x in ts], minlength=2 * dim)
                at.append(i), rows.append((n[::2] - n[1::2]).astype(np.float64))
            m = np.array(rows).reshape(-1, dim)
            m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim), pa.array(m.ravel()))], names=[key, "v"])

    rows = texts.select(key, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, v array<double>")


def encode_once(texts: DataFrame, text: str, encode: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V5. (texts with a column v, cache afterwards): each distinct text is encoded once, and not at all where cache (text, v) has it.

    encode takes (text) rows and gives (text, v). The cache grows by what was encoded; the caller keeps it as a table."""
    asked = texts.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    todo = asked.join(cache.select("text"), "text", "left_anti") if cache is not None else asked
    fresh = encode(todo).select("text", "v")
    known = cache.select("text", "v").unionByName(fresh) if cache is not None else fresh
    return texts.join(known.withColumnRenamed("text", text), text, "left"), known


def encode(texts: DataFrame, key: str, text: str, encoder, dim: int) -> DataFrame:
    """V1, V15. (key, v) by a batch encoder list[str] -> (n, dim) array, made once per worker; a wrong row count is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.asarray(encoder(b.column(1).to_pylist()), np.float32).reshape(-1, dim)
            if len(m) != b.num_rows:
                raise ValueError(f"the encoder gave {len(m)} rows for {b.num_rows} texts")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim), pa.array(m.ravel()))], names=[key, "v"])

    rows = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, v array<float>")


def maxsim(q: Column, d: Column) -> Column:
    """V6. Sum over a query's token vectors of the highest dot product with a text's; 0 if either has none."""
    best = F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y))))
    return F.when((F.size(q) > 0) & (F.size(d) > 0), F.aggregate(best, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def centroid(df: DataFrame, key: str, vec: str) -> DataFrame:
    """V7. (key, v): the mean vector of each key at unit length; a zero mean stays zero."""
    p = df.select(key, F.posexplode(doubles(vec)).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return p.groupBy(key).agg(v.alias("v")).select(key, normalize("v").alias("v"))
