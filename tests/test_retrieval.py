import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvina.functions import vectors
from corvina.functions.text import mining_tokens, tokenize_code
from corvina.functions.tokens import CodeTokens, MiningTokens
from corvina.operators import calibration, evaluation, fusion, lexical, mining


def bm25(spark, scratch, weights=None):
    c = spark.createDataFrame([("a", "def binary_search(items): pass"), ("b", "def quicksort(items): pass")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "binary search"), (2, "missing term"), (3, None)], "query_id bigint, query string")
    i = lexical.build(c, CodeTokens(), scratch)
    return lexical.search(lexical.query_terms(q, CodeTokens()), i, 5, scratch, weights=weights).collect()


def test_bm25_goldens(spark, scratch):
    (r,) = bm25(spark, scratch)
    assert r["doc_id"] == "a" and r["score"] == pytest.approx(1.271830, abs=1e-6)
    assert bm25(spark, scratch, lexical.CODE_WEIGHTS)[0]["score"] == pytest.approx(2.050731, abs=1e-6)
    with pytest.raises(ValueError):
        lexical.search(None, None, 5, scratch, k1=-1)


def test_bm25_matches_brute_force(spark, scratch):
    rng = random.Random(4)
    word = lambda: rng.choice(["common", "def", f"w{rng.randint(0, 30)}", f"r{rng.randint(0, 400)}"])
    docs = [(f"d{i}", None if i % 17 == 0 else " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(150)]
    asks = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(40)]
    tok = {k: CodeTokens()(t) for k, t in docs}
    mean = sum(map(len, tok.values())) / len(docs)
    df = Counter(t for ts in tok.values() for t in set(ts))
    want = {}
    for q, t in asks:
        terms, s = set(CodeTokens()(t)), {}
        for k, ts in tok.items():
            hit = [math.log1p((len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * ts.count(x) * 2.5 / (ts.count(x) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for x in terms if x in ts]
            if hit:
                s[k] = sum(hit)
        want[q] = sorted(s, key=lambda k: (-round(s[k], 9), k))[:7]
    c = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    i = lexical.build(c, CodeTokens(), scratch)
    got = lexical.search(lexical.query_terms(spark.createDataFrame(asks, "query_id bigint, query string"), CodeTokens()), i, 7, scratch).collect()
    assert {q: [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q, _ in asks} == want
    none = lexical.build(c.limit(0), CodeTokens(), scratch)
    assert lexical.search(lexical.query_terms(spark.createDataFrame(asks, "query_id bigint, query string"), CodeTokens()), none, 7, scratch).count() == 0


def test_maintained_index_equals_rebuilt(spark, scratch):
    c = spark.createDataFrame([("a", "x y"), ("b", "y z"), ("c", "z")], "doc_id string, text string")
    up, gone = spark.createDataFrame([("a", "w w"), ("n", "y")], c.schema), spark.createDataFrame([("c",), ("unknown",)], "doc_id string")
    kept = lexical.maintain(lexical.build(c, CodeTokens(), scratch), gone, up, CodeTokens(), scratch)
    whole = lexical.build(spark.createDataFrame([("a", "w w"), ("n", "y"), ("b", "y z")], c.schema), CodeTokens(), scratch)
    for part in ("docs", "df", "stats"):
        a, b = getattr(kept, part), getattr(whole, part)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_python_tokens_equal_expressions(spark):
    texts = ["getHTTPResponse OAuth2Token is_valid ___ _x_ sha256 Sha256 où A1B2", "", None, "foo_foo __init__ XMLHttp2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize_code("t").alias("a"), mining_tokens("t").alias("b"))
    for r in df.collect():
        assert CodeTokens()(r["t"]) == r["a"] and MiningTokens()(r["t"]) == r["b"]


def test_top_k_blocks_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5)).round(1)
    m[7] = m[3]
    m[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<double>").repartition(5)
    got = vectors.top_k(df.filter("id < 8").withColumnRenamed("id", "qid"), df, 6, block=7).collect()
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in range(8):
        s = np.round(u @ u[q], 9)
        want = sorted(range(60), key=lambda i: (-s[i], i))[:6]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want
    assert vectors.top_k(df.limit(0).withColumnRenamed("id", "qid"), df, 3).count() == 0
    named = df.withColumn("id", F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")))  # text ids, in the same order
    text = vectors.top_k(df.filter("id < 8").withColumnRenamed("id", "qid"), named, 6, block=7).collect()
    assert sorted((r["qid"], int(r["id"][1:]), r["rank"]) for r in text) == sorted((r["qid"], r["id"], r["rank"]) for r in got)
    every = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 9) >= 0.5}
    assert {(r["qid"], r["id"]) for r in vectors.pairs_above(df, 0.5, block=7).collect()} == every
    lab = df.withColumn("label", F.when(F.col("id") % 5 > 0, F.col("id") % 5))
    best = {(r["qid"], r["label"]): r["id"] for r in vectors.best_per_label(df.filter("id < 8").withColumnRenamed("id", "qid"), lab, block=7).collect()}
    assert len(best) == 40 and all(b == min((i for i in range(60) if (i % 5 or None) == k), key=lambda i: (-np.round(u[i] @ u[q], 9), i)) for (q, k), b in best.items())


def test_maxsim_and_encoder(spark):
    q, docs = [[1.0, 0.0]], [("d1", [[1.0, 0.0]]), ("d2", [[0.5, 0.866]]), ("d3", [[0.0, 1.0]]), ("e", [])]
    df = spark.createDataFrame([(q, k, v) for k, v in docs], "q array<array<double>>, k string, d array<array<double>>")
    assert {r["k"]: r["s"] for r in df.select("k", vectors.maxsim(F.col("q"), F.col("d")).alias("s")).collect()} == {"d1": 1.0, "d2": 0.5, "d3": 0.0, "e": 0.0}
    r = vectors.maxsim_top_k(spark.createDataFrame([(1, q), (2, [])], "qid bigint, vs array<array<double>>"), df.select(F.col("k").alias("id"), F.col("d").alias("vs")), 2, block=2).orderBy("qid", "rank").collect()
    assert [(x["qid"], x["id"], x["score"]) for x in r] == [(1, "d1", 1.0), (1, "d2", 0.5), (2, "d1", 0.0), (2, "d2", 0.0)]
    t = spark.createDataFrame([(1, "ab"), (2, None)], "id bigint, text string")
    again = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "c")], "id bigint, text string")
    asked = []
    enc = lambda d: (asked.append(sorted(x["text"] for x in d.collect())), d.withColumn("v", F.array(F.length("text").cast("double"))))[1]
    _, cache = vectors.encode_once(again.filter("id < 4"), "text", enc)
    got, _ = vectors.encode_once(again, "text", enc, cache)
    assert asked == [["ab"], ["c"]] and {x["id"]: x["v"] for x in got.collect()} == {1: [2.0], 2: [2.0], 3: None, 4: [1.0]}
    assert [r["v"] for r in vectors.encode(t, "id", "text", lambda x: [[len(s), 1] for s in x], 2).orderBy("id").collect()] == [[2.0, 1.0], [0.0, 1.0]]


def rank(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, source string, doc_id string, score double, rank int")


def test_fusion_goldens(spark):
    r = rank(spark, [(1, "x", "a", 1.0, 1), (1, "x", "b", 0.9, 2), (1, "x", "a", 0.8, 3), (1, "y", "b", 1.0, 1), (1, "y", "c", 0.5, 2)])
    f = {x["doc_id"]: (x["rank"], x["score"]) for x in fusion.rrf(r, {}, 1).collect()}
    assert f["b"] == (1, pytest.approx(5 / 6)) and f["a"] == (2, 0.5) and f["c"][1] == pytest.approx(1 / 3)
    n = rank(spark, [(1, "x", k, v, i + 1) for i, (k, v) in enumerate([("d1", 1.0), ("d2", 2.0), ("d3", 3.0)])] + [(2, "x", "d", 5.0, 1)])
    got = n.select("query_id", "doc_id", fusion.min_max("score", ["query_id"]).alias("m"), fusion.z_score("score", ["query_id"]).alias("z")).collect()
    by = {(x["query_id"], x["doc_id"]): (x["m"], x["z"]) for x in got}
    assert by[1, "d1"] == (0.0, pytest.approx(-1.224745, abs=1e-6)) and by[1, "d2"] == (0.5, 0.0) and by[2, "d"] == (1.0, 0.0)


def test_calibration_goldens(spark):
    rows = [(q, "x", str(i), v, i + 1) for q, vs in enumerate([[6.0, -1.0, -2.0, -2.0], [0.01, 0.0, 0.0, -0.01], [2.0, 1.0, -1.0, -2.0], [1.0]]) for i, v in enumerate(vs)]
    got = {r["query_id"]: r for r in calibration.abstention(rank(spark, rows)).collect()}
    assert got[0]["variance"] == pytest.approx(0.995791, abs=1e-6) and not got[0]["should_abstain"]
    assert got[1]["should_abstain"] and got[2]["variance"] == pytest.approx(0.402603, abs=1e-6) and got[3]["should_abstain"]
    r = rank(spark, [(1, "x", "a", 0.85, 1), (1, "x", "b", 0.7, 2), (2, "x", "a", 0.8, 1), (2, "x", "b", 0.78, 2), (3, "x", "a", 0.1, 1)])
    assert {x["query_id"]: x["decision"] for x in calibration.route(r, 0.05).collect()} == {1: "fast_path", 2: "escalated", 3: "fast_path"}
    p = spark.createDataFrame([(0.1, 0), (0.9, 1)], "p double, y int")
    assert calibration.ece(p).first()["ece"] == pytest.approx(0.1)
    assert calibration.ece(p.limit(0)).first()["ece"] == 0.0
    z = spark.createDataFrame([(float(x), int(x + e > 0)) for x in range(-5, 6) for e in (-1.5, 0, 1.5)], "z double, y int")
    assert 0.05 <= calibration.fit_temperature(z) <= 10
    with pytest.raises(ValueError):
        calibration.temperature_softmax(r, 0)
    v = spark.range(200).withColumn("v", F.when(F.col("id") > 0, (F.col("id") % 10).cast("double"))).withColumn("g", F.col("id") % 2)
    b = calibration.bootstrap(v, ["v"], "id", rounds=200).first()
    assert b["low"] < b["mean"] < b["high"] and b["n"] == 199 and b["std"] == pytest.approx(2.87 / math.sqrt(199), rel=0.2)
    assert {r["g"] for r in calibration.bootstrap(v, ["v"], "id", ["g"], 20).collect()} == {0, 1} and calibration.bootstrap(v.limit(0), ["v"], "id").count() == 0
    assert calibration.median(v, "v").first()["median"] == 5.0 and calibration.median(v.limit(0), "v").first()["median"] is None


def test_rerank_scorer_and_cache(spark, scratch):
    r = rank(spark, [(1, "x", str(i), float(-i), i) for i in range(1, 23)])
    got = calibration.rerank(r, F.col("rank").cast("double")).orderBy("new_rank").collect()
    assert [x["rank"] for x in got] == [*range(20, 0, -1), 21, 22] and got[-1]["rerank_score"] is None
    pairs = spark.createDataFrame([("q", "a", "xx"), ("q", "b", "yyy"), ("q", "b", "yyy")], "query string, doc_id string, text string")
    cache = spark.createDataFrame([("q", "a", 9.0)], "query string, doc_id string, rerank_score double")
    scored, known = calibration.with_cache(pairs, cache, lambda ps: [len(t) for _, t in ps], scratch)
    assert sorted((x["doc_id"], x["rerank_score"]) for x in scored.collect()) == [("a", 9.0), ("b", 3.0), ("b", 3.0)] and known.count() == 2

    def never(_):
        raise AssertionError("scored again")

    assert calibration.with_cache(pairs, known, never, scratch)[0].count() == 3


def test_cascade_reranks_escalated_lists_only(spark):
    r = rank(spark, [(1, "x", "a", 0.9, 1), (1, "x", "b", 0.5, 2), (2, "x", "a", 0.8, 1), (2, "x", "b", 0.79, 2), (3, "x", "a", 0.1, 1)])
    seen = lambda rows: rows.withColumn("rerank_score", F.when(F.col("query_id") != 2, F.raise_error(F.lit("a sure list was scored")).cast("double")).otherwise(F.col("rank").cast("double")))
    got = {(x["query_id"], x["doc_id"]): (x["decision"], x["new_rank"]) for x in calibration.cascade(r, seen, 0.05).collect()}
    assert got == {(1, "a"): ("fast_path", 1), (1, "b"): ("fast_path", 2), (2, "b"): ("escalated", 1), (2, "a"): ("escalated", 2), (3, "a"): ("fast_path", 1)}
    d = r.withColumn("dense_score", F.when(F.col("query_id") == 2, F.col("score") * F.col("rank")))
    assert {x["query_id"]: round(x["margin"], 6) for x in calibration.margins(d).collect()} == {1: 0.4, 2: 0.0, 3: float("inf")}


def test_truncation(spark):
    class Words:
        def encode(self, t):
            return t.split()

        def decode(self, ids):
            return " ".join(ids)

    long = " ".join(["word"] * 300)
    df = spark.createDataFrame([("q " * 20, long), ("q", "short"), ("q " * 60, long), (None, None)], "q string, t string")
    got = df.select(calibration.truncate_pair(F.col("q"), F.col("t")).alias("a"), calibration.truncate_pair_tokens("q", "t", Words, 50).alias("b")).collect()
    assert [len(r["a"] or "") for r in got] == [1499, 5, 1499, 0] and [r["b"] and len(r["b"].split()) for r in got] == [27, 1, 1, None] and got[2]["b"] == "w"


def test_metrics(spark):
    rk = spark.createDataFrame([(1, 2), (2, None), (3, 11)], "query_id bigint, rank int")
    m = evaluation.evaluate(rk).first()
    assert m["mrr"] == pytest.approx(0.5 / 3) and m["ndcg"] == pytest.approx(1 / math.log2(3) / 3) and m["recall_1"] == 0 and m["recall_5"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        evaluation.guard_split("data/x", "test")
    assert evaluation.latency(lambda q: q, [1, 2, 3])["n"] == 3


def test_pairs_and_negatives(spark):
    docs = spark.createDataFrame([(1, "t", "x", None), (2, None, "", "b")], "doc_id bigint, title string, text string, body string")
    assert {r["doc_id"]: r["text"] for r in mining.ingest(docs).collect()} == {1: "t\nx", 2: "b"}
    with pytest.raises(Exception, match="repeated id"):
        mining.ingest(docs.union(docs)).collect()
    r = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("abcd")], "query_id bigint, doc_id string, rank int")
    c = spark.createDataFrame([("a", "p"), ("b", " p "), ("c", "n"), ("d", "m")], "doc_id string, text string")
    pos = spark.createDataFrame([(1, "a")], "query_id bigint, doc_id string")
    assert [x["doc_id"] for x in mining.hard_negatives(r, pos, c, 2).orderBy("place").collect()] == ["c", "d"]
    alone = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (2, "a")], "query_id bigint, doc_id string")
    spare = {(x["query_id"], x["doc_id"], x["place"]) for x in mining.hard_negatives(r, alone, c, 2).collect()}
    assert spare == {(1, "b", 1), (2, "b", 1)} and mining.hard_negatives(r, alone, c, 2, fallback=False).count() == 0


def test_compare(spark):
    m = spark.createDataFrame([(0.5, 0.0)], "mrr double, ndcg double"), spark.createDataFrame([(0.6, 0.1)], "mrr double, ndcg double")
    assert {r["metric"]: (round(r["delta"], 6), r["percent"] and round(r["percent"], 6)) for r in evaluation.compare(*m, ["mrr", "ndcg"]).collect()} == {"mrr": (0.1, 20.0), "ndcg": (0.1, None)}
