import json
import random

import pytest
from pyspark.sql import functions as F

from corvina.functions import code_meta
from corvina.operators import agentic, graph, versioning
from corvina.sources import io
from corvina.streaming import maintain

JS = """function outer(a) {
  const inner = (x) => helper(x);
  first(a);
  obj.method(a);
  return `${skipped(a)}` + last(a);
}
class C { run(q) { go(q); } }
const arrow = async (y) => { await load(y); };
"""


def test_js_functions():
    got = {n: (a, b, c) for _, n, _, a, b, c in code_meta.js_functions(JS, "m.js")}
    assert got == {"outer": (1, 6, ["first", "last"]), "inner": (2, 2, ["helper"]), "run": (7, 7, ["go"]), "arrow": (8, 8, ["load"])}
    assert "obj.method" in code_meta.js_functions(JS, "m.js", True)[0][5]
    tricky = "const clean = (s) => s.replace(/[\"'(\\/]{2}/g, mark(s));\nfunction half(a) { return walk(a) / 2 / rest(a); } // a / b\nfunction test(s) { return /\\/x(/.test(s) || last(s); }\n"
    assert {n: c for _, n, _, _, _, c in code_meta.js_functions(tricky, "m.js")} == {"clean": ["mark"], "half": ["walk", "rest"], "test": ["last"]}
    assert code_meta.js_functions("", "m.js") == [] and code_meta.js_functions("function (", "m.js") == []


def test_python_prefix(spark):
    df = spark.createDataFrame([(1, 'def f(a, b):\n    """Adds."""\n    return g(a)\n'), (2, "def broken(x:\n"), (3, None), (4, "class A(:\n def q(z) return")], "id bigint, code string")
    got = {r["id"]: r["p"] for r in code_meta.enrich_python(df, "id", "code").select("id", code_meta.structural_prefix().alias("p")).collect()}
    assert got[1] == "# SUMMARY: Adds.\n# SIGNATURE: f(a, b)\n# CALLS: g\n" and got[3] == "" and "# CLASSES: A" in got[4]


def test_python_metadata():
    m = code_meta.python_metadata('class A:\n    """Of the class."""\n    def run(self, x):\n        """Runs.\n\n        More."""\n        zeta(x)\n        return alpha(self.beta())\ndef top(y): pass\n')
    assert m == {"functions": ["top(y)", "run(x)"], "classes": ["A"], "docstring": "Runs.", "calls": ["alpha", "beta", "zeta"]}
    assert code_meta.python_metadata("def f(self, a):\n  g(a")["functions"] == ["f(self, a)"]
    assert code_meta.python_metadata("x = 1\n")["docstring"] == "" and code_meta.python_metadata(" ")["calls"] == []


def functions(spark):
    rows = [("auth.js:login", "login", ["validateToken", "nothing"]), ("auth.js:validateToken", "validateToken", ["checkExpiry", "validate"]), ("auth.js:checkExpiry", "checkExpiry", None), ("auth.js:validate", "validate", []), ("utils.js:validate", "validate", ["auth.js:login"])]
    return spark.createDataFrame([(n, s, n.split(":")[0], c) for n, s, c in rows], "name string, short_name string, file string, calls array<string>")


def test_call_graph(spark, scratch):
    f = functions(spark)
    e = graph.call_edges(f)
    assert e.count() == 5 and [tuple(r) for r in graph.ambiguous(f).collect()] == [("validate", 2)]
    src = spark.createDataFrame([("auth.js:login",)], "source string")
    reach = {(r["node"], r["depth"]) for r in graph.reachable(e, src, 2, scratch).collect()}
    assert reach == {("auth.js:validateToken", 1), ("auth.js:checkExpiry", 2), ("auth.js:validate", 2), ("utils.js:validate", 2)}
    p = graph.shortest_paths(e, spark.createDataFrame([("auth.js:login", "auth.js:checkExpiry"), ("auth.js:checkExpiry", "auth.js:login")], "source string, target string"), 3).collect()
    assert [r["path"] for r in p] == ["auth.js:login -> auth.js:validateToken -> auth.js:checkExpiry"]
    assert graph.resolve(f, "login") == "auth.js:login" and graph.resolve(f, "zzz") is None
    with pytest.raises(ValueError):
        graph.resolve(f, "validate")


def test_meeting_paths_equal_shortest(spark, scratch):
    rng = random.Random(5)
    e = spark.createDataFrame([(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(60)], "src string, dst string")
    pairs = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(6) for b in range(26)], "source string, target string")
    for depth in (1, 4, 5):
        assert sorted(map(tuple, graph.meeting_paths(e, pairs, depth).collect())) == sorted(map(tuple, graph.shortest_paths(e, pairs, depth).collect()))


def test_meeting_paths_over_shared_names(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    short = lambda: rng.choice(["run", "load", "f1", "f2", "f3", "f4", "f5", None])
    rows = [(f"m{i}" if i % 9 else None, short(), [rng.choice(["run", "load", "f1", "f2", "f3", "m4", "none", None]) for _ in range(2)] if i % 5 else None) for i in range(40)]
    f = spark.createDataFrame(rows, "name string, short_name string, calls array<string>")
    e, links = graph.call_edges(f), graph.call_links(f)
    assert sorted(map(tuple, links[0].join(links[1], "call").select("src", "dst").distinct().collect())) == sorted(tuple(r) for r in e.distinct().collect() if None not in tuple(r))
    starts = spark.createDataFrame([("m1",), ("m2",), ("m4",), ("m38",)], "source string")
    every = starts.crossJoin(spark.createDataFrame([(f"m{i}",) for i in range(40)], "target string"))
    for depth in (0, 2, 3):
        want = sorted(map(tuple, graph.shortest_paths(e, every, depth).collect()))
        assert sorted(map(tuple, graph.meeting_paths(links, every, depth).collect())) == want
        assert sorted(map(tuple, graph.meeting_paths(links, starts, depth).collect())) == [r for r in want if r[0] != r[1]]

    # 400 functions of one short name that all call it: 160,000 edges, none of which is written
    from corvina.plans import registry

    kept = []

    class Counting(registry.Scratch):
        def keep(self, df):
            out = super().keep(df)
            kept.append(out.count())
            return out

    monkeypatch.setattr(registry, "Scratch", Counting)
    spark.range(400).selectExpr("id AS func_id", "concat('f', id) AS name", "'run' AS short_name", "array('run') AS calls").write.parquet(str(tmp_path / "parsed_functions.parquet"))
    got = registry.queries()["G8_meeting_paths"](spark, str(tmp_path))
    assert got.count() == 8 * 399 and got.filter("length <> 1").count() == 0 and max(kept) <= 800


def test_pagerank_and_communities(spark, scratch):
    e = spark.createDataFrame([("a", "db:connect"), ("b", "db:connect"), ("c", "db:connect"), ("c", "stripe:api")], "src string, dst string")
    f = spark.createDataFrame([(x,) for x in "abc"], "name string")
    r = {x["node"]: x["rank"] for x in graph.pagerank(e, graph.nodes_of(f, e), scratch).collect()}
    assert r["db:connect"] == pytest.approx(0.413906, abs=1e-4) and r["stripe:api"] == pytest.approx(0.188742, abs=1e-4) and sum(r.values()) == pytest.approx(1)
    more = {x["node"]: x["rank"] for x in graph.pagerank(e, graph.nodes_of(f.union(spark.createDataFrame([("alone",)], "name string")), e), scratch).collect()}
    assert len(more) == 6 and more["alone"] == pytest.approx(more["a"]) and sum(more.values()) == pytest.approx(1)
    stars = spark.createDataFrame([("h1", "x"), ("h1", "y"), ("h2", "z"), ("h2", "w")], "src string, dst string")
    c = {x["node"]: x["community"] for x in graph.communities(stars, graph.nodes_of(spark.createDataFrame([("h1",), ("h2",), ("lone",)], "name string"), stars), scratch).collect()}
    assert c == {"h1": "h1", "x": "h1", "y": "h1", "h2": "h2", "z": "h2", "w": "h2", "lone": "lone"}
    assert graph.pagerank(e.limit(0), graph.nodes_of(f.limit(0), e.limit(0)), scratch).count() == 0


def test_repository_questions(spark):
    f = spark.createDataFrame([("a.js", "const x = 1;\nuse(bluetoothDeeplink);\n"), ("tools/b.js", "let bluetoothDeeplink = 2;")], "path string, text string")
    got = agentic.usages(f, agentic.keywords("where is the bluetooth deeplink used")).orderBy(F.desc("score")).collect()
    assert [(r["path"], r["score"]) for r in got] == [("tools/b.js", 3.0), ("a.js", 1.0)]
    calls = spark.createDataFrame([("f", ["authTool.run", "z", "bluetoothTool.go"]), ("g", ["bluetoothTool", "authTool"]), ("h", None)], "name string, calls array<string>")
    a, b = agentic.call_order("which files call tool authTool before bluetoothTool?")
    assert [r["name"] for r in agentic.calls_before(calls, F.lit(a), F.lit(b)).collect()] == ["f"]
    assert agentic.validate_request({"query": " x "}) == ("x", 5)
    text = spark.createDataFrame([("src/f.js", "a\nfunction f() {\n  authTool();\n}\n")], "path string, text string")
    named = spark.createDataFrame([("f", "f.js", 2, 4, ["authTool", "bluetoothTool"])] * 2, "name string, file string, start_line int, end_line int, calls array<string>")
    row = agentic.ask(text, named, "which files call authTool before bluetoothTool").collect()
    assert [tuple(x)[:3] for x in row] == [("src/f.js", 2, 4)] and agentic.plan("how are they sorted")["intent"] == "semantic"
    bench = agentic.benchmark(text, named, [("which files call authTool before bluetoothTool", {"f.js"}), ("where is nothing used", {"f.js"})])
    assert [(b["precision"], b["recall"]) for b in bench] == [(1.0, 1.0), (0.0, 0.0)]
    for bad in ({"query": ""}, {"query": "x", "top_k": True}, {"query": "x", "top_k": 11}, []):
        with pytest.raises(ValueError):
            agentic.validate_request(bad)


def test_versions(spark, scratch, tmp_path):
    old = spark.createDataFrame([("u", "same"), ("c", "old"), ("r", "gone")], "doc_id string, text string")
    new = spark.createDataFrame([("u", "same"), ("c", "new"), ("n", "fresh")], "doc_id string, text string")
    enc = lambda t: t.select("doc_id", F.array(F.length("text").cast("float")).alias("v"))
    snap = versioning.Snapshots(spark, str(tmp_path / "ix"), "doc_id string, hash string, v array<float>")
    assert snap.read().count() == 0
    snap.write(versioning.update_index(snap.read(), old, enc)[0])
    index, status = versioning.update_index(snap.read(), new, enc)
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {"u": "unchanged", "c": "changed", "r": "removed", "n": "added"}
    snap.write(index)
    assert {r["doc_id"]: r["v"][0] for r in snap.read().collect()} == {"u": 4.0, "c": 3.0, "n": 5.0}
    broken = tmp_path / "ix" / "snapshot-3"  # a write that died: no mark of success
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert snap.read().count() == 3
    snap.write(snap.read())
    assert snap.numbers() == ([1, 2, 4], 4) and snap.read().count() == 3
    (broken / "_SUCCESS").write_bytes(b"")
    for n in (1, 2, 4):
        (tmp_path / "ix" / f"snapshot-{n}" / "_SUCCESS").unlink()
    with pytest.raises(Exception, match="Parquet"):  # a failing read is never taken for an empty index
        snap.read().collect()
    kept, purged, left = versioning.compact(old, spark.createDataFrame([("r",), ("r",), ("unknown",)], "doc_id string"))
    assert {r["doc_id"] for r in kept.collect()} == {"u", "c"} and purged.first()["purged"] == 1 and left.count() == 0
    import math

    v = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate((0, 0.25, 0.5, 2.0))], "id bigint, v array<double>")
    c = {r["id"]: r["cluster"] for r in versioning.clusters(v, versioning.near_pairs(v, 0.95), scratch).collect()}
    assert c == {0: 0, 1: 0, 2: 0, 3: 3}
    m = spark.createDataFrame([(0, 0, "long text"), (1, 0, "short"), (2, 2, "x")], "id bigint, cluster bigint, text string")
    assert {r["cluster"]: (r["canonical"], r["versions"]) for r in versioning.collapse(m).collect()} == {0: (1, [1, 0]), 2: (2, [2])}


def test_clusters_without_all_pairs(spark, scratch, tmp_path, monkeypatch):
    from corvina.functions import vectors
    from corvina.plans import registry

    rng = random.Random(6)
    rows = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 4, [0.0] * 4, [-0.0] * 4, None, [float("nan")] * 4, [float("nan")] * 4]
    ids = [f"v{(11 * i) % len(rows)}" for i in range(len(rows))]
    v = spark.createDataFrame([*zip(ids, rows), (None, rows[2])], "id string, v array<double>")
    for tau in (0.8, 0.97):
        want = {tuple(r) for r in versioning.clusters(v, versioning.near_pairs(v, tau), scratch).collect()}
        assert {tuple(r) for r in versioning.clusters(v, vectors.joined_above(v, tau, scratch, 5), scratch).collect()} == want

    import numpy as np

    m = np.random.default_rng(6).normal(size=(90, 8))
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    g = np.round(m @ m.T, 9)
    for tau in (0.4, float(g[3, 5]), float(g[80, 7]) + 1e-9):  # the last two are within the error of single precision of a product
        assert {(i, j) for x, y in vectors._near(m, m, tau, 16) for i, j in zip(x.tolist(), y.tolist())} == {*zip(*(k.tolist() for k in np.nonzero(g >= tau)))}

    # 200 equal vectors: 19,900 pairs, of which a chain is written and no more
    kept = []

    class Counting(registry.Scratch):
        def keep(self, df):
            out = super().keep(df)
            kept.append(out.count())
            return out

    monkeypatch.setattr(registry, "Scratch", Counting)
    spark.range(200).selectExpr("id AS vec_id", "array(1f, 2f) AS embedding", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["N6_clusters"](spark, str(tmp_path)).collect()
    assert {r["id"] for r in got} == set(range(200)) and {r["cluster"] for r in got} == {0} and max(kept) <= 400


def test_diffs(spark):
    d = "--- a/src/auth.py\n+++ b/src/auth.py\n@@ -10,3 +10,4 @@ def login\n context\n+added\n-removed\n same\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    rows = versioning.diff_lines(spark.createDataFrame([(1, d), (2, ""), (3, None)], "diff_id int, diff string")).collect()
    assert sorted((r["file_path"], r["line"]) for r in rows) == [("src/auth.py", 11), ("src/auth.py", 12)]
    ch = spark.createDataFrame([("auth:login", "src/auth.py", 10, 15), ("auth:other", "src/auth.py", 100, 900), ("no", "z", None, None)], "chunk_id string, file_path string, start_line int, end_line int")
    assert [r["chunk_id"] for r in versioning.impacted(spark.createDataFrame(rows), ch).collect()] == ["auth:login"]


def test_sources(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/sub/m.js").write_text(JS)
    (tmp_path / "src/skip.py").write_text("x")
    f = io.scan_sources(spark, str(tmp_path / "src"), "m*.js")
    assert [r["path"] for r in f.collect()] == ["sub/m.js"]
    (tmp_path / "src/a b+c.js").write_text("x")
    assert {r["path"] for r in io.scan_sources(spark, f"file://{tmp_path}/src/", "*.js").collect()} == {"sub/m.js", "a b+c.js"}
    import pyarrow as pa

    t = pa.table({"k": [1, 2, 3], "s": ["a", None, "c"]})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), t.schema) as w:
        w.write_table(t, max_chunksize=2)
    with pa.ipc.new_stream(str(tmp_path / "u.arrow"), t.schema) as w:
        w.write_table(t)
    for name in ("t.arrow", "u.arrow"):
        assert sorted(map(tuple, io.read_table(spark, str(tmp_path / name)).collect())) == [(1, "a"), (2, None), (3, "c")]
    (tmp_path / "bad.parquet").mkdir()
    (tmp_path / "bad.parquet" / "x.parquet").write_bytes(b"no table")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        io.first_available(spark, [str(tmp_path / "bad.parquet")], [("z", "z")])
    assert {r["doc_id"] for r in io.function_corpus(f).collect()} == {"sub/m.js:1:outer", "sub/m.js:2:inner", "sub/m.js:7:run", "sub/m.js:8:arrow"}
    df = spark.createDataFrame([("1", "a"), ("2", " ")], "doc_id string, text string")
    io.prepare(df, str(tmp_path / "t.parquet"))
    io.prepare(df.limit(0), str(tmp_path / "t.parquet"))
    assert io.inspect(io.read_table(spark, str(tmp_path / "t.parquet")))["rows"] == 2
    assert io.first_available(spark, [str(tmp_path / "none"), str(tmp_path / "t.parquet")], [("z", "z")]).count() == 1
    assert io.first_available(spark, [str(tmp_path / "none")], [("z", "z")]).first()["doc_id"] == "z"
    io.write_report({"a": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "doc_id string, text string, deleted boolean, seq bigint, ts timestamp"
    spark.createDataFrame([("a", "one", False, 1), ("a", "two", False, 2), ("b", "x", False, 1), ("c", "one # n", False, 1)], "doc_id string, text string, deleted boolean, seq bigint").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(src)
    snap = versioning.Snapshots(spark, str(tmp_path / "ix"), "doc_id string, hash string, v array<float>")
    enc = lambda t: t.select("doc_id", F.array(F.length("text").cast("float")).alias("v"))
    run = lambda: maintain.upsert_index(spark.readStream.schema(schema).parquet(src), snap, enc, str(tmp_path / "cp")).awaitTermination(60)
    run()
    assert {r["doc_id"]: r["v"][0] for r in snap.read().collect()} == {"a": 3.0, "b": 1.0, "c": 7.0}
    spark.createDataFrame([("b", None, True, 5)], "doc_id string, text string, deleted boolean, seq bigint").withColumn("ts", F.lit(None).cast("timestamp")).write.mode("append").parquet(src)
    run()
    assert {r["doc_id"] for r in snap.read().collect()} == {"a", "c"}
    q = maintain.unique_chunks(spark.readStream.schema(schema).parquet(src), "ts").writeStream.format("memory").queryName("u").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(60)
    assert spark.table("u").select("fp").distinct().count() == spark.table("u").count()
