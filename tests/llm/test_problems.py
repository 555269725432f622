import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import boundaries, formatting, keyed, mixing, neardup, overlap, packing, prefixes, residue, splits, textkit, topn


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_sim(x, y, size=3):
    sets = []
    for t in (x, y):
        w = textkit.words(t or "")
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    a, b = sets
    return len(a & b) / len(a | b) if a and b else 0.0


def program(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 200)) for _ in range(n))


# --- 1
def test_cuts_hold_limit_overlap_and_cover():
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice("ab .\n\t,ä😀") for _ in range(rng.randint(0, 900)))
        got = boundaries.cuts(t, 100, 20)
        assert got[0][0] == 0 and got[-1][1] == len(t) and all(b - a <= 100 for a, b in got)
        assert all(a2 == b1 - 20 for (_, b1), (a2, _) in zip(got, got[1:]))


def test_cuts_match_brute_force_and_prefer_strong_boundaries():
    rng = random.Random(2)
    for _ in range(30):
        t = "".join(rng.choice("ab c.\n") for _ in range(rng.randint(60, 400)))
        s, start, want = boundaries.strengths(t), 0, []
        while len(t) - start > 50:
            to = max(range(start + 25, start + 51), key=lambda p: (s[p], p))
            want.append((start, to))
            start = to - 5
        assert boundaries.cuts(t, 50, 5) == [*want, (start, len(t))]
    code = "def a():\n    return 1\n\ndef b():\n    return 2\n"
    assert boundaries.cuts(code, 30, 0)[0][1] == code.index("def b")


def test_cuts_of_a_text_longer_than_the_table():
    rng = random.Random(21)
    t = "".join(rng.choice("abcdef \n.") for _ in range(200_000))
    s, start, want = boundaries.strengths(t), 0, []
    while len(t) - start > 300:
        lo = start + 150
        to = lo + max(range(151), key=lambda p: (s[lo + p], p))
        want.append((start, to))
        start = to - 40
    assert boundaries.cuts(t, 300, 40) == [*want, (start, len(t))]


def test_split_oversized_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 10), (4, "y" * 11), (4, "y" * 11)], "piece_no bigint, text string")
    got = boundaries.split_oversized(df.withColumnRenamed("piece_no", "id"), "text", 10, 2, ["id"])
    assert Counter(r["id"] for r in got.collect()) == {4: 4}
    assert boundaries.split_oversized(df.limit(0).withColumnRenamed("piece_no", "id"), "text", 10, 2, ["id"]).count() == 0
    assert boundaries.split_oversized(df.withColumnRenamed("piece_no", "id"), "text", 10, 2, ["id"], True).count() == 6
    with pytest.raises(ValueError):
        boundaries.split_oversized(df, "text", 10, 5, [])


# --- 2
def test_top_n_matches_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", "hot", "hot", "hot", " ", None]), rng.choice([None, *"uvwxyz"]), rng.choice([1.0, 2.0, 2.0, float("nan"), None, -1.0])) for _ in range(400)]
    want = []
    best = {}
    for g, i, s in data:
        if g and g.strip() and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -9e9), s)
    for g in {g for g, _ in best}:
        want += [(g, i, s) for s, i in sorted(((s, i) for (h, i), s in best.items() if h == g), key=lambda x: (-x[0], x[1]))[:3]]
    df = spark.createDataFrame([(*r, 7) for r in data], "g string, i string, s double, extra int").repartition(5)
    assert rows(topn.top_n_per_group(df, "g", "i", "s", 3)) == sorted(want)
    assert topn.top_n_per_group(df.limit(0), "g", "i", "s", 3).count() == 0


# --- 3
def test_record_keys():
    k = textkit.record_key
    assert k("Foo_Bar (x)") == k("foobar\nX") != k("foobary")
    assert k('{"a": 1, "b": {"c": [1, 2], "d": null}}') == k('{"b":{"d":null,"c":[1,2]},"a":1}')
    assert k('{"a": [1, 2]}') != k('{"a": [2, 1]}')
    assert k("x.y = 1\nz: 2") == k("Z=2\n\nx.y : 1") != k("z=1\nx.y=2")
    assert k("a=1\nb=2") == k('{"b": 2, "a": 1}')
    assert k("one line = 1") != k("1 = one line")
    for blank in (None, "", " \n", "{}", "--- !!"):
        assert k(blank) is None
    assert k("{" * 5000) is None and k("é" * 100_000) is not None
    deep = lambda n, a, b: f'{{"x": 1, "y": [{{{a}, {b}}}]}}' if n == 0 else f'{{"x": {deep(0, a, b)}, "y": {n}}}'
    assert k(deep(1, '"p": 1', '"q": 2')) == k(deep(1, '"q": 2', '"p": 1')) != k(deep(1, '"q": 1', '"p": 2'))
    nest = lambda n, inner: '{"a": ' * n + inner + "}" * n
    assert k(nest(3000, '{"p": 1, "q": 2}')) == k(nest(3000, '{"q": 2, "p": 1}')) is not None
    assert k("[" * 3000 + "]" * 3000) is None and k(nest(10**5, "1")) is not None


@pytest.mark.parametrize("hot", [10**6, 3])
def test_copies(spark, hot, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_ROWS", hot)
    rng = random.Random(4)
    texts = ["a b", "A-b", "c", None, "", "{}", '{"x":1,"y":2}', '{"y":2,"x":1}'] + ["hot!"] * 6
    data = [(i, rng.choice(texts)) for i in range(200)]
    df = spark.createDataFrame(data, "id bigint, t string").repartition(3)
    first, want = {}, []
    for i, t in data:
        key = textkit.record_key(t)
        if key is not None:
            if key in first:
                want.append((first[key], i))
            first.setdefault(key, i)
    keys = formatting.record_keys(df, "id", "t").cache()
    assert rows(formatting.copies(keys)) == sorted(want)
    assert sum(r["copies"] for r in formatting.classes(keys).collect()) == sum(textkit.record_key(t) is not None for _, t in data)
    assert formatting.copies(keys.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_keyed_hot_equals_plain(spark, how):
    r = spark.createDataFrame([(i, [1, 1, 1, 2, None, 3][i % 6]) for i in range(90)], "id int, k int")
    a = r.filter("k < 3").groupBy("k").agg(F.count("*").alias("n"))
    assert Counter(rows(keyed.join_keyed(r, a, ["k"], "n", how, 0.01, 20).fillna(-1))) == Counter(rows(r.join(a, "k", how).fillna(-1)))


# --- 4
def test_near_duplicates_match_brute_force(spark, scratch):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = program(rng, rng.randint(30, 80)).split()
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(1, 5)):
                t[rng.randrange(len(t))] = "edited"
            texts.append(" ".join(t))
    texts += [texts[0].upper(), texts[0], None, "", "two words", "x y z", "X-y z", "same " * 50]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "pair_id bigint, code string").repartition(4)
    reps = {}
    for i, t in enumerate(texts):
        key = textkit.record_key(t)
        if key is not None:
            reps.setdefault(key, i)
    ids = sorted(reps.values())
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if brute_sim(texts[a], texts[b]) >= 0.7}
    got = {(r["id_a"], r["id_b"]): r["sim"] for r in neardup.near_duplicates(df, "pair_id", "code", scratch).collect()}
    assert set(got) == want and len(want) > 20
    assert all(abs(s - brute_sim(texts[a], texts[b])) < 1e-9 for (a, b), s in got.items())
    assert neardup.near_duplicates(df.limit(0), "pair_id", "code", scratch).count() == 0


def test_posterior_bounds_keep_true_pairs():
    rng = np.random.default_rng(6)
    table = neardup.least_matches(0.7, 1e-4)
    lost = 0
    for _ in range(3000):
        same = np.cumsum(rng.random(128) < 0.7)
        lost += any(same[n - 1] < m for n, m in table)
    assert lost / 3000 < 0.01 and table[-1][1] > 60


def test_a_band_that_many_unlike_texts_share(spark, scratch):
    """A common head puts thousands of unlike texts into the same bands; near pairs among them are found all the same."""
    rng = random.Random(22)
    licence = " ".join(f"licence{i}" for i in range(90))
    texts = [f"{licence} " + " ".join(f"own{i}x{rng.randint(0, 10**6)}" for _ in range(60)) for i in range(3000)]
    want = set()
    for i in range(40):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "edited"
        want.add((i, len(texts)))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(4)
    node = scratch.keep(neardup.nodes(df, "id", "t", 3).select("id", "n", "sig", "bands"))
    assert neardup.shared_bands(node).agg(F.max("members")).first()[0] > 500  # the crowd is there
    got = neardup.near_duplicates(df, "id", "t", scratch, hot=100)
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == want
    assert rows(got.select("id_a", "id_b")) == rows(neardup.near_duplicates(df, "id", "t", scratch, hot=10**9).select("id_a", "id_b"))


# --- 5
@pytest.mark.parametrize("hot", [10**6, 4])
def test_components_match_union_find(spark, scratch, hot, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_ROWS", hot)
    rng = random.Random(7)
    data = [(i + 10, rng.choice([None, " ", "hub"] + [f"q{rng.randint(0, 60)}"] * 6), rng.choice([None, "", f"c{rng.randint(0, 90)}", f"c{rng.randint(0, 90)}"])) for i in range(150)]
    data += [(1000 + i, f"z{i}", f"w{i}") for i in range(40)] + [(2000 + i, f"z{i + 1}", f"w{i}") for i in range(39)]  # a long chain
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, q, c in data:
        for k in (("q", q), ("c", c)):
            if k[1] and k[1].strip():
                a, b = find(("r", i)), find(k)
                up[a] = b
        find(("r", i))
    least = {}
    for i, *_ in data:
        least[find(("r", i))] = min(least.get(find(("r", i)), i), i)
    want = sorted((i, least[find(("r", i))]) for i, *_ in data)
    df = spark.createDataFrame(data, "pair_id bigint, q string, c string")
    groups = splits.connected(df, "pair_id", ("q", "c"), scratch).cache()
    assert rows(groups) == want
    put = splits.assign_splits(groups, {"train": 0.8, "valid": 0.1, "test": 0.1, "none": 0.0, "null": None})
    by = {}
    for r in put.collect():
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values()) and put.count() == len(data)
    assert splits.connected(df.limit(0), "pair_id", ("q", "c"), scratch).count() == 0


def test_split_shares(spark):
    g = spark.range(4000).select(F.col("id").alias("pair_id"), F.when(F.col("id") < 1300, 0).otherwise(F.col("id")).alias("group_id"))
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1), ("none", 0.0)], "split string, target_share double")
    for seed in map(str, range(5)):  # a third of all rows never lands in a split of a tenth
        put = splits.assign_splits(g, {"train": 0.8, "valid": 0.1, "test": 0.1, "none": 0.0}, seed)
        assert {r["split"] for r in put.filter("group_id = 0").select("split").distinct().collect()} == {"train"}
    got = {r["split"]: r for r in splits.split_shares(put, targets).collect()}
    assert abs(got["test"]["reached_share"] - 0.0675) < 0.02 and got["none"]["n_rows"] == 0 and got["train"]["largest_group"] == 1300 and sum(r["n_rows"] for r in got.values()) == 4000
    assert splits.split_shares(put.limit(0), targets).count() == 4 and splits.assign_splits(g.limit(0), {"a": 1.0}).count() == 0


def test_new_rows_move_no_other_group(spark):
    g = spark.range(3000).select(F.col("id").alias("pair_id"), F.col("id").alias("group_id"))
    more = g.unionByName(spark.range(3000, 4500).select(F.col("id").alias("pair_id"), (F.col("id") % 7).alias("group_id")))
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    a, b = ({r["group_id"]: r["split"] for r in splits.assign_splits(x, shares).collect()} for x in (g, more))
    assert len(a) == 3000 and a == b


# --- 6
def test_chunks_of_grain_one_are_windows():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    d, w = overlap.chunks(h, 3, 1)
    assert len(d) == len({tuple(h[i : i + 3]) for i in range(398)}) and (w == 1).all()
    d, w = overlap.chunks(h, 3, 6)
    assert 30 < len(d) < 120 and w.sum() <= 398
    e = h.copy()
    e[200] = 999  # an edit moves no cut but those beside it
    assert len(set(d) - set(overlap.chunks(e, 3, 6)[0])) <= 3
    assert len(overlap.chunks(h[:2], 3, 6)[0]) == 1 and overlap.chunks(h[:1], 3, 6)[1].tolist() == [1]


@pytest.mark.parametrize("block", [5000, 3])
def test_leakage_matches_brute_force(spark, scratch, block, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", block)  # 3: every class, key and shingle of some rows is split
    rng = random.Random(8)
    base = [program(rng, rng.randint(25, 60)) for _ in range(20)]

    def vary(t):
        w = t.split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = "changed"
        return " ".join(w) if rng.random() < 0.7 else " ".join(w).upper()

    pick = lambda: rng.choice([None, "", "a b"] + [vary(rng.choice(base)) for _ in range(5)] + [program(rng, 30)])
    data = [(i, rng.choice(["train", "train", "valid", None]), pick(), pick(), rng.choice([None, " ", f"d{rng.randint(0, 60)}"])) for i in range(120)]
    want, firsts = set(), ({}, {})
    for i, _, *texts, _ in data:
        for f in (0, 1):
            key = textkit.record_key(texts[f])
            if key is not None:
                firsts[f].setdefault(key, i)
    by = {r[0]: r for r in data}
    for a in data:
        for b in data:
            if a[0] < b[0] and (a[1] == "train") != (b[1] == "train"):
                hit = bool(a[4] and a[4].strip() and a[4] == b[4])
                for f in (0, 1):
                    x, y = textkit.record_key(a[2 + f]), textkit.record_key(b[2 + f])
                    if x is not None and y is not None:
                        hit |= x == y or brute_sim(by[firsts[f][x]][2 + f], by[firsts[f][y]][2 + f]) >= 0.7
                if hit:
                    want.add((a[0], b[0]))
    df = spark.createDataFrame(data, "pair_id bigint, split string, query string, code string, corpus_id string").repartition(4)
    k = overlap.Leakage(df, scratch)
    assert set(rows(k.pairs())) == want
    for r in k.near.collect():  # the fractions of a pair make up its similarity
        x, y = (by[r[c]][2 if r['field'] == 'query' else 3] for c in ('id_a', 'id_b'))
        assert brute_sim(x, y) == pytest.approx(1 / (1 / r['part_a'] + 1 / r['part_b'] - 1))
    assert {r['id'] for r in k.row_fractions().collect()} <= {r[0] for r in data if r[1] != 'train'}
    outside = {i for p in want for i in p if by[i][1] != "train"}
    assert {r["id"] for r in k.rows().collect()} == outside
    assert all((r["fraction"] is None) == (r["by"] == "corpus_id") and (r["fraction"] is None or 0.7 <= r["fraction"] <= 1) for r in k.rows().collect())
    assert all(0 < r["fraction"] <= 1 for r in overlap.overlap_fractions(k.shared).collect())
    assert overlap.Leakage(df.limit(0), scratch).pairs().count() == 0


def test_leakage_of_a_record_that_repeats_itself(spark, scratch):
    text = program(random.Random(13), 100)
    data = [(1, "train", None, text, None), (2, "test", None, " ".join([text] * 3), None), (3, "test", None, program(random.Random(14), 100), None)]
    df = spark.createDataFrame(data, "pair_id bigint, split string, query string, code string, corpus_id string")
    assert brute_sim(data[0][3], data[1][3]) >= 0.7 and rows(overlap.Leakage(df, scratch).pairs()) == [(1, 2)]


def test_fraction_of_copies_in_both_splits(spark, scratch):
    rng = random.Random(15)
    texts = [program(rng, 60) for _ in range(3)]
    part = " ".join(texts[0].split()[:30] + program(rng, 30).split())  # shares some chunks with the first
    data = [(0, "train", texts[0]), (1, "test", texts[0].upper()), (2, "train", texts[1]), (3, "test", texts[2]), (4, "train", "two words"), (5, None, "Two words"), (6, "test", part)] + [(10 + i, ["train", "test"][i % 2], "a hot text of six words") for i in range(20)]
    df = spark.createDataFrame([(i, s, None, t, None) for i, s, t in data], "pair_id bigint, split string, query string, code string, corpus_id string")
    got = {r["cid"]: r["fraction"] for r in overlap.overlap_fractions(overlap.Leakage(df, scratch).shared).collect()}
    assert set(got) == {0, 4, 6, 10} and got[0] == got[4] == got[10] == 1 and 0 < got[6] < 1


@pytest.mark.parametrize("most", [12, 40, 200])
def test_leakage_of_short_records_matches_brute_force(spark, scratch, most):
    rng = random.Random(16)
    data = []
    for i in range(300):
        w = program(rng, rng.randint(most // 8 + 4, most)).split()
        v = list(w)
        for _ in range(rng.randint(1, 2)):
            at = rng.choice([0, len(v) - 1, rng.randrange(len(v))])
            v[at : at + rng.randint(0, 1)] = ["edited"]
        data += [(2 * i, "train", " ".join(w), None, None), (2 * i + 1, "test", None if i % 50 == 0 else " ".join(v), None, None)]
    want = {(a[0], b[0]) for a in data[::2] for b in data[1::2] if a[0] < b[0] and brute_sim(a[2], b[2]) >= 0.7}
    want |= {(b[0], a[0]) for a in data[::2] for b in data[1::2] if b[0] < a[0] and brute_sim(a[2], b[2]) >= 0.7}
    df = spark.createDataFrame(data, "pair_id bigint, split string, query string, code string, corpus_id string").repartition(4)
    assert set(rows(overlap.Leakage(df, scratch).pairs())) == want and len(want) > 100


def test_crowded_shingles_are_counted_over_all_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 3)
    split, cells = [], prefixes.cells
    monkeypatch.setattr(prefixes, "cells", lambda df, *x: split.append(df) or cells(df, *x))
    ids = [r["id"] for r in spark.range(100).filter("xxhash64(id) % 2 <> 0").limit(16).collect()]  # of 20,016 rows none that a sample of every second has
    few = spark.createDataFrame([(x, ["train", "test"][i % 2], f"a b c d e f g h i j k l{i}") for i, x in enumerate(ids)], "pair_id bigint, split string, code string")
    many = few.unionByName(spark.range(1000, 21000).selectExpr("id AS pair_id", "'test' AS split", "string(null) AS code")).selectExpr("*", "string(null) AS query", "string(null) AS corpus_id")
    near = {(r["id_a"], r["id_b"]) for r in overlap.Leakage(many, scratch).near.collect()}
    assert near == {(a, b) for a in ids[::2] for b in ids[1::2]}
    a, b = (Counter((r["d"], r["p"]) for r in df.collect()) for df in split)  # each head is the last shingle, its own, and three of the same nine
    assert len(a) == 3 and {p for _, p in a} == {6} and a == b == Counter({x: 8 for x in a})
    counts = prefixes.frequencies(many.unionByName(few.selectExpr("*", "code AS query", "string(null) AS corpus_id")), ["query", "code"], 3)
    assert counts.sum() == 3 * 16 * 10 and sorted(counts[counts > 0].tolist())[-9:] == [48] * 9


# --- 7
def test_patterns_place_everything():
    rng = random.Random(9)
    for _ in range(20):
        h = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        found = packing.patterns(h, 64)
        placed = Counter()
        for n, p in found:
            assert n > 0 and sum(k * v for k, v in p.items()) <= 64
            for k, v in p.items():
                placed[k] += n * v
        assert placed == Counter(h)
    assert packing.patterns({}, 8) == []


def test_pack(spark, scratch):
    rng = random.Random(10)
    data = [(i, rng.choice([None, "", "!!", "w " * rng.randint(1, 30), "w " * 7])) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    got = packing.pack(df, "doc_id", "text", 10, scratch, 3).collect()
    n = {i: len((t or "").split()) if t != "!!" else 0 for i, t in data}
    per, full = Counter(), Counter()
    for r in got:
        per[r["doc_id"]] += r["tokens"]
        full[r["container"]] += r["tokens"]
    assert per == Counter({i: x for i, x in n.items() if x}) and max(full.values()) <= 10
    pieces = Counter(r["doc_id"] for r in got)
    assert all(pieces[i] == -(-x // 10) for i, x in n.items() if x)
    assert len(full) <= 1.15 * sum(n.values()) / 10 + 1
    assert packing.pack(df.limit(0), "doc_id", "text", 10, scratch, 3).count() == 0


# --- 8
def test_mix(spark):
    docs = spark.createDataFrame([(i, "big", 10) for i in range(2000)] + [(5000 + i, "small", 10) for i in range(50)] + [(None, "big", 1), (9000, None, 100), (9001, "other", 0)], "doc_id bigint, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 3), ("absent", 0.1, 2), ("other", None, None)], "source string, target_share double, max_repeats int")
    rate = mixing.rates(docs, targets)
    by = {r["source"]: r for r in rate.collect()}
    assert by["small"]["rate"] == 3.0 and by["small"]["short"] and by["absent"]["short"] and not by["big"]["short"] and not by["other"]["short"]
    got = mixing.mix(docs, rate)
    copies = Counter((r["source"], r["doc_id"]) for r in got.collect())
    assert all(copies["small", 5000 + i] == 3 for i in range(50)) and max(v for (s, _), v in copies.items() if s == "big") == 1
    share = {r["source"]: r for r in mixing.shares(got, rate).collect()}
    assert abs(share["big"]["mixed_tokens"] - 0.5 * by["big"]["all_tokens"]) < 600 and share["absent"]["mixed_tokens"] == 0
    assert mixing.mix(docs.limit(0), mixing.rates(docs.limit(0), targets)).count() == 0
    assert {r["source"] for r in mixing.exhausted(mixing.shares(got, rate)).collect()} == {r["source"] for r in rate.filter("short").collect()} == {"small", "absent"}


# --- 9
PROSE = ["The parser reads the file and keeps one entry per node of the table.", "We measured the cache and compared the results of each build.", "If the key is missing, the index falls back to the default value.", "Set the limit to three when the queue has to hold more than ten jobs."]
BAD = {
    "slot": ["Welcome to {{ project }}, the home of the tools.", "Maintained by __AUTHOR__.", "Hello [INSERT NAME HERE], your build is ready.", "Version &lt;version&gt; changes the cache.", "Copyright [object Object].", "THE REPORT OF <YOUR TEAM> IS READY.", "Write to [COMPANY NAME] in time.", "Made by %%OWNER%% for all.", "Call us: {{" + "a long name of a field " * 5 + "}}.", "The price (amount: TBD) is due.", "Signed XXXX for the board."],
    "filler": ["Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", "asdf asdf qwer qwer asdf sdfg", "bla bla text blah words more bla text.", "Coming soon.", "Your description goes here."],
    "notice": ["Please enable JavaScript to view this page.", "404 Not Found\nThe page you asked for is not on this server.", "Access denied. You do not have permission to open this page.", "Your session has expired. Sign in again to continue.", "503 Service Unavailable"],
}
SOUND = [
    "The renderer replaces `{{ name }}` with the value of the key.", 'Users who see "Page not found" should clear the cache of the build.', "```html\n<h1>{{ title }}</h1>\n```\nThe template above prints a heading of the table.",
    "Our build needs JavaScript modules to be enabled in the bundler; the option is called `mode`. " + " ".join(PROSE), "    x = f'{name}'\n" + PROSE[0], "", None, "   ", "???", PROSE[1] * 50, "See [the parser](https://example.org/a_b) and the [cache] for 5% of keys (about $3).", "ALL CAPITALS (A, B) ARE SOUND: 100% OF THEM.", "The field user_name of List and #12 @team are [1] notes.",
]


def test_residue(spark):
    rng = random.Random(11)
    natural = [" ".join(rng.choices(PROSE, k=6)) for _ in range(300)]
    kinds = [None] * len(natural) + [k for k, ts in BAD.items() for _ in ts] + [None] * len(SOUND)
    texts = natural + [t for ts in BAD.values() for t in ts] + SOUND
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["verdict"] for r in residue.judged(df, "doc_id", "text").collect()}
    assert [(texts[i], k, got[i]) for i, k in enumerate(kinds) if got[i] != k] == []
    assert residue.judged(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("notice", ["Your session has expired.", "404 Not Found.", "Access denied.", "Please enable JavaScript to continue.", "Coming soon."])
def test_residue_that_a_third_of_rows_repeat(spark, notice):
    rng = random.Random(12)
    natural = [f"{rng.choice(PROSE)} The {program(rng, 4)} entry holds {program(rng, 3)} and {rng.randint(0, 999)} more." for _ in range(1500)]
    copies = [notice] * 400 + [f"{notice}\n{notice.upper()}"] * 350
    df = spark.createDataFrame(list(enumerate(natural + copies)), "doc_id bigint, text string").coalesce(2)
    got = {r["doc_id"] for r in residue.judged(df, "doc_id", "text").filter("verdict IS NOT NULL").collect()}
    assert got == set(range(1500, 2250))


# --- all
def test_extra_columns_nulls_and_repeats_do_no_harm(spark, scratch):
    """Every operator on rows with null ids and texts, a very long text, repeated rows, and extra columns named like its own."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    data = [(1, "a b c d e f", "q1", "c1", 0.5), (1, "a b c d e f", "q1", "c1", 0.5), (2, "A b C d e f!", None, "c1", None), (None, "a b c d e f", "q1", None, 0.5), (3, None, " ", "", float("nan")), (4, "", "q2", "c2", 0.5), (5, long, "q1", "c3", 0.5), (6, long + " more", "q3", "c3", 0.1)]
    extra = "id n k1 k2 sig bands band members x field train cid copies head hot d p weight chunks text tokens bucket place first rank container group_id split q c node root v u m source rate verdict slots keep_id row_id __g __i __s __text key sa sb".split()
    plain = spark.createDataFrame(data, "pair_id bigint, code string, query_id string, corpus_id string, score double")
    full = plain.select("*", F.lit("query").alias("query"), *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    own = plain.select("*", F.lit("query").alias("query"), F.when(F.col("pair_id") % 2 == 0, "train").otherwise("test").alias("split"), F.lit("s").alias("source"), F.lit(3).alias("tokens"))
    wide = own.select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra) if c not in own.columns))
    for df, ops in (
        (full, [
            lambda d: boundaries.split_oversized(d, "code", 1000, 10, ["pair_id"]),
            lambda d: topn.top_n_per_group(d, "query_id", "corpus_id", "score", 2),
            lambda d: formatting.copies(formatting.record_keys(d, "pair_id", "code")),
            lambda d: neardup.near_duplicates(d, "pair_id", "code", scratch),
            lambda d: neardup.near_duplicates(d, "pair_id", "code", scratch, hot=1),
            lambda d: splits.connected(d, "pair_id", ("query_id", "corpus_id"), scratch),
            lambda d: packing.pack(d, "pair_id", "code", 100, scratch, 4),
            lambda d: residue.judged(d, "pair_id", "code"),
        ]),
        (wide, [lambda d: overlap.Leakage(d, scratch).pairs(), lambda d: overlap.Leakage(d, scratch).row_fractions(), lambda d: mixing.mix(d.withColumnRenamed("pair_id", "doc_id"), mixing.rates(d, spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")))]),
    ):
        for op in ops:
            narrow = df.select("pair_id", "code", "query_id", "corpus_id", "score", "query", *(["split", "source", "tokens"] if df is wide else []))
            assert Counter(map(tuple, op(df).collect())) == Counter(map(tuple, op(narrow).collect()))
            assert op(df.limit(0)).count() == 0
    assert {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(full, "pair_id", "code", scratch).collect()} == {(5, 6)}
    assert rows(splits.connected(full, "pair_id", ("query_id", "corpus_id"), scratch)) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (6, 1)]
