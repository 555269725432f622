"""Call graphs (G3-G11): edges (src, dst, pos) with repeated calls kept, frontiers and ranks as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.runtime import Scratch


def call_edges(functions: DataFrame) -> DataFrame:
    """G4. (src, dst): each call resolved to every function of that short name, else to the function of that full name; calls
    that resolve to nothing fall away. Null calls are no calls."""
    calls = functions.select(F.col("name").alias("src"), F.explode("calls").alias("call"))
    names = functions.select("name", "short_name").distinct()
    short = calls.join(names.select(F.col("short_name").alias("call"), F.col("name").alias("dst")), "call")
    full = calls.join(names.select(F.col("short_name").alias("call")).distinct(), "call", "left_anti")
    full = full.join(names.select(F.col("name").alias("call")).distinct(), "call").withColumn("dst", F.col("call"))
    return short.select("src", "dst").unionByName(full.select("src", "dst"))


def call_links(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G4 before the join: (src, call) and (call, dst), each row once; joined by call they are the distinct edges of ``call_edges``
    between named functions. Where many functions share a short name that many call, they are far fewer."""
    names = functions.select("name", "short_name").distinct()
    short = names.select(F.col("short_name").alias("call"), F.col("name").alias("dst"))
    full = names.select(F.col("name").alias("call"), F.col("name").alias("dst")).distinct().join(short.select("call"), "call", "left_anti")
    links = functions.select(F.col("name").alias("src"), F.explode("calls").alias("call"))
    named = lambda t: t.filter(" AND ".join(f"{c} IS NOT NULL" for c in t.columns)).distinct()
    return named(links), named(short.unionByName(full))


def ambiguous(functions: DataFrame) -> DataFrame:
    """G4, G5. (short_name, targets): short names that stand for more than one function."""
    return functions.groupBy("short_name").agg(F.countDistinct("name").alias("targets")).filter("targets > 1")


def resolve(functions: DataFrame, name: str) -> str | None:
    """G5. The full name meant by name: exact, else by short name, else by suffix; an error if it could be several."""
    for cond in (F.col("name") == name, F.col("short_name") == name, F.col("name").endswith(name)):
        got = [r[0] for r in functions.filter(cond).select("name").distinct().orderBy("name").limit(2).collect()]
        if len(got) > 1:
            raise ValueError(f"{name} is ambiguous: {got}")
        if got:
            return got[0]
    return None


def reachable(edges: DataFrame, sources: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """G7, G11. (source, node, depth): nodes within depth steps of each source (column source), by their least distance.

    A frontier is joined with the edges and with what was seen before; the source itself is not listed."""
    e = edges.select("src", "dst").distinct()
    front = sources.select("source", F.col("source").alias("node")).distinct()
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        if scratch:
            front = scratch.keep(front)
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.filter("depth > 0")


def _smallest(e: DataFrame, front: DataFrame, seen: DataFrame, far: tuple[str, str], step: Column) -> DataFrame:
    """The next frontier (origin, node, path): nodes not seen before, each with its smallest path."""
    n = front.join(e, front["node"] == e[far[0]]).select("origin", F.col(far[1]).alias("node"), step.alias("path"))
    return n.groupBy("origin", "node").agg(F.min("path").alias("path")).join(seen.select("origin", "node"), ["origin", "node"], "left_anti")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """G6. (source, target, path, length): a shortest path within depth; of all ways to a node only the smallest path is carried
    on, so the frontier has a row per (source, node). A source is its own target by the path of itself."""
    e = edges.select("src", "dst").distinct()
    front = pairs.select(F.col("source").alias("origin"), F.col("source").alias("node"), F.array("source").alias("path")).distinct()
    seen = front.withColumn("length", F.lit(0))
    for d in range(1, depth + 1):
        front = _smallest(e, front, seen, ("src", "dst"), F.concat("path", F.array("dst")))
        seen = seen.unionByName(front.withColumn("length", F.lit(d)))
    found = seen.select(F.col("origin").alias("source"), F.col("node").alias("target"), F.array_join("path", " -> ").alias("path"), "length")
    return pairs.join(found, ["source", "target"])


def _calls_within(origins: DataFrame, out: DataFrame, into: DataFrame, steps: int, longer: Column) -> DataFrame:
    """(origin, call, path, length): the call names half a step beyond the nodes within steps of each origin, at their least length,
    each with the smallest path to it (without the origin). A step goes from a node to a call by out and to a node by into."""
    front = origins.select("origin", F.col("origin").alias("node"), F.array().cast("array<string>").alias("path")).distinct()
    seen, calls = front.select("origin", "node"), None
    for d in range(steps + 1):
        half = front.join(out, "node").groupBy("origin", "call").agg(F.min("path").alias("path"))
        half = half.join(calls.select("origin", "call"), ["origin", "call"], "left_anti") if calls is not None else half
        new = half.withColumn("length", F.lit(d))
        calls = calls.unionByName(new) if calls is not None else new
        if d < steps:
            front = half.join(into, "call").groupBy("origin", "node").agg(F.min(longer).alias("path")).join(seen, ["origin", "node"], "left_anti")
            seen = seen.unionByName(front.select("origin", "node"))
    return calls


def meeting_paths(edges: DataFrame | tuple[DataFrame, DataFrame], pairs: DataFrame, depth: int) -> DataFrame:
    """G8. (source, target, path, length) as ``shortest_paths``, from both ends: sources go forward half the way, targets back the
    rest, and the halves meet. Frontiers reach half the depth, which is what saves work on wide graphs.

    Edges are rows (src, dst), or the two tables of ``call_links``: then the halves meet at call names, and of all functions of one
    short name and all its callers no row each is made. Pairs without a column target ask for all other nodes within depth.
    The least length over all calls where halves meet is the shortest; of the paths of that length the smallest that the halves'
    smallest paths make up is given."""
    links, targets = edges if isinstance(edges, tuple) else (edges.select("src", F.col("src").alias("call")).distinct(), edges.select(F.col("src").alias("call"), "dst").distinct())
    every = "target" not in pairs.columns
    ends = targets.select(F.col("dst").alias("target")) if every else pairs
    step = {"source": F.concat("path", F.array("node")), "target": F.concat(F.array("node"), "path")}
    ways = {"source": (pairs, ("src", links), ("dst", targets), depth // 2), "target": (ends, ("dst", targets), ("src", links), max(0, depth - 1) // 2)}
    reach = {}
    for end, (at, (x, out), (y, into), steps) in ways.items():
        got = _calls_within(at.select(F.col(end).alias("origin")), out.withColumnRenamed(x, "node"), into.withColumnRenamed(y, "node"), steps, step[end])
        reach[end] = got.select(F.col("origin").alias(end), "call", F.col("path").alias(f"{end}_path"), F.col("length").alias(f"{end}_length"))
    met = reach["source"].join(reach["target"], "call").filter("source <> target") if every else pairs.select("source", "target").distinct().join(reach["target"], "target").join(reach["source"], ["source", "call"])
    met = met.select("source", "target", (F.col("source_length") + F.col("target_length") + 1).alias("length"), F.concat("source_path", "target_path").alias("path"))
    if not every:  # a source is its own target
        met = met.unionByName(pairs.filter("source = target").select("source", "target", F.lit(0).alias("length"), F.array().cast("array<string>").alias("path")))
    best = met.filter(F.col("length") <= depth).groupBy("source", "target").agg(F.min(F.struct("length", "path")).alias("x"))
    path = F.when(F.col("x.length") == 0, F.col("source")).otherwise(F.array_join(F.concat(F.array("source"), "x.path", F.array("target")), " -> "))
    return best.select("source", "target", path.alias("path"), "x.length")


def nodes_of(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the nodes of a call graph: every named function, with or without calls, and whatever is called."""
    return functions.select(F.col("name").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).filter("node IS NOT NULL").distinct()


def pagerank(edges: DataFrame, nodes: DataFrame, scratch: Scratch, damping: float = 0.85, rounds: int = 50, tol: float = 1e-5) -> DataFrame:
    """G9. (node, rank) of all nodes: repeated calls count, nodes without calls spread their rank over all; stops at an L1 change
    below tol, or after ``rounds``."""
    w = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    w = scratch.keep(w.join(w.groupBy("src").agg(F.sum("w").alias("out")), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    every = nodes.select("node").distinct().join(w.select(F.col("src").alias("node"), F.lit(True).alias("out")).distinct(), "node", "left")
    every = scratch.keep(every)
    n = every.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("rank"))
    ranks = scratch.keep(every.select("node", "out", F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        lost = ranks.filter("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = w.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        new = ranks.select("node", "out", F.col("rank").alias("old")).join(got, "node", "left").withColumn("rank", F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + lost / n))
        new = scratch.keep(new.select("node", "out", "old", "rank"))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        scratch.drop(ranks)
        ranks = new
        if change < tol:
            break
    return ranks.select("node", "rank")


def communities(edges: DataFrame, nodes: DataFrame, scratch: Scratch, rounds: int = 15) -> DataFrame:
    """G10. (node, community) of all nodes: label propagation in steps; each node takes its neighbours' commonest label (its own
    label counts once too), the smallest among equals. A community is named by its smallest member; a node without neighbours is
    one of its own.

    Steps are taken by all nodes at once, so the result depends on the graph alone and not on an order of visits; a graph whose
    labels keep alternating ends after ``rounds``."""
    both = scratch.keep(edges.select(F.expr("inline(array(struct(src AS a, dst AS b), struct(dst AS a, src AS b)))")).filter("a <> b").distinct())
    labels = scratch.keep(nodes.select("node").distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label").unionByName(labels.select("node", "label"))
        n = votes.groupBy("node", "label").agg(F.count("*").alias("n"))
        new = scratch.keep(n.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x")).select("node", "x.label"))
        moved = new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            break
    name = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(name, "label").select("node", "community")
