"""Problem 5: splits in given proportions that keep connected records together.

Records are linked by equal keys. The graph's nodes are, for each key value, the smallest record id that has it; a record
is an edge between the nodes of its two keys. Components come from hash-to-min: each node sends its neighbour cluster to
the cluster's minimum and the minimum to every member until nothing changes. Clusters are kept as rows (node, member), so a
component of any size is spread over tasks. Components are then assigned to splits by weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.keyed import join_keyed
from corvina.runtime import Scratch


def _nonblank(c: str) -> F.Column:
    return F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))


def hash_to_min(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component."""
    state = scratch.keep(edges.filter("a <> b").select(F.expr("inline(array(struct(a AS v, b AS u), struct(b AS v, a AS u)))")).distinct())
    check = None
    for _ in range(max_rounds):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == check:
            break
        check = now
        mins = state.groupBy("v").agg(F.least(F.first("v"), F.min("u")).alias("m"), F.count("*").alias("n"))
        sent = join_keyed(state, mins, ["v"], "n").select(F.expr("inline(array(struct(m AS v, u AS u), struct(u AS v, m AS u)))"))
        own = mins.select(F.expr("inline(array(struct(m AS v, v AS u), struct(v AS v, m AS u)))"))
        after = scratch.keep(sent.unionByName(own).filter("v <> u").distinct())
        scratch.drop(state)
        state = after
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return state.groupBy("v").agg(F.least(F.first("v"), F.min("u")).alias("root"), F.count("*").alias("n")).withColumnRenamed("v", "node")


def connected(df: DataFrame, id_col: str, keys: tuple[str, str], scratch: Scratch) -> DataFrame:
    """(pair_id, group_id): group_id is the smallest id of all records connected, directly or through others, by equal keys.

    Blank keys (null or only spaces) connect nothing; a record without any key is a group of its own. Null ids are left out;
    ids are taken as unique, repeated ones come out repeatedly with the same group."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), _nonblank(keys[0]).alias("q"), _nonblank(keys[1]).alias("c")).filter("id IS NOT NULL")
    for k, node in (("q", "a"), ("c", "b")):
        firsts = rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias(node), F.count("*").alias("n"))
        rows = join_keyed(rows, firsts, [k], "n", "left").drop("n", k)
    links = scratch.keep(rows.select("id", F.coalesce("a", "b", "id").alias("a"), F.coalesce("b", "a", "id").alias("b")))
    roots = scratch.keep(hash_to_min(links.select("a", "b").distinct(), scratch))
    size = links.groupBy("a").agg(F.count("*").alias("n"))
    roots = size.join(roots.select(F.col("node").alias("a"), "root"), "a")
    return join_keyed(links, roots, ["a"], "n", "left").select(F.col("id").alias("pair_id"), F.coalesce("root", "a").alias("group_id"))


def assign_splits(groups: DataFrame, targets: dict[str, float], seed: str = "corvina") -> DataFrame:
    """(pair_id, group_id, split) for groups (pair_id, group_id), passed as a table.

    Weighted rendezvous for every group: it goes to the split with the greatest weight / -ln(u), u a hash of seed, split and group,
    the weights being the targets. Where a group goes thus hangs on its id alone, and rows that come to other groups move nothing -
    but for one rule of what fits: a split whose whole target is smaller than the group's share of all rows does not take it, if
    any split is large enough (fewer than 1 / the smallest target of groups can be so large). ``split_shares`` reports what was
    reached, and the largest groups' part in it. Splits without a positive target receive nothing."""
    good = {s: float(w) for s, w in targets.items() if s is not None and w is not None and w > 0}
    if not good:
        raise ValueError("no split has a positive share")
    names, total_w = sorted(good), sum(good.values())
    u = lambda s: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(s), F.col("group_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    room = {s: good[s] / total_w for s in names}
    widest = max(room.values())
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    share = F.least(F.col("n") / groups.count(), F.lit(widest))
    score = lambda s: F.when(F.lit(room[s]) >= share, F.lit(good[s]) / -F.ln(u(s))).otherwise(F.lit(-1.0))
    best = F.greatest(*(F.struct(score(s).alias("k"), F.lit(s).alias("s")) for s in names)) if len(names) > 1 else F.struct(F.lit(0.0).alias("k"), F.lit(names[0]).alias("s"))
    put = sizes.select("group_id", "n", best["s"].alias("split"))
    return join_keyed(groups, put, ["group_id"], "n").select("pair_id", "group_id", "split")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, n_rows, reached_share, n_groups, largest_group): one row per target, of (pair_id, group_id, split).

    reached_share is of all rows; largest_group is the number of rows of a split's largest group, 0 if it has none."""
    per = assigned.groupBy("split", "group_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.max("n").alias("largest_group"))
    total = per.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"))
    j = targets.select("split", "target_share").join(per, "split", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("split", "target_share", zero("n_rows"), F.when(F.col("total") > 0, F.coalesce("n_rows", F.lit(0)) / F.col("total")).otherwise(0.0).alias("reached_share"), zero("n_groups"), zero("largest_group"))
