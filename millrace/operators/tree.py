"""Queries on rooted trees of any depth: binary lifting instead of pointers.

``lift`` holds, for every node and power of two, the ancestor that many steps up. It is built
by doubling, so a path of n nodes needs log n joins, and a query takes one equi-join for each
bit of the distance. Rows are spread by node, whatever the shape of the tree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.relational import running_total
from millrace.session import durable


def lifting_table(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(``node, depth``), (``node, k, anc``: the ancestor 2^k steps up) and the number of levels."""
    parent = edges.select(F.col("child").alias("node"), F.col("parent").alias("anc"))
    nodes = durable(edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node"))).distinct().join(parent, "node", "left"))
    level = durable(nodes.select("node", "anc", F.when(F.col("anc").isNull(), 0).otherwise(1).alias("jumped")))
    tables, k = [level.where("anc is not null").select("node", F.lit(0).alias("k"), "anc")], 0
    depth = level
    rounds = math.ceil(math.log2(max(nodes.count(), 2))) + 1
    while True:
        if k > rounds:
            raise ValueError("the edges hold a cycle, or a node with several parents")
        up = tables[-1].select(F.col("node").alias("_m"), F.col("anc").alias("_a"))
        higher = durable(tables[-1].select("node", "anc").join(up, F.col("anc") == F.col("_m")).select("node", F.lit(k + 1).alias("k"), F.col("_a").alias("anc")))
        far = depth.select(F.col("node").alias("_m"), F.col("anc").alias("_a"), F.col("jumped").alias("_j"))
        depth = durable(depth.join(far, F.col("anc") == F.col("_m"), "left").select("node", F.col("_a").alias("anc"), (F.col("jumped") + F.coalesce("_j", F.lit(0))).alias("jumped")))
        if higher.isEmpty():
            return depth.select("node", F.col("jumped").alias("depth")), reduce(DataFrame.unionByName, tables), k + 1
        tables.append(higher)
        k += 1


def climb(queries: DataFrame, steps: Column, lift: DataFrame, levels: int, node: str = "node", out: str = "at") -> DataFrame:
    """``queries`` with ``out``: the node that is ``steps`` above ``node``."""
    q = queries.withColumn("_s", steps.cast("int")).withColumn(out, F.col(node))
    for k in range(levels):
        hop = lift.where(F.col("k") == k).select(F.col("node").alias("_n"), F.col("anc").alias("_a"))
        q = q.join(hop, (F.col(out) == F.col("_n")) & (F.shiftright("_s", k).bitwiseAND(1) == 1), "left")
        q = q.withColumn(out, F.when(F.shiftright("_s", k).bitwiseAND(1) == 1, F.col("_a")).otherwise(F.col(out))).drop("_n", "_a")
    return q.drop("_s")


def level_ancestor(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """``u, d, ancestor``: the ancestor of ``u`` at depth ``d``, ``u`` itself at its own depth, -1 where there is none."""
    depth, lift, levels = lifting_table(edges)
    known = queries.select("u", "d").join(depth.select(F.col("node").alias("u"), "depth"), "u", "left")
    ok = (F.col("d") >= 0) & (F.col("d") <= F.col("depth"))
    up = climb(known, F.when(ok, F.col("depth") - F.col("d")).otherwise(0), lift, levels, "u", "at")
    return up.select("u", "d", F.when(ok, F.col("at")).otherwise(-1).alias("ancestor"))


def lowest_common_ancestor(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``u, v, lca``: level both nodes, then take every jump that keeps them apart, the longest first."""
    depth, lift, levels = lifting_table(edges)
    q = pairs.select("u", "v").distinct()
    for c in ("u", "v"):
        q = q.join(depth.select(F.col("node").alias(c), F.col("depth").alias(f"d_{c}")), c)
    q = climb(q, F.greatest(F.col("d_u") - F.col("d_v"), F.lit(0)), lift, levels, "u", "a")
    q = durable(climb(q, F.greatest(F.col("d_v") - F.col("d_u"), F.lit(0)), lift, levels, "v", "b"))
    for k in range(levels - 1, -1, -1):
        hop = lift.where(F.col("k") == k)
        q = q.join(hop.select(F.col("node").alias("a"), F.col("anc").alias("_a")), "a", "left").join(hop.select(F.col("node").alias("b"), F.col("anc").alias("_b")), "b", "left")
        apart = F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))
        q = q.withColumns({"a": F.when(apart, F.col("_a")).otherwise(F.col("a")), "b": F.when(apart, F.col("_b")).otherwise(F.col("b"))}).drop("_a", "_b")
    top = lift.where("k = 0").select(F.col("node").alias("a"), F.col("anc").alias("_a"))
    return q.join(top, "a", "left").select("u", "v", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("_a")).alias("lca"))


def closure(edges: DataFrame) -> DataFrame:
    """``node, anc, steps`` for every node and each of its ancestors, itself included, by doubling."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node"))).distinct()
    paths = durable(nodes.select("node", F.col("node").alias("anc"), F.lit(0).alias("steps")).union(edges.select(F.col("child").alias("node"), F.col("parent").alias("anc"), F.lit(1).alias("steps"))))
    reach = 1
    rounds = math.ceil(math.log2(max(nodes.count(), 2))) + 1
    while True:
        if reach > 2**rounds:
            raise ValueError("the edges hold a cycle")
        tip = paths.where(F.col("steps") == reach).select("node", F.col("anc").alias("_m"))
        beyond = paths.where("steps > 0").select(F.col("node").alias("_m"), "anc", F.col("steps").alias("_s"))
        new = durable(tip.join(beyond, "_m").select("node", "anc", (F.col("_s") + reach).alias("steps")))
        if new.isEmpty():
            return paths
        paths = durable(paths.union(new))
        reach *= 2


def node_facts(edges: DataFrame) -> DataFrame:
    """``node, depth, height, size`` of every node; a leaf has height 1.

    By doubling: what a node holds within 2^(k+1) steps is what it holds within 2^k, and what
    the nodes 2^k below it hold within 2^k. So n nodes take log n joins of n rows on any shape
    of tree, a chain too.
    """
    depth, lift, levels = lifting_table(edges)
    have = durable(depth.select("node", F.lit(1).alias("height"), F.lit(1).cast("long").alias("size")))
    for k in range(levels):
        below = lift.where(F.col("k") == k).select("node", "anc").join(have, "node")
        more = below.groupBy(F.col("anc").alias("node")).agg((F.max("height") + 2**k).alias("_h"), F.sum("size").alias("_s"))
        have = durable(have.join(more, "node", "left").select("node", F.greatest("height", F.coalesce("_h", F.lit(0))).alias("height"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size")))
    return depth.join(have, "node").select("node", "depth", "height", "size")


def preorder(edges: DataFrame) -> DataFrame:
    """``node, depth, place``: the place of every node when each is followed by its subtree, siblings and roots by key.

    A node stands one place behind its parent and behind the subtrees of its earlier siblings;
    these steps are added up along the path to the root by doubling. Earlier siblings' sizes
    come from one sort of all nodes by (parent, key) in ranges, so a node with very many
    children is not sorted in one task.
    """
    depth, lift, levels = lifting_table(edges)
    facts = durable(node_facts(edges).select("node", "depth", "size"))
    up = lift.where("k = 0").select("node", F.col("anc").alias("parent"))
    kin = durable(facts.join(up, "node", "left").withColumn("_o", F.struct("parent", "node")))
    so_far = running_total(kin, "_o", "size", "_sum").select("node", "parent", (F.col("_sum") - F.col("size")).alias("_before"))
    first = so_far.groupBy(F.col("parent").alias("_p")).agg(F.min("_before").alias("_first"))
    own = F.col("parent").isNotNull()
    # a root follows the roots before it and their subtrees, any other node its parent as well
    step = so_far.join(first, F.col("parent").eqNullSafe(F.col("_p"))).select("node", (F.col("_before") - F.col("_first") + own.cast("int")).alias("place"))
    have = durable(step)
    for k in range(levels):
        above = lift.where(F.col("k") == k).select("node", "anc").join(have.select(F.col("node").alias("anc"), F.col("place").alias("_more")), "anc")
        have = durable(have.join(above.select("node", "_more"), "node", "left").select("node", (F.col("place") + F.coalesce("_more", F.lit(0))).alias("place")))
    return facts.select("node", "depth").join(have, "node")
