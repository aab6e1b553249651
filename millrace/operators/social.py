"""Tags, trust, attacks, mixtures of recommenders, prioritised sampling and schema-constrained relations.

Everything is an equi-join or an aggregate on keys of the data; only parameters and tables of
a fixed number of rows are broadcast. Nulls never join; an empty input gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import MODULUS, order_hash
from millrace.session import durable

# tags


def tag_scores(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """``u, i, item_mean, tag_mean, blended`` for every rated pair of ``ratings`` (u, i, r), from ``tags`` (i, k).

    A rating r of an item speaks for r with each of the user's tags that the item has: the
    number of times the user gave r to items with the tag, over the logarithm of how often
    the tag is used by all. ``tag_mean`` is the mean of the ratings weighted by that, and the
    blend takes half of it and half of the item's mean. Tags used once tell nothing.
    """
    used = ratings.join(tags, "i").groupBy("u", "k", "r").agg(F.count(F.lit(1)).alias("n"))
    overall = used.groupBy("k").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    weighed = used.join(overall, "k").select("u", "k", "r", (F.col("n") / F.log("all")).alias("w"))
    pairs = ratings.select("u", "i").distinct()
    s = pairs.join(tags, "i").join(weighed, ["u", "k"]).groupBy("u", "i").agg((F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("tag_mean"))
    mean = ratings.groupBy("i").agg(F.avg("r").alias("item_mean"))
    return s.join(mean, "i").select("u", "i", "item_mean", "tag_mean", (0.5 * F.col("item_mean") + 0.5 * F.col("tag_mean")).alias("blended"))


# trust


def strongest(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` strongest edges (a, b, w) of each node; equal ones by node."""
    w = Window.partitionBy("a").orderBy(F.desc("w"), "b")
    return edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def trust_within(edges: DataFrame, hops: int = 2) -> DataFrame:
    """``a, b, w, hops``: whom a node trusts over at most ``hops`` edges: the best product of weights, and the fewest edges of a path of that product.

    Paths are lengthened by one edge a round and the best of each pair is kept, so a round has
    at most a row for each pair of nodes that trust each other.
    """
    step = edges.where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w"))
    known = durable(step.withColumn("hops", F.lit(1)))
    last = known
    for n in range(2, hops + 1):
        longer = last.withColumnRenamed("b", "m").join(step.select(F.col("a").alias("m"), "b", F.col("w").alias("w2")), "m").where("a <> b").select("a", "b", (F.col("w") * F.col("w2")).alias("w"))
        last = longer.groupBy("a", "b").agg(F.max("w").alias("w")).withColumn("hops", F.lit(n))
        known = durable(known.unionByName(last).groupBy("a", "b").agg(F.max(F.struct("w", F.negative("hops").alias("h"))).alias("t")).select("a", "b", "t.w", F.negative("t.h").alias("hops")))
        last = known.where(F.col("hops") == n)
    return known


# attacks


ATTACKS = ("random", "average", "bandwagon", "segment", "love_hate")


def attack(r: DataFrame, target: int, kind: str, segment: DataFrame, share: float = 0.03, fillers: int = 50, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Fake ratings (u, i, r) of ``kind`` against (u, i, r): a share of the users' number of profiles, ids below zero.

    Every profile rates the target and ``fillers`` items, the first by hash: ``random`` around
    the mean of all ratings, ``average`` by each item's mean, ``bandwagon`` the most rated
    items best, ``segment`` items of ``segment`` (i) best and the rest worst, ``love_hate``
    all best and the target worst.
    """
    if kind not in ATTACKS:
        raise ValueError(f"no attack {kind}")
    items = r.where(F.col("i") != target).groupBy("i").agg(F.avg("r").alias("m"), F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col("i")] if kind == "bandwagon" else [order_hash(F.col("i")), F.col("i")]
    chosen = items.orderBy(*order).limit(fillers)
    if kind == "segment":
        chosen = chosen.join(segment.select("i").distinct().withColumn("own", F.lit(1)), "i", "left")
    all_ = r.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.countDistinct("u").alias("users"))
    profile = F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("users") * share), F.lit(1)).cast("int"))).alias("f")
    fakes = all_.select("mean", "sd", profile)  # one row for each profile
    uniform = order_hash(F.col("i") * 1009 + F.col("f")) / F.lit(float(MODULUS)) * 2 - 1
    value: dict[str, Column] = {
        "random": F.greatest(F.least(F.col("mean") + F.col("sd") * uniform, F.lit(high)), F.lit(low)),
        "average": F.col("m"),
        "bandwagon": F.lit(high),
        "segment": F.when(F.col("own") == 1, F.lit(high)).otherwise(F.lit(low)) if kind == "segment" else F.lit(low),
        "love_hate": F.lit(high),
    }
    filled = chosen.crossJoin(F.broadcast(fakes)).select((-F.col("f")).cast("long").alias("u"), "i", value[kind].alias("r"))  # at most ``fillers`` rows on the left
    aimed = fakes.select((-F.col("f")).cast("long").alias("u"), F.lit(target).cast("long").alias("i"), F.lit(low if kind == "love_hate" else high).alias("r"))
    return filled.unionByName(aimed)


# mixtures


def mixed(parts: dict[str, DataFrame], group: str, item: str, n: int) -> DataFrame:
    """``group, item, score, source, rank``: the ``n`` best of each recommender (group, item, score), side by side."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), item)
    ranked = [df.select(group, item, "score", F.lit(k).alias("source"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= n) for k, df in parts.items()]
    return reduce(DataFrame.unionByName, ranked)


def cascade(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, score``: the second recommender's score where the first one's is not 0, and 0 else."""
    a = first.select(*keys, F.col("score").alias("_a"))
    return second.join(a, keys, "left").select(*keys, F.when(F.coalesce("_a", F.lit(0.0)) != 0, F.col("score")).otherwise(0.0).alias("score"))


# sampling and relations


def priorities(df: DataFrame, priority: Column, power: float) -> DataFrame:
    """``df`` with ``p``, the chance of each row in prioritised sampling: its priority to a power over the sum of all."""
    weighed = df.withColumn("_w", F.pow(priority, F.lit(power)))
    total = weighed.agg(F.sum("_w").alias("_all"))  # one row
    return weighed.crossJoin(F.broadcast(total)).withColumn("p", F.col("_w") / F.col("_all")).drop("_w", "_all")


def allowed_relations(relations: DataFrame, schema: DataFrame) -> DataFrame:
    """Relations whose (head_type, predicate, tail_type) is one that ``schema`` allows; repeated rows of the schema count once."""
    return relations.join(schema.distinct(), ["head_type", "predicate", "tail_type"], "left_semi")
