"""Collaborative filtering, lift, ranks of posts, and attacks, over ``user_id, item, rating``.

Neighbours come from an equi-join on the shared item or user. A pair of hot keys is summed in
partial states on the map side; the number of pairs is that of the data's co-ratings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import durable


def one_rating(ratings: DataFrame, user: str, item: str) -> DataFrame:
    """``u, i, r``: the mean of each user's ratings of an item."""
    return ratings.groupBy(F.col(user).alias("u"), F.col(item).alias("i")).agg(F.avg("rating").alias("r"))


def lift_pairs(baskets: DataFrame, basket: str, item: str, least: int = 2) -> DataFrame:
    """``a, b, n, lift`` of items that meet in at least ``least`` baskets."""
    b = baskets.select(F.col(basket).alias("k"), F.col(item).alias("x")).distinct()
    total = b.agg(F.countDistinct("k")).scalar()
    single = b.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    pairs = b.withColumnRenamed("x", "a").join(b.withColumnRenamed("x", "b"), "k").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    na, nb = single.select(F.col("x").alias("a"), F.col("n").alias("na")), single.select(F.col("x").alias("b"), F.col("n").alias("nb"))
    return pairs.join(na, "a").join(nb, "b").select("a", "b", "n", (F.col("n") * total / (F.col("na") * F.col("nb"))).alias("lift"))


def user_pearson(r: DataFrame, least: int = 3) -> DataFrame:
    """``a, b, n, sim`` of users with ``least`` shared items; means are those of all their ratings."""
    mean = r.groupBy("u").agg(F.avg("r").alias("m"))
    c = r.join(mean, "u").select("u", "i", (F.col("r") - F.col("m")).alias("d"))
    p = c.select(F.col("u").alias("a"), "i", F.col("d").alias("da")).join(c.select(F.col("u").alias("b"), "i", F.col("d").alias("db")), "i").where("a < b")
    s = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("da") * F.col("db")).alias("ab"), F.sum(F.col("da") * F.col("da")).alias("aa"), F.sum(F.col("db") * F.col("db")).alias("bb"))
    return s.where(F.col("n") >= least).select("a", "b", "n", F.when((F.col("aa") > 1e-12) & (F.col("bb") > 1e-12), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("sim"))


#: Users of a packed row, and pairs of items that a task lists at a time.
USERS_A_ROW, PAIRS_A_TASK = 2_000, 10_000_000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Baskets as bytes, many users a row: lengths, items in order, and ratings less the user's mean."""
    for b in batches:
        for start in range(0, b.num_rows, USERS_A_ROW):
            c = b.slice(start, USERS_A_ROW).column(0)
            n, s = pc.list_value_length(c).to_numpy(zero_copy_only=False).astype("int64"), pc.list_flatten(c)
            x, r = s.field("i").to_numpy(zero_copy_only=False).astype("int64"), s.field("r").to_numpy(zero_copy_only=False)
            d = r - np.repeat(np.add.reduceat(r, np.cumsum(n) - n) / n, n)
            rows = [pa.array([v.tobytes()], pa.binary()) for v in (n, x, d)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([int((n * (n - 1) // 2).sum())])], names=["n", "x", "d", "pairs"])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits."""
    h = x.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _frequent_pairs(batches: Iterator[pa.RecordBatch], part: int, parts: int, least: int) -> Iterator[pa.RecordBatch]:
    """``a, b, n, ab, aa, bb`` of the pairs whose smaller item's hash is ``part`` and that ``least`` users share.

    Pairs are told by a hash of 32 bits first, and only those whose hash comes ``least`` times are
    looked at, so most pairs, which few users share, cost a number in a sort.
    """
    keys, where, xs, ds, base = [], [], [], [], 0
    for b in batches:
        for n, x, d in zip(b.column(0), b.column(1), b.column(2), strict=True):
            n, x, d = np.frombuffer(n.as_buffer(), "int64"), np.frombuffer(x.as_buffer(), "int64"), np.frombuffer(d.as_buffer())
            at = np.flatnonzero((_mixed(x) >> np.uint64(33)) % np.uint64(parts) == part)
            more = np.repeat(np.cumsum(n), n)[at] - at - 1  # items after it in its basket
            first = np.repeat(at, more)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
            keys.append((_mixed(_mixed(x[first]).view("int64") ^ x[second]) >> np.uint64(32)).astype("uint32"))
            # kept until the hashes are counted: the items and ratings this task can need
            need = np.zeros(len(x), dtype=bool)
            need[second] = True
            need[at] = True
            to = np.cumsum(need) - 1 + base
            where.append(np.stack([to[first], to[second]]).astype("int32"))
            xs.append(x[need])
            ds.append(d[need])
            base += int(need.sum())
    if not keys:
        return
    key, where, x, d = np.concatenate(keys), np.concatenate(where, axis=1), np.concatenate(xs), np.concatenate(ds)
    s = np.sort(key)
    often = np.zeros(1 << 24, dtype=bool)
    hot = s[least - 1 :][s[least - 1 :] == s[: len(s) - least + 1]] if len(s) >= least else s[:0]
    often[hot & 0xFFFFFF] = True
    left = np.flatnonzero(often[key & 0xFFFFFF])
    left = left[np.isin(key[left], hot)]
    i, j = where[:, left]
    order = np.lexsort((x[j], x[i]))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], (x[i][1:] != x[i][:-1]) | (x[j][1:] != x[j][:-1])])) if len(i) else np.zeros(0, dtype=int)
    count = np.diff(np.append(new, len(i)))
    enough = count >= least
    sums = [np.add.reduceat(v, new)[enough] if len(v) else v for v in (d[i] * d[j], d[i] * d[i], d[j] * d[j])]
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[i][new][enough], x[j][new][enough], count[enough], *sums)], names=["a", "b", "n", "ab", "aa", "bb"])


def item_adjusted_cosine(r: DataFrame, least: int = 3) -> DataFrame:
    """``a, b, n, sim`` of items with ``least`` shared users; users' means are taken off. Keys are integers.

    The pairs of all baskets would be many times the ratings, so they are not shuffled: the
    baskets are packed and written once, and each task reads all of them for the pairs of some
    of the items, as many tasks as keep its pairs at ``PAIRS_A_TASK``.
    """
    baskets = r.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("c")).select("c")
    packed = durable(baskets.mapInArrow(_pack, "n binary, x binary, d binary, pairs long"))
    parts = max(1, math.ceil((packed.agg(F.sum("pairs")).first()[0] or 0) / PAIRS_A_TASK))
    told = packed.select("n", "x", "d")
    one = lambda k: told.coalesce(1).mapInArrow(partial(_frequent_pairs, part=k, parts=parts, least=least), "a long, b long, n long, ab double, aa double, bb double")
    s = reduce(DataFrame.unionAll, [one(k) for k in range(parts)])
    return s.select("a", "b", "n", F.when((F.col("aa") > 1e-12) & (F.col("bb") > 1e-12), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("sim"))


def item_cosine(r: DataFrame, least: int = 3) -> DataFrame:
    """``a, b, n, sim`` of items with ``least`` shared users: the cosine of their columns of ratings, each over all its users."""
    norm = r.groupBy("i").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("q"))
    p = r.select(F.col("i").alias("a"), "u", F.col("r").alias("ra")).join(r.select(F.col("i").alias("b"), "u", F.col("r").alias("rb")), "u").where("a < b")
    s = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ra") * F.col("rb")).alias("ab")).where(F.col("n") >= least)
    size = lambda x: norm.select(F.col("i").alias(x), F.col("q").alias(f"q{x}"))
    both = F.col("qa") * F.col("qb")
    return s.join(size("a"), "a").join(size("b"), "b").select("a", "b", "n", F.when(both > 1e-12, F.col("ab") / both).otherwise(0.0).alias("sim"))


def predict_from_items(r: DataFrame, sims: DataFrame) -> DataFrame:
    """``u, i, prediction``: the mean of the user's own ratings weighted by how alike the items are to ``i``."""
    both = sims.select("a", "b", "sim").union(sims.select("b", "a", "sim")).toDF("j", "i", "sim").where("sim > 1e-6")
    own = r.select("u", F.col("i").alias("j"), "r")
    return own.join(both, "j").groupBy("u", "i").agg((F.sum(F.col("sim") * F.col("r")) / F.sum("sim")).alias("prediction"))


def predict_from_users(r: DataFrame, sims: DataFrame) -> DataFrame:
    """``u, i, prediction``: own mean plus the weighted departures of positive neighbours who rated the item."""
    both = sims.select("a", "b", "sim").union(sims.select("b", "a", "sim")).toDF("u", "v", "sim").where("sim > 1e-6")
    mean = r.groupBy("u").agg(F.avg("r").alias("m"))
    dep = r.join(mean, "u").select(F.col("u").alias("v"), "i", (F.col("r") - F.col("m")).alias("d"))
    s = both.join(dep, "v").groupBy("u", "i").agg(F.sum(F.col("sim") * F.col("d")).alias("num"), F.sum("sim").alias("den"))
    return s.join(mean, "u").select("u", "i", (F.col("m") + F.col("num") / F.col("den")).alias("prediction"))


def average_attack(r: DataFrame, target: int, share: float = 0.03) -> DataFrame:
    """Ratings with fake users added who give every item its mean and the target the best rating."""
    n = r.agg((F.ceil(F.countDistinct("u") * share)).alias("n")).first()["n"]
    items = r.groupBy("i").agg(F.avg("r").alias("r"))
    fake = items.select(F.explode(F.sequence(F.lit(1), F.lit(max(int(n), 1)))).alias("f"), "i", "r")
    fake = fake.select((-F.col("f")).cast("long").alias("u"), "i", F.when(F.col("i") == target, 10.0).otherwise(F.col("r")).alias("r"))
    return r.unionByName(fake)


def hot_score(df: DataFrame, up: str, down: str, seconds: str) -> DataFrame:
    """``df`` with ``score``: the logarithm of net votes plus the signed age."""
    net = F.col(up) - F.col(down)
    return df.withColumn("score", F.log10(F.greatest(F.lit(1.0), F.abs(net).cast("double"))) + F.signum(net.cast("double")) * F.col(seconds) / 45000.0)


def decay_score(df: DataFrame, up: str, down: str, hours: str, alpha: float = 0.8, gamma: float = 1.8) -> DataFrame:
    """``df`` with ``score``: net votes to a power, falling with age to another."""
    net = F.greatest((F.col(up) - F.col(down) - 1).cast("double"), F.lit(0.0))
    return df.withColumn("score", F.pow(net, alpha) / F.pow(F.col(hours) + 2.0, gamma))
