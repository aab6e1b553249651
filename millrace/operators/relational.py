"""Keep-first, arg-max, splits and samples with a total order, so that every run gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import durable

#: The multiplicative hash that both Spark and the SQL check can compute.
MULTIPLIER, MODULUS = 2654435761, 4294967296
BASE, SECOND, THIRD = 1_000_003, 2246822519, 3266489917


def order_hash(key: Column, seed: int = 42) -> Column:
    """A hash of an integer key that orders rows at random but always alike.

    The key's three lowest digits to the base 1,000,003 are multiplied by a number each, so
    keys repeat a value by chance only, and SQL can compute it.
    """
    k = key.cast("long")
    high = F.call_function("div", k, F.lit(BASE))
    higher = F.call_function("div", high, F.lit(BASE))
    return ((k % BASE + seed) * MULTIPLIER + high % BASE * SECOND + higher % BASE * THIRD) % MODULUS


def order_hash_sql(key: str, seed: int = 42) -> str:
    """:func:`order_hash` for the SQL checks."""
    k = f"({key})"
    return f"((({k} % {BASE} + {seed}) * {MULTIPLIER} + ({k} // {BASE}) % {BASE} * {SECOND} + ({k} // {BASE} // {BASE}) % {BASE} * {THIRD}) % {MODULUS})"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in ``order``. ``min_by`` keeps one row of a key in each map task, so no key is gathered."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min_by(row, rank).alias("_r")).select("_r.*")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The ``n`` first rows of every group; the limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def leave_last_out(df: DataFrame, key: str, last: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(train, test): of every key the row that is greatest by the columns ``last`` is the test row, of equal ones one.

    The greatest is kept in each map task, so a key with a tenth of all rows is never sorted
    or gathered; train is what is left. ``last`` is to tell the rows of a key apart.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    test = df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(*last)).alias("_r")).select("_r.*")
    gone = test.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_l{i}") for i, c in enumerate(last)])
    same = F.col(key).eqNullSafe(F.col("_k"))
    for i, c in enumerate(last):
        same = same & F.col(c).eqNullSafe(F.col(f"_l{i}"))
    return df.join(gone, same, "left_anti"), test


def _parted(df: DataFrame, order: str) -> DataFrame:
    """``df`` sorted over range partitions and written, with ``_p``, its partition, and ``_m``, rising within it."""
    return durable(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))


def dense_ids(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``id``: 0 to n-1 in ``order``, from the counts of sorted partitions; no single task sorts all rows."""
    s = _parted(df, order)
    starts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"))
    offsets = starts.select("_p", "_first", F.expr("sum(_c) over (order by _p) - _c").alias("_before"))  # a row for each partition
    return s.join(F.broadcast(offsets), "_p").withColumn("id", F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_before")


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each in ``order``; a task adds up its own range and starts from the others' totals."""
    s = _parted(df, order)
    starts = s.groupBy("_p").agg(F.sum(value).alias("_c"))
    offsets = starts.select("_p", F.expr("sum(_c) over (order by _p) - _c").alias("_before"))  # a row for each partition
    within = F.sum(value).over(Window.partitionBy("_p").orderBy("_m"))
    return s.join(F.broadcast(offsets), "_p").withColumn(out, F.col("_before") + within).drop("_p", "_m", "_before")


def exact_sample(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """``max(1, int(N * ratio))`` rows by hash order, without a global sort beyond the limit."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be above 0 and at most 1")
    n = max(1, int(df.count() * ratio))
    return df.orderBy(order_hash(F.col(key), seed), F.col(key)).limit(n)


def stratified_split(df: DataFrame, stratum: Column, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: ``dev`` for ``round(n * share)`` rows of every stratum, ``train`` for the rest.

    Ranks come from per-bucket counts and offsets, so a stratum that holds a third of all
    rows is ranked bucket by bucket and never in one task.
    """
    buckets = 1024
    h = order_hash(F.col(key), seed)
    x = df.withColumn("_s", stratum).withColumn("_h", h).withColumn("_b", F.floor(h / (MODULUS // buckets)).cast("int"))
    counts = x.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy("_s")
    offsets = counts.select(
        F.col("_s").alias("_s2"), F.col("_b").alias("_b2"),
        (F.sum("_c").over(by.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(by).alias("_n"),
    )
    ranked = x.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)))
    out = ranked.join(offsets, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    dev = (F.col("_before") + F.col("_r")) <= F.round(F.col("_n") * F.lit(share))
    return out.withColumn("part", F.when(dev, "dev").otherwise("train")).drop("_s", "_h", "_b", "_s2", "_b2", "_before", "_n", "_r")


def union_first_source(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables, one row for each key, those of the first before those of the second."""
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)))
    return keep_first(both, [key], [F.col("_rank"), F.col(order)]).drop("_rank")
