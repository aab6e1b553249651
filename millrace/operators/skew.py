"""Per-key statistics that no single key can hold up: eager aggregation through joins.

Both inputs of a join are reduced to one compact state per join key before they meet. A
state is ``(rows, values, total)``; it is built by a partial aggregation in every map task,
so a key that holds a third of all rows sends one state per map task and never its rows.
States are joined one to one, and the result of the row-level join is recovered
algebraically: joined rows are the product of the two row counts, joined sums the sum times
the other side's row count.

Nulls: a null key is a group of its own in :func:`key_states` and never joins; null values
count as rows and not as values, and the mean of no value is null. Empty inputs give empty
results. Extra columns are pruned; only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: Sequence[str], value: Column | None = None) -> DataFrame:
    """``keys..., n_rows, n_values, total`` of ``df``: the compact state of each key."""
    v = F.lit(None).cast("double") if value is None else value.cast("double")
    return df.groupBy(*[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_values"), F.sum(v).alias("total")
    )


def eager_join_states(left: DataFrame, right: DataFrame, on: str, right_groups: Sequence[str] = ()) -> DataFrame:
    """The states of ``left`` joined to ``right`` on ``on``, as the row-level left join would give.

    ``left`` is a :func:`key_states` result; ``right`` raw rows. ``right`` is reduced to
    ``(on, groups..., copies)`` first, so repeated rows multiply counts instead of rows.
    """
    compact = (
        right.where(F.col(on).isNotNull())
        .groupBy(F.col(on).alias("_on"), *[F.col(g) for g in right_groups])
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    return left.join(compact, F.col(on) == F.col("_on"), "left").select(
        *left.columns[:-3],
        *right_groups,
        (F.col("n_rows") * copies).alias("n_rows"),
        (F.col("n_values") * copies).alias("n_values"),
        (F.col("total") * copies).alias("total"),
        F.col("_copies").isNotNull().alias("matched"),
    )


def roll_up(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up states by coarser keys and derive the mean."""
    return states.groupBy(*[F.col(k) for k in keys]).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total")
    ).withColumn("mean", F.col("total") / F.when(F.col("n_values") > 0, F.col("n_values")))


def keyed_statistics(facts: DataFrame, dimensions: dict[str, DataFrame], value: Column) -> DataFrame:
    """``key_name, key_id, n_joined, n_values, total, n_copies`` for every value of each key column.

    ``dimensions`` maps a key column of ``facts`` to a table with the same column. The facts
    are read once, for all keys together; their states are joined to the states of the tables,
    and ``n_joined`` is the rows that the row-level left join would give: rows of the facts
    times rows of the table, one for a key that it lacks. Sums over the facts alone divide by
    that factor again.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("long").alias("key_id")) for k in dimensions]))
    states = key_states(facts.select(each.alias("_k"), value.alias("_v")).select("_k.key_name", "_k.key_id", "_v"), ["key_name", "key_id"], F.col("_v"))
    tables = reduce(DataFrame.unionByName, [dim.select(F.lit(k).alias("_n"), F.col(k).cast("long").alias("_i")) for k, dim in dimensions.items()])
    copies = tables.where("_i is not null").groupBy("_n", "_i").agg(F.count(F.lit(1)).alias("_c"))
    return states.hint("merge").join(copies.hint("merge"), (F.col("key_name") == F.col("_n")) & (F.col("key_id") == F.col("_i")), "left").select(
        "key_name",
        "key_id",
        (F.col("n_rows") * F.coalesce("_c", F.lit(1))).alias("n_joined"),
        "n_values",
        "total",
        F.coalesce("_c", F.lit(0)).alias("n_copies"),
    )


def fact_rows() -> Column:
    """Rows of the facts alone in a result of :func:`keyed_statistics`."""
    return (F.col("n_joined") / F.greatest("n_copies", F.lit(1))).cast("long")


def heavy_keys(statistics: DataFrame, share: float) -> DataFrame:
    """``key_name, key_id`` of the non-null keys that hold at least ``share`` of all rows of their column.

    The total of a column is rolled up from its joined states, null key included; the
    comparison joins one row per key column.
    """
    held = statistics.select("key_name", "key_id", fact_rows().alias("_rows"))
    totals = held.groupBy(F.col("key_name").alias("_n")).agg(F.sum("_rows").alias("_all"))
    return (
        held.join(F.broadcast(totals), F.col("key_name") == F.col("_n"))
        # in one condition over both sides, so that both read the same states
        .where(F.when(F.col("key_id").isNotNull(), F.col("_rows")) >= F.lit(share) * F.col("_all"))
        .select("key_name", "key_id")
    )
