"""Duplicates hidden by formatting: range partition, external sort, scan of adjacent runs.

Every record is reduced once to a canonical key by JVM expressions and written with the key's
digest. The records are range-partitioned on ``(digest, row_id)`` and sorted on ``(digest, key,
row_id)``, so equal keys lie side by side, the bounds of the ranges are short whatever the
texts, and Spark's sort spills to disk beyond memory. A scan then compares full neighbouring
keys and emits, for every row, the head of its run. Since the order is by key *and* id, a run
of any length may be cut between partitions: no key is ever gathered in one task. Runs cut by
a partition bound are mended by joining the runs that touch a bound - at most two for each
partition, whatever the data.

Nulls: a null question counts as an empty text and a null map as no options; records without
question and options have no content to compare and are no duplicates of anything. Ties: the
smallest ``row_id`` represents a group. Repeated row ids are kept as separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import durable

#: What stands between the thousands of a number.
SEPARATORS = r",'\u2019\s\u00a0\u2007\u2009\u202f"
#: What looks like a minus sign before a number.
MINUS = "\u2212\u2010\u2011\u2012\u2013\ufe63\uff0d"


def marked_text(c: Column, lower: bool = True) -> Column:
    """Lower-case text without thousands separators, minus signs as \\x01 and decimal points as \\x02.

    A comma, an apostrophe or white space between groups of at most three and exactly three
    digits is a thousands separator and goes. A minus is one where a number follows at once
    and no letter, digit or closing sign stands before it.
    """
    t = F.coalesce(c, F.lit(""))
    t = F.lower(t) if lower else t
    # each pattern begins with a look at the sign itself, so that what stands around it is looked at only there
    t = F.regexp_replace(t, "(?=[" + SEPARATORS + r"])(?<=[0-9])(?<=(?<![0-9.])[0-9]{1,3})(?:[,'\u2019]|[\s\u00a0\u2007\u2009\u202f]+)(?=[0-9]{3}(?![0-9]))", "")
    t = F.regexp_replace(t, "[-" + MINUS + r"](?<![\p{L}\p{N}%$)].)(?=\$?\.?[0-9])|[-" + MINUS + r"](?<=\$.)(?=\.?[0-9])", "\u0001")
    return F.regexp_replace(t, r"\.(?=[0-9])(?:(?<=[0-9]\.)|(?<![\p{L}\p{N}]\.))", "\u0002")


#: Between the texts of a record that are rewritten together.
PARTS = "\u001e"


def joined_texts(question: Column, options: Column) -> Column:
    """Question and options in one text, so that each pattern runs once over a record."""
    texts = F.transform(F.map_values(F.coalesce(options, F.create_map().cast("map<string,string>"))), lambda x: F.coalesce(x, F.lit("")))
    parts = F.concat(F.array(F.coalesce(question, F.lit(""))), texts)
    return F.concat_ws(PARTS, F.transform(parts, lambda x: F.translate(x, PARTS, " ")))


def canonical_text(c: Column) -> Column:
    """Text without case, space and punctuation; decimal points, minus signs, % and $ stay, digits that were apart stay apart."""
    t = F.regexp_replace(marked_text(c), r"(?<=[0-9])[^\p{L}\p{M}\p{N}%$\u0001\u0002\u001e]+(?=[0-9])", "\u0003")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}%$\u0001-\u0003\u001e]+", "")
    return F.translate(t, "\u0001\u0002\u0003", "-._")


def canonical_key(question: Column, options: Column) -> Column:
    """Canonical question and the sorted set of canonical options; null where both are empty."""
    return key_of(canonical_text(joined_texts(question, options)))


def key_of(canonical: Column) -> Column:
    """The key of a record from its canonical question and options, joined by ``PARTS``."""

    def of(parts: Column) -> Column:
        key = F.concat_ws("\u001f", F.concat(F.get(parts, F.lit(0)), F.lit("\u001e")), F.array_sort(F.array_distinct(F.slice(parts, 2, F.size(parts)))))
        return F.when(F.array_join(parts, "") == "", F.lit(None).cast("string")).otherwise(key)

    # through an array of one, so that the canonical texts are derived once and not for each use
    return F.get(F.transform(F.array(F.split(canonical, PARTS)), of), F.lit(0))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row_id, head, bound_key``: the head of each row's run; the key on heads of a bound's runs."""
    last = head = pending = None
    runs = 0
    schema = pa.schema([("row_id", pa.int64()), ("head", pa.int64()), ("bound_key", pa.string())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, ids = b.column(0), b.column(1)
        new = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else []
        starts = [i + 1 for i, x in enumerate(new) if x]
        if last is None or keys[0].as_py() != last:
            starts = [0, *starts]
        heads, bound, at = [], [None] * n, 0
        for s in starts:
            heads += [head] * (s - at)
            if s == 0 and last is None:
                bound[0] = keys[0].as_py()
            at, head = s, ids[s].as_py()
        heads += [head] * (n - at)
        if pending is not None:
            yield pending
        last = keys[n - 1].as_py()
        pending = pa.RecordBatch.from_arrays([ids, pa.array(heads, pa.int64()), pa.array(bound, pa.string())], schema=schema)
        runs += len(starts)
    if pending is not None:
        yield pending
        if runs > 1:  # a row that stands for the last run, with no id of its own
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([head], pa.int64()), pa.array([last], pa.string())], schema=schema)


def duplicate_members(df: DataFrame, key: Column, id_col: str = "row_id") -> DataFrame:
    """``row_id, head`` for every row with a key: the smallest id of the rows with the same key."""
    keyed = df.select(key.alias("_key"), F.col(id_col).cast("long").alias("row_id"))
    # written, as the range's sample and the filter would derive every key once more
    keyed = durable(keyed.select("_key", "row_id", F.unhex(F.md5("_key")).alias("_digest"))).where("_key is not null and row_id is not null")
    scanned = durable(
        keyed.repartitionByRange(F.col("_digest"), F.col("row_id"))
        .sortWithinPartitions("_digest", "_key", "row_id")
        .select("_key", "row_id")
        .mapInArrow(_runs, "row_id long, head long, bound_key string")
    )
    # heads of runs that touch a bound: at most two rows for each partition of the sort
    bounds = scanned.where("bound_key is not null")
    mended = (
        bounds.groupBy("bound_key").agg(F.min("head").alias("true_head"), F.collect_set("head").alias("cut"))
        .where(F.size("cut") > 1)
        .select("true_head", F.explode("cut").alias("_h"))
    )
    return (
        scanned.where("row_id is not null")
        .join(F.broadcast(mended), F.col("head") == F.col("_h"), "left")
        .select("row_id", F.coalesce("true_head", "head").alias("head"))
    )


def representatives(members: DataFrame) -> DataFrame:
    """``row_id, n_copies``: one row for each group, pre-aggregated in every map task."""
    return members.groupBy(F.col("head").alias("row_id")).agg(F.count(F.lit(1)).alias("n_copies"))
