"""Content-based recommendation: interaction strengths, profiles, cosine top-N, and ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import durable

#: Strength of each kind of event.
STRENGTH = {"view": 1.0, "click": 2.0, "purchase": 5.0}


def interactions(events: DataFrame, articles: DataFrame) -> DataFrame:
    """``person_id, content_id, strength, ts``: strongest event of each person on each article, and the last time."""
    kinds = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    item = F.get_json_object("props", "$.k").cast("long")
    e = events.where(F.col("event_type").isin(*STRENGTH)).select(F.col("user_id").alias("person_id"), item.alias("content_id"), kinds[F.col("event_type")].alias("s"), "ts")
    return (
        e.groupBy("person_id", "content_id").agg(F.max("s").alias("strength"), F.max("ts").alias("ts"))
        .join(articles.select("content_id"), "content_id").select("person_id", "content_id", "strength", "ts")
    )


def eligible(df: DataFrame, least: int = 5) -> DataFrame:
    """Rows of persons with at least ``least`` rows."""
    return df.join(df.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "person_id", "left_semi")


def profiles(train: DataFrame, vectors: DataFrame) -> DataFrame:
    """``person_id, term, w``: mean of the item vectors of each person weighted by strength."""
    weight = train.groupBy("person_id").agg(F.sum("strength").alias("all")).where("all > 0")
    parts = train.join(vectors, "content_id").groupBy("person_id", "term").agg(F.sum(F.col("strength") * F.col("w")).alias("s"))
    return parts.join(weight, "person_id").select("person_id", "term", (F.col("s") / F.col("all")).alias("w"))


#: Persons and items of a block pair of the score matrix, which is made for so many persons at a time.
PERSONS, ITEMS, AT_ONCE, UNPACKED = 50_000, 40_000, 250, 2_000
MOST_TERMS = 20_000
#: Read items up to which scores are made of items' likeness to those; with more, of terms.
BASIS = 1000


def _flat(t: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a column of lists."""
    c = t[column].combine_chunks()
    return np.repeat(np.arange(len(c)), pc.list_value_length(c).to_numpy(zero_copy_only=False)), pc.list_flatten(c).to_numpy(zero_copy_only=False)


def _dense(t: pa.Table, width: int, place: np.ndarray | None = None) -> np.ndarray:
    """Rows of numbers, a row's at ``place``; few rows are unpacked at a time, as cells take several times a number's room."""
    out = np.zeros((t.num_rows, width))
    for start in range(0, t.num_rows, UNPACKED):
        part = t.slice(start, UNPACKED)
        row, at = _flat(part, "at")
        row += start
        out[row if place is None else place[row], at] = _flat(part, "w")[1]
    return out


def _block_top(persons: pa.Table, items: pa.Table, n: int, digits: int, width: int, gram) -> pa.Table:
    """The best unseen items of a block for the persons of a block, equal scores by item.

    Single precision and a bound, the person's n-th best of the block's first items, leave few
    items of each person, whose scores are then made in double precision.
    """
    out = []
    if persons.num_rows and items.num_rows:
        ids = items["content_id"].to_numpy()
        order = np.argsort(ids)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ids, g = ids[order], _dense(items, width, place)
        del items
        small, sample, slack = g.astype("float32").T.copy(), min(len(ids), max(10 * n, len(ids) // 10)), 1 - (width + 10) * 2.4e-7
        for start in range(0, persons.num_rows, AT_ONCE):
            p = persons.slice(start, AT_ONCE)
            a = _dense(p, width)
            norm = np.sqrt(np.maximum((a * (a if gram is None else a @ gram.value)).sum(axis=1, keepdims=True), 0))
            a /= np.where(norm > 0, norm, 1)
            scores = a.astype("float32") @ small
            row, seen = _flat(p, "seen")
            place = np.minimum(np.searchsorted(ids, seen), len(ids) - 1)
            known = ids[place] == seen
            scores[row[known], place[known]] = 0
            least = np.partition(scores[:, :sample], max(sample - n, 0), axis=1)[:, max(sample - n, 0)] if sample > n else np.zeros(len(a), dtype="float32")
            row, col = np.nonzero(scores > np.maximum(least * slack - 4 * 10.0**-digits, 0)[:, None].astype("float32"))
            exact = np.concatenate([np.round(np.einsum("ij,ij->i", a[row[k : k + 50_000]], g[col[k : k + 50_000]]), digits) for k in range(0, max(len(row), 1), 50_000)])
            order = np.lexsort((col, -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            keep = (np.arange(len(row)) - np.searchsorted(row, row) < n) & (exact > 0)
            out.append(pa.table({"person_id": p["person_id"].to_numpy()[row[keep]], "content_id": ids[col[keep]], "score": exact[keep]}))
    return pa.concat_tables(out) if out else pa.table({"person_id": pa.array([], pa.int64()), "content_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _likeness(batches: Iterator[pa.RecordBatch], basis) -> Iterator[pa.RecordBatch]:
    """Inner products of rows of terms with every item of the basis, whose terms are the columns' rows."""
    m = basis.value
    for b in batches:
        for start in range(0, b.num_rows, 500):
            t = pa.Table.from_batches([b.slice(start, 500)])
            row, at = _flat(t, "at")
            like = np.add.reduceat(m[at] * _flat(t, "w")[1][:, None], np.searchsorted(row, np.arange(t.num_rows)))
            ends = pa.array(np.arange(t.num_rows + 1, dtype="int32") * m.shape[1])
            every = pa.array(np.tile(np.arange(m.shape[1], dtype="int32"), t.num_rows))
            yield pa.RecordBatch.from_arrays([t["content_id"].combine_chunks(), pa.ListArray.from_arrays(ends, every), pa.ListArray.from_arrays(ends, pa.array(like.ravel()))], names=["content_id", "at", "w"])


def top_unseen(train: DataFrame, vectors: DataFrame, terms: int, n: int = 10, digits: int = 9) -> DataFrame:
    """``person_id, content_id, score, rank``: the best items by cosine to a person's profile that the person has not read; equal scores by item.

    ``vectors`` has a row an item: ``content_id, at, w``, written already, as it is read again.
    A profile is the mean of the items read, so its product with an item is that of the
    person's strengths with the item's likeness to each item read. Where those are few, at
    most ``BASIS``, both are short rows, and no profile is made; else both are rows of terms.
    Scores are blocks of a matrix product, persons against items, and each block pair keeps
    its ``n`` best of every person. ``per`` copies of the items' rows and ``across`` of the persons'
    are shuffled.
    """
    if terms > MOST_TERMS:
        raise ValueError(f"{terms} terms; dense blocks are for vocabularies of at most {MOST_TERMS}")
    spark = vectors.sparkSession
    read = train.select("content_id").distinct()
    basis = vectors.join(read, "content_id", "left_semi").orderBy("content_id").limit(BASIS + 1).collect()
    weight = train.groupBy("person_id").agg(F.sum("strength").alias("_all"), F.collect_set("content_id").alias("seen")).where("_all > 0")
    if len(basis) <= BASIS:
        m = np.zeros((max(1, terms), max(1, len(basis))))
        for k, r in enumerate(basis):
            m[r["at"], k] = r["w"]
        index = spark.createDataFrame([(r["content_id"], k) for k, r in enumerate(basis)], "content_id long, at int")
        own = train.join(F.broadcast(index), "content_id").select("person_id", "at", F.col("strength").alias("w"))
        width, gram, items = m.shape[1], spark.sparkContext.broadcast(m.T @ m), vectors.mapInArrow(partial(_likeness, basis=spark.sparkContext.broadcast(m)), "content_id long, at array<int>, w array<double>")
    else:
        cells = train.join(vectors, "content_id").select("person_id", "strength", F.explode(F.arrays_zip("at", "w")).alias("x"))
        own = cells.groupBy("person_id", F.col("x.at").alias("at")).agg(F.sum(F.col("strength") * F.col("x.w")).alias("w"))
        width, gram, items = max(1, terms), None, vectors
    rows = own.groupBy("person_id").agg(F.collect_list(F.struct("at", "w")).alias("c")).join(weight, "person_id")
    rows = durable(rows.select("person_id", F.col("c.at").alias("at"), F.col("c.w").alias("w"), "seen"))  # a row's length does not change its cosine
    per, across = max(1, math.ceil(rows.count() / PERSONS)), max(1, math.ceil(vectors.count() / ITEMS))
    p = rows.withColumn("pb", F.pmod(F.hash("person_id"), F.lit(per))).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    i = items.withColumn("ib", F.pmod(F.hash("content_id"), F.lit(across))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    work = lambda a, b: _block_top(a, b, n, digits, width, gram)
    best = p.groupBy("pb", "ib").cogroup(i.groupBy("pb", "ib")).applyInArrow(work, "person_id long, content_id long, score double")
    w = Window.partitionBy("person_id").orderBy(F.desc("score"), "content_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ranking_metrics(test: DataFrame, ranked: DataFrame, n: int = 10) -> DataFrame:
    """One row: mean recall at 5 and at ``n``, and mean reciprocal rank; persons without recommendations count as 0."""
    hits = test.join(ranked.select("person_id", "content_id", "rank"), ["person_id", "content_id"], "left").groupBy("person_id").agg(
        F.count(F.lit(1)).alias("relevant"), F.sum((F.col("rank") <= 5).cast("int")).alias("at5"), F.sum((F.col("rank") <= n).cast("int")).alias("at10"), F.min("rank").alias("first")
    )
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return hits.agg(
        mean(F.col("at5") / F.col("relevant")).alias("recall_at_5"),
        mean(F.col("at10") / F.col("relevant")).alias("recall_at_10"),
        mean(F.when(F.col("first") <= n, 1.0 / F.col("first"))).alias("mrr_at_10"),
        F.count(F.lit(1)).alias("persons"),
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def against_all(rows: DataFrame, queries: DataFrame, key: str, per_block: int = 50_000) -> DataFrame:
    """Every query beside every row, block by block: rows keep their place, queries are sent to each block of rows.

    Neither side is broadcast, so both may grow; ``queries`` has columns of other names.
    """
    blocks = max(1, math.ceil(rows.count() / per_block))
    r = rows.withColumn("_block", F.pmod(F.hash(key), F.lit(blocks)))
    q = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return r.join(q, "_block").drop("_block")
