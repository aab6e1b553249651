"""An inverted index in files: ingested once, searched many times, changed by adding segments.

An index is a folder of segments and numbered manifests. A segment holds

* ``postings``: ``field, bucket, term, doc, tf, size, places``, partitioned by field and term
  bucket and sorted by term and document, so a query reads the buckets of its few terms and,
  within them, the row groups that hold them; a term that a third of all documents have is
  cut between files by document; a row with the empty term stands for each document and field,
* ``terms``: ``field, term, df``, sorted, for frequencies and fuzzy expansion,
* ``documents``: the key of every document with the columns stored for display.

A change writes a new segment with its documents, each key once with its latest row, and then
a manifest that lists it; a failed write leaves the old manifest and so the old index. Rows of
earlier segments are hidden where a later one has their key, and ``compact`` writes one segment
of all that is visible. As usual, frequencies count hidden documents until then.

Null and empty texts have no postings; a query without known terms finds nothing. Equal scores
are ordered by key.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.analysis import ANALYSERS
from millrace.operators.relational import keep_first
from millrace.operators.text import B, K1, edits_allowed
from millrace.session import durable

BUCKETS = 64
#: Documents whose postings of a bucket are written together.
DOCS_A_CUT = 2_000_000

#: Types that a key may have, and theirs in a batch.
KEYS = {"long": pa.int64(), "string": pa.string()}


def postings_sql(key_type: str) -> str:
    return f"field string, term string, doc {key_type}, tf int, size int, places array<int>"


def _postings_schema(key_type: str) -> pa.Schema:
    return pa.schema([("field", pa.string()), ("term", pa.string()), ("doc", KEYS[key_type]), ("tf", pa.int32()), ("size", pa.int32()), ("places", pa.list_(pa.int32()))])


# manifests


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the manifests, the newest last."""
    fs, path = _files(spark, folder), spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return [f"{folder}/{n}" for n in sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))]


def manifest(spark: SparkSession, folder: str) -> dict:
    """What the newest manifest says; no segments where there is none."""
    known = _manifests(spark, folder)
    if not known:
        return {"segments": [], "fields": {}, "key": "doc_id"}
    return json.loads("\n".join(r[0] for r in spark.read.text(known[-1], wholetext=True).collect()))


def _publish(spark: SparkSession, folder: str, content: dict) -> None:
    """Make ``content`` the newest manifest: written under another name and renamed, so a reader sees all of it or none."""
    fs, Path = _files(spark, folder), spark._jvm.org.apache.hadoop.fs.Path
    n = len(_manifests(spark, folder))
    draft, target = Path(f"{folder}/.draft-{uuid.uuid4().hex}"), Path(f"{folder}/manifest-{n:08d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"another writer has changed the index in {folder}")


# writing


def bucket_of(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def _postings(batches: Iterator[pa.RecordBatch], fields: dict[str, str], key_type: str) -> Iterator[pa.RecordBatch]:
    """Postings of a batch of documents: counted within each document, so no token is shuffled to be counted."""
    schema = _postings_schema(key_type)
    for b in batches:
        cols: list[list] = [[] for _ in schema]
        docs = b.column(0).to_pylist()
        for field, analyser in fields.items():
            of = ANALYSERS[analyser]
            for doc, text in zip(docs, b.column(field).to_pylist(), strict=True):
                terms = of(text) if text else []
                if not terms:
                    continue
                places: dict[str, list[int]] = {}
                for k, t in enumerate(terms):
                    places.setdefault(t, []).append(k)
                for t, at in (("", []), *places.items()):
                    for c, v in zip(cols, (field, t, doc, len(at), len(terms), at), strict=True):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _write_segment(docs: DataFrame, folder: str, key: str, fields: dict[str, str], stored: Sequence[str]) -> str:
    spark = docs.sparkSession
    name = f"segment-{uuid.uuid4().hex[:12]}"
    at = f"{folder}/{name}"
    kind = "string" if dict(docs.dtypes)[key] == "string" else "long"
    docs.select(F.col(key).cast(kind).alias("doc"), *stored).write.parquet(f"{at}/documents")
    rows = docs.select(F.col(key).cast(kind).alias("doc"), *[F.col(f).cast("string").alias(f) for f in fields])
    postings = rows.mapInArrow(partial(_postings, fields=fields, key_type=kind), postings_sql(kind)).withColumn("bucket", bucket_of(F.col("term")))
    # a bucket is cut by document, so that a term which most documents have makes no large file; by hash, as ranges would derive all postings twice
    cuts = spark.read.parquet(f"{at}/documents").count() // DOCS_A_CUT + 1
    cut = F.pmod(F.xxhash64("doc"), F.lit(cuts))
    postings.repartition("field", "bucket", cut).sortWithinPartitions("field", "bucket", "term", "doc").write.partitionBy("field", "bucket").parquet(f"{at}/postings")
    written = spark.read.schema(f"{postings_sql(kind)}, bucket int").parquet(f"{at}/postings")
    counts = written.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.max("size").alias("longest"), F.sum(F.when(F.col("term") == "", F.col("size"))).alias("total"))
    counts.sortWithinPartitions("field", "term").write.parquet(f"{at}/terms")
    return name


def latest(docs: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return keep_first(docs.where(F.col(key).isNotNull()), [key], order)


def build(docs: DataFrame, folder: str, fields: dict[str, str], key: str = "doc_id", stored: Sequence[str] = (), order: Sequence[Column] = ()) -> None:
    """A new index of ``docs``; ``fields`` maps columns to analysers, ``order`` tells which row of a repeated key stands."""
    docs = durable(latest(docs, key, order)) if order else docs.where(F.col(key).isNotNull())
    segment = _write_segment(docs, folder, key, fields, stored)
    _publish(docs.sparkSession, folder, {"segments": [segment], "fields": fields, "key": key, "stored": list(stored)})


def upsert(docs: DataFrame, folder: str, order: Sequence[Column]) -> None:
    """Add documents or replace those of the same key; of several new rows of a key the first in ``order`` stands."""
    spark = docs.sparkSession
    now = manifest(spark, folder)
    if not now["segments"]:
        raise ValueError(f"no index in {folder}")
    segment = _write_segment(durable(latest(docs, now["key"], order)), folder, now["key"], now["fields"], now["stored"])
    _publish(spark, folder, now | {"segments": [*now["segments"], segment]})


def compact(spark: SparkSession, folder: str, docs: DataFrame) -> None:
    """One segment of all visible documents; ``docs`` has their texts."""
    now = manifest(spark, folder)
    visible = documents(spark, folder).select(F.col("doc").alias("_doc"))
    segment = _write_segment(docs.join(visible, F.col(now["key"]) == F.col("_doc"), "left_semi"), folder, now["key"], now["fields"], now["stored"])
    _publish(spark, folder, now | {"segments": [segment]})


# reading


def _segments(spark: SparkSession, folder: str, what: str, schema: str | None = None) -> DataFrame:
    """A part of all segments with ``seq``, their place in the manifest."""
    reader = spark.read.schema(schema) if schema else spark.read
    names = manifest(spark, folder)["segments"]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [reader.parquet(f"{folder}/{n}/{what}").withColumn("seq", F.lit(k)) for k, n in enumerate(names)])


def _visible(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Rows with ``doc`` and ``seq`` but for those whose document a later segment has."""
    if len(manifest(spark, folder)["segments"]) == 1:
        return rows
    keys = _segments(spark, folder, "documents").where("seq > 0").select(F.col("doc").alias("_doc"), F.col("seq").alias("_seq"))
    return rows.join(keys, (F.col("doc") == F.col("_doc")) & (F.col("seq") < F.col("_seq")), "left_anti")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Key and stored columns of every visible document."""
    return _visible(_segments(spark, folder, "documents"), spark, folder).drop("seq")


def postings(spark: SparkSession, folder: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Visible postings of some terms of some fields; partitions and row groups without them are not read."""
    kind = dict(_segments(spark, folder, "documents").dtypes)["doc"].replace("bigint", "long")
    rows = _segments(spark, folder, "postings", f"{postings_sql(kind)}, bucket int")
    words = sorted({t for ts in wanted.values() for t in ts})
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"))).distinct().collect()] if words else []
    one = [(F.col("field") == f) & F.col("term").isin(ts) for f, ts in wanted.items() if ts]
    if not one:
        return rows.where("false")
    return _visible(rows.where(F.col("field").isin(*wanted) & F.col("bucket").isin(buckets) & F.col("term").isin(words)).where(reduce(lambda a, b: a | b, one)), spark, folder)


def frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """``field, term, df, total``; the empty term stands for the field's documents and their length."""
    return _segments(spark, folder, "terms").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def expansions(spark: SparkSession, folder: str, field: str, word: str, prefix: int = 1, most: int = 50) -> list[tuple[str, int]]:
    """Terms of a field within the edits allowed for the word's length, and their distance; nearest first."""
    k = edits_allowed(len(word))
    known = _segments(spark, folder, "terms").where((F.col("field") == field) & F.col("term").startswith(word[:prefix])).select("term").distinct()
    near = known.withColumn("d", F.levenshtein(F.col("term"), F.lit(word), k)).where("d >= 0")
    return [(r[0], r[1]) for r in near.orderBy("d", "term").limit(most).collect()]


def search(
    spark: SparkSession, folder: str, query: str, boosts: dict[str, float], share: float = 0.0, fuzzy: bool = False, size: int | None = 10
) -> DataFrame:
    """``doc, score``: the best field's boosted BM25 of documents that hold at least ``share`` of the query's terms in it.

    A fuzzy term counts as the best of its expansions, each less by its share of edited letters.
    """
    fields = manifest(spark, folder)["fields"]
    weights: list[tuple[str, int, str, float]] = []
    need: dict[str, int] = {}
    for f in boosts:
        words = ANALYSERS[fields[f]](query)
        need[f] = max(1, math.floor(share * len(words)))
        for k, w in enumerate(words):
            near = expansions(spark, folder, f, w) if fuzzy else [(w, 0)]
            weights += [(f, k, t, 1.0 - d / max(len(w), 1)) for t, d in near]
    wanted = {f: sorted({t for g, _, t, _ in weights if g == f}) for f in boosts}
    asked = F.broadcast(spark.createDataFrame(weights, "field string, at int, term string, weight double"))  # a row for each term asked for
    told = frequencies(spark, folder).where(F.col("field").isin(*boosts) & F.col("term").isin("", *{t for ts in wanted.values() for t in ts}))
    sizes = told.where("term = ''").select("field", F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("mean"))
    terms = F.broadcast(told.where("term <> ''").join(sizes, "field").select("field", "term", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean"))
    part = F.col("weight") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    hits = postings(spark, folder, wanted).join(terms, ["field", "term"]).join(asked, ["field", "term"])
    words = hits.groupBy("doc", "field", "at").agg(F.max(part).alias("s"))
    table = F.create_map(*[F.lit(x) for f in boosts for x in (f, float(boosts[f]))])
    least = F.create_map(*[F.lit(x) for f in boosts for x in (f, need[f])])
    of_field = words.groupBy("doc", "field").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least[F.col("field")])
    scores = of_field.groupBy("doc").agg(F.max(F.col("s") * table[F.col("field")]).alias("score"))
    return scores if size is None else scores.orderBy(F.desc("score"), "doc").limit(size)


def phrase(spark: SparkSession, folder: str, query: str, fields: Sequence[str]) -> DataFrame:
    """``doc, field, places``: documents that hold the query's terms one after the other, and where."""
    kinds = manifest(spark, folder)["fields"]
    words = {f: ANALYSERS[kinds[f]](query) for f in fields}
    asked = [(f, k, t) for f, ws in words.items() for k, t in enumerate(ws)]
    at = F.broadcast(spark.createDataFrame(asked, "field string, at int, term string"))  # a row for each word of the phrase
    hits = postings(spark, folder, {f: sorted(set(ws)) for f, ws in words.items()}).join(at, ["field", "term"])
    starts = F.transform("places", lambda p: p - F.col("at"))
    # at most a row for each word of the phrase meets here
    met = hits.select("doc", "field", starts.alias("p")).groupBy("doc", "field").agg(F.collect_list("p").alias("p"))
    length = F.create_map(*[F.lit(x) for f, ws in words.items() for x in (f, len(ws))])
    common = F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0)), F.array_intersect)
    return met.where(F.size("p") == length[F.col("field")]).select("doc", "field", F.array_sort(common).alias("places")).where("size(places) > 0")
