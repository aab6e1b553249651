"""Full-text operators: tokens, n-grams, TF-IDF, BM25 over fields, phrases, fuzzy terms, more-like-this, highlights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import batches_of, durable

#: English words left out before n-grams.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not "
    "now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with you your"
).split()

K1, B = 1.2, 0.75


def terms(text: Column, least: int = 2) -> Column:
    """Words of Latin and Cyrillic letters and digits in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9а-яёіїєґ]+"), lambda t: F.length(t) >= least)


def without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Neighbouring words joined by a blank; shifted copies of the list are zipped, so the list is built ``n`` times and not once a word."""
    out = tokens
    for k in range(1, n):
        rest = F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1)))
        out = F.filter(F.zip_with(out, rest, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return out


def _runs(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, count) of the different terms of each list, by one sort of the batch's codes."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    codes = pc.list_flatten(lists).dictionary_encode()
    terms, at = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    key, count = np.unique(row * max(len(terms), 1) + at, return_counts=True)
    return key // max(len(terms), 1), terms.take(pa.array(key % max(len(terms), 1))), count


#: Rows of a batch whose terms are counted at a time; their codes take many times the memory of the batch.
ROWS_AT_ONCE = 500


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE))


def _counts(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches):
        row, term, count = _runs(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), term, pa.array(count)], names=[id_col, "term", "tf"])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is derived once, however often it is used: through an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_ngrams(tokens: Column, n: int = 2) -> Column:
    """Words and their neighbours joined, of words that are made once."""
    return once(tokens, lambda w: F.concat(w, ngrams(w, n)))


def term_counts(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``id, term, tf``, counted within each row, so no token is shuffled to be counted."""
    rows = df.select(id_col, tokens.alias("_w"))
    return rows.mapInArrow(partial(_counts, id_col=id_col), f"{id_col} {rows.schema[0].dataType.simpleString()}, term string, tf long")


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def _weigh(batches: Iterator[pa.RecordBatch], id_col: str, vocabulary) -> Iterator[pa.RecordBatch]:
    """Rows of unit length over the vocabulary's terms."""
    known, idf = vocabulary.value
    known = pa.array(known, pa.string())
    for b in _pieces(batches):
        row, term, count = _runs(b.column(1))
        at = pc.index_in(term, value_set=known)
        keep = pc.is_valid(at).to_numpy(zero_copy_only=False)
        row, term, w = row[keep], term.filter(pa.array(keep)), count[keep] * idf[at.drop_null().to_numpy()]
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), term, pa.array(w / norm[row])], names=[id_col, "term", "w"])


def _weigh_rows(batches: Iterator[pa.RecordBatch], id_col: str, vocabulary) -> Iterator[pa.RecordBatch]:
    """:func:`_weigh` with a row for each row that has terms, which are told by their place in the vocabulary."""
    known = pa.array(vocabulary.value[0], pa.string())
    for b in _pieces(batches):
        for long in _weigh(iter([b]), id_col, vocabulary):
            ids = long.column(0)
            first = np.flatnonzero(np.concatenate([[True], ids.to_numpy()[1:] != ids.to_numpy()[:-1]])) if len(ids) else np.zeros(0, dtype=int)
            ends = pa.array(np.append(first, len(ids)).astype("int32"))
            at = pc.index_in(long.column(1), value_set=known)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.ListArray.from_arrays(ends, at), pa.ListArray.from_arrays(ends, long.column(2))], names=[id_col, "at", "w"])


#: Terms of a vocabulary that may be sent to every task.
MOST_TERMS = 1_000_000


def _vocabulary(df: DataFrame, id_col: str, tokens: Column, n_docs: int, min_df: int, max_df: float, max_features: int) -> tuple[list[str], np.ndarray]:
    """The commonest terms and their smoothed idf."""
    if max_features > MOST_TERMS:
        raise ValueError(f"{max_features} terms; the vocabulary sent to every task has at most {MOST_TERMS}")
    common = document_frequency(term_counts(df, id_col, tokens)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).orderBy(F.desc("total"), "term").limit(max_features)
    with batches_of(df.sparkSession, ROWS_AT_ONCE):
        found = common.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")).collect()
    return [r[0] for r in found], np.array([r[1] for r in found], dtype=float)


def tfidf(df: DataFrame, id_col: str, tokens: Column, n_docs: int, min_df: int = 2, max_df: float = 0.8, max_features: int = 5000) -> DataFrame:
    """``id, term, w``: smoothed idf, rows of unit length, over the commonest terms.

    One pass counts in how many rows each term is; the vocabulary, at most ``max_features``
    terms, goes to every task, and a second pass weighs each row within itself, so only term
    counts are shuffled.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(_vocabulary(df, id_col, tokens, n_docs, min_df, max_df, max_features))
    rows = df.select(id_col, tokens.alias("_w"))
    return rows.mapInArrow(partial(_weigh, id_col=id_col, vocabulary=vocabulary), f"{id_col} {rows.schema[0].dataType.simpleString()}, term string, w double")


def tfidf_rows(df: DataFrame, id_col: str, tokens: Column, n_docs: int, min_df: int = 2, max_df: float = 0.8, max_features: int = 5000) -> tuple[DataFrame, int]:
    """``id, at, w``, the weights of :func:`tfidf` with a row for each row that has any, terms told by their place; and how many terms there are."""
    found = _vocabulary(df, id_col, tokens, n_docs, min_df, max_df, max_features)
    vocabulary = df.sparkSession.sparkContext.broadcast(found)
    rows = df.select(id_col, tokens.alias("_w"))
    return rows.mapInArrow(partial(_weigh_rows, id_col=id_col, vocabulary=vocabulary), f"{id_col} {rows.schema[0].dataType.simpleString()}, at array<int>, w array<double>"), len(found[0])


def term_weights(counts: DataFrame, id_col: str, n_docs: int) -> DataFrame:
    """``id, term, raw, relative``: counts by the logarithm of rarity, and shares of the document's commonest term by the binary one.

    Both sides of the join follow the data; the commonest count of a document is one row for it.
    """
    df = document_frequency(counts).select("term", "df")
    most = counts.groupBy(id_col).agg(F.max("tf").alias("_most"))
    rare = F.lit(float(n_docs)) / F.col("df")
    t = counts.join(df, "term").join(most, id_col)
    return t.select(id_col, "term", (F.col("tf") * F.log(rare)).alias("raw"), (F.col("tf") / F.col("_most") * F.log2(rare)).alias("relative"))


def _equals(word: str):
    return lambda t: t == word


def bm25(df: DataFrame, id_col: str, fields: dict[str, float], query: list[str], share: float = 0.0) -> DataFrame:
    """``id, score``: best field's boosted BM25 for documents that hold at least ``share`` of the query's words in it.

    For a corpus that is searched once; ``search_index`` is for one that is searched often.
    Every field is cut into words once and leaves a length and a count for each word of the
    query; those are written, and frequencies, mean lengths and scores come from them, so no
    posting is shuffled to a word that a third of the corpus holds.
    """
    need = max(1, math.floor(share * len(query)))

    def counts(tok: Column) -> Column:
        return F.struct(F.size(tok).cast("double").alias("len"), *[F.size(F.filter(tok, _equals(q))).cast("double").alias(f"tf_{i}") for i, q in enumerate(query)])

    counted = durable(df.select(id_col, *[once(terms(F.col(f)), counts).alias(f"_{k}") for k, f in enumerate(fields)]))
    stats = []
    for k in range(len(fields)):
        length = F.col(f"_{k}.len")
        stats += [F.sum((length > 0).cast("double")).alias(f"n_{k}"), F.avg(F.when(length > 0, length)).alias(f"avg_{k}")]
        stats += [F.sum((F.col(f"_{k}.tf_{i}") > 0).cast("double")).alias(f"df_{k}_{i}") for i in range(len(query))]
    both = counted.crossJoin(F.broadcast(counted.agg(*stats)))  # one row
    best: list[Column] = []
    for k, boost in enumerate(fields.values()):
        score, hits = F.lit(0.0), F.lit(0)
        for i in range(len(query)):
            tf, n, d = F.col(f"_{k}.tf_{i}"), F.col(f"n_{k}"), F.col(f"df_{k}_{i}")
            idf = F.log(1.0 + (n - d + 0.5) / (d + 0.5))
            score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"_{k}.len") / F.col(f"avg_{k}")))).otherwise(0.0)
            hits = hits + (tf > 0).cast("int")
        best.append(F.when(hits >= need, score * boost).otherwise(0.0))
    return both.select(id_col, (F.greatest(*best) if len(best) > 1 else best[0]).alias("score")).where("score > 0")


def top_hits(scores: DataFrame, id_col: str, size: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), id_col).limit(size)


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` stand in the text one after the other."""
    return F.concat(F.lit(" "), F.array_join(terms(text, 1), " "), F.lit(" ")).contains(f" {' '.join(phrase.lower().split())} ")


def edits_allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 6 else 2


def fuzzy_terms(vocabulary: DataFrame, word: str, prefix: int = 1, expansions: int = 50) -> DataFrame:
    """``term, distance``: vocabulary words within the edits allowed for the word's length, nearest first."""
    k = edits_allowed(len(word))
    near = vocabulary.where(F.substring("term", 1, prefix) == word[:prefix]).withColumn("distance", F.levenshtein(F.col("term"), F.lit(word), k))
    return near.where("distance >= 0").orderBy("distance", "term").limit(expansions).select("term", "distance")


def telling_terms(seeds: DataFrame, frequencies: DataFrame, id_col: str, max_terms: int = 25, min_tf: int = 2, min_df: int = 5) -> DataFrame:
    """``id, field, term, df``: the words of every seed with the highest tf-idf.

    ``seeds`` is (id, field, term, tf), ``frequencies`` is (field, term, df, n_docs).
    """
    weight = F.col("tf") * (F.lit(1.0) + F.log(F.col("n_docs") / (F.col("df") + 1.0)))
    known = seeds.where(F.col("tf") >= min_tf).join(frequencies.where(F.col("df") >= min_df), ["field", "term"])
    w = Window.partitionBy(id_col).orderBy(F.desc(F.round(weight, 9)), "term", "field")
    return known.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_terms).select(id_col, "field", "term", "df")


#: Documents and seeds of a block of scores; a block pair holds a dense array of its seeds' words by its documents.
BLOCK = 1000


def more_like_these(df: DataFrame, id_col: str, fields: list[str], seeds: Column, digits: int = 5) -> DataFrame:
    """``seed, id, score``: BM25 of every document for the most telling words of every row that ``seeds`` is true of.

    A seed's words are looked for in the field they stand in, and the fields' scores are added.
    Documents and seeds meet block by block, so neither side is broadcast and no posting is
    shuffled for a seed.
    """
    docs = df.select(id_col, seeds.alias("_seed"), *[terms(F.col(f)).alias(f) for f in fields])
    each = lambda of: F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f).alias("size"), of(f).alias("words")) for f in fields]), lambda x: x["size"] > 0)).alias("x")
    tf = docs.where("_seed").select(id_col, each(F.col)).select(id_col, "x.field", F.explode("x.words").alias("term")).groupBy(id_col, "field", "term").agg(F.count(F.lit(1)).alias("tf"))
    # one pass counts words and, under the empty word, documents and their lengths
    marked = docs.select(each(lambda f: F.concat(F.array(F.lit("")), F.array_distinct(f)))).select("x.field", "x.size", F.explode("x.words").alias("term"))
    counted = durable(marked.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("size"))).alias("length")))
    stats = {r["field"]: r for r in counted.where("term = ''").collect()}  # a row for each field
    n = {f: float(stats[f]["df"]) if f in stats else 0.0 for f in fields}
    mean = {f: stats[f]["length"] / stats[f]["df"] if f in stats else 1.0 for f in fields}
    n_docs = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(n[f]))])
    frequencies = counted.where("term <> ''").select("field", "term", "df", n_docs[F.col("field")].alias("n_docs"))
    idf = F.log(1.0 + (n_docs[F.col("field")] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    chosen = telling_terms(tf, frequencies, id_col).groupBy(F.col(id_col).alias("seed")).agg(F.collect_list(F.struct("field", "term", idf.alias("idf"))).alias("t"))
    q = chosen.select("seed", F.col("t.field").alias("field"), F.col("t.term").alias("term"), F.col("t.idf").alias("idf"))
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(seeds.cast("int")).alias("seeds")).first()
    across, per = max(1, math.ceil(size["rows"] / BLOCK)), max(1, math.ceil((size["seeds"] or 0) / BLOCK))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    d = docs.drop("_seed").withColumn("db", F.pmod(F.hash(id_col), F.lit(across))).withColumn("sb", every(per))
    q = q.withColumn("sb", F.pmod(F.hash("seed"), F.lit(per))).withColumn("db", every(across))
    work = lambda a, b: _block_scores(a, b, id_col, mean, digits)
    return d.groupBy("db", "sb").cogroup(q.groupBy("db", "sb")).applyInArrow(work, f"seed long, {id_col} long, score double")


def _block_scores(docs: pa.Table, seeds: pa.Table, id_col: str, mean: dict[str, float], digits: int) -> pa.Table:
    ids, of = docs[id_col].to_numpy(), seeds["seed"].to_numpy()
    scores = np.zeros((len(of), len(ids)))
    if scores.size:
        lists = seeds["term"].combine_chunks()
        owner = np.repeat(np.arange(len(of)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term, field, idf = (pc.list_flatten(seeds[c].combine_chunks()) for c in ("term", "field", "idf"))
        idf = idf.to_numpy()
        for f, avg in mean.items():
            mine = pc.equal(field, f).to_numpy(zero_copy_only=False)
            wanted = term.filter(pa.array(mine))
            known = pc.unique(wanted)
            tokens = docs[f].combine_chunks()
            length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(pc.list_flatten(tokens), value_set=known), -1).to_numpy()
            place = at.astype("int64") * len(ids) + np.repeat(np.arange(len(ids)), length)
            tf = np.bincount(place[at >= 0], minlength=len(known) * len(ids)).reshape(len(known), len(ids)).astype(float)
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))
            rows = pc.index_in(wanted, value_set=known).to_numpy()
            for s in np.unique(owner[mine]):
                here = owner[mine] == s
                scores[s] += idf[mine][here] @ gain[rows[here]]
        scores[of[:, None] == ids[None, :]] = 0
    s, i = np.nonzero(scores)
    return pa.table({"seed": of[s], id_col: ids[i], "score": np.round(scores[s, i], digits)})


def highlight(text: Column, query: list[str], size: int = 160, most: int = 2) -> Column:
    """Up to ``most`` fragments of ``size`` characters that hold a query word, words marked, joined by dots."""
    pattern = rf"(?i)\b({'|'.join(query)})\b"
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / size), F.lit(0)).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    hit = F.slice(F.filter(pieces, lambda p: p.rlike(pattern)), 1, most)
    return F.array_join(F.transform(hit, lambda p: F.regexp_replace(p, pattern, "<mark>$1</mark>")), " ... ")
