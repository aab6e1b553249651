"""Full-text search over ``documents``: BM25, fields, phrases, fuzzy terms, more-like-this, highlights."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions import normalize as N
from millrace.operators import relational, search_index, text
from millrace.session import checkpoint_folder

QUERY = ["annual", "report", "exports"]
FIELDS = {"EN": {"title_en": 3.0, "body_en": 1.0}, "RU": {"title_ru": 3.0, "body_ru": 1.0}}


def fields_for(lang: str) -> dict[str, float]:
    """Boosted fields of a language; anything but EN and RU means all."""
    return FIELDS.get(lang.upper(), FIELDS["EN"] | FIELDS["RU"])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def search_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every document under its id with title and length of its body."""
    q = _docs(spark, d)
    title, body = N.title_and_body(F.col("text"), F.regexp_extract("path", r"([^/]+)\.txt$", 1))
    return q.where("text is not null").select("doc_id", F.concat_ws(":", F.upper(F.split("path", "/")[0]), "path").alias("key"), title.alias("title"), F.length(body).alias("n_body"))


def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by key: the document fetched last stands for its key."""
    return relational.keep_first(_docs(spark, d).select("id", "doc_id", "fetched_at").where("id is not null"), ["id"], [F.col("fetched_at").isNull(), F.negative(F.unix_micros(F.col("fetched_at").cast("timestamp"))), F.negative("doc_id")]).select("id", "doc_id")


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return text.bm25(_docs(spark, d), "doc_id", {"body_en": 1.0}, QUERY).select("doc_id", F.round("score", 6).alias("score"))


def bm25_best_fields(spark: SparkSession, d: str) -> DataFrame:
    """Best field of title (three times the weight) and body, in all languages."""
    return text.bm25(_docs(spark, d), "doc_id", fields_for("ALL"), QUERY).select("doc_id", F.round("score", 6).alias("score"))


def min_should_match(spark: SparkSession, d: str) -> DataFrame:
    """At least 70 percent of the query's words in one field."""
    return text.bm25(_docs(spark, d), "doc_id", fields_for("EN"), QUERY, 0.7).select("doc_id", F.round("score", 6).alias("score"))


def search_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best hits with title, path and snippet."""
    hits = text.top_hits(text.bm25(_docs(spark, d), "doc_id", fields_for("EN"), QUERY).withColumn("score", F.round("score", 6)), "doc_id")
    info = _docs(spark, d).select("doc_id", F.coalesce(F.nullif("title_en", F.lit("")), F.nullif("title_ru", F.lit("")), F.lit("")).alias("title"), "path", "language", text.highlight(F.coalesce("body_en", F.lit("")), QUERY).alias("snippet"))
    return info.join(F.broadcast(hits), "doc_id").select("doc_id", "score", "title", "path", "language", "snippet")  # ten rows


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(text.contains_phrase(F.col("body_en"), "annual report on exports") | text.contains_phrase(F.col("title_en"), "annual report on exports")).select("doc_id")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return text.document_frequency(text.term_counts(_docs(spark, d).where("body_en is not null"), "doc_id", text.terms(F.col("body_en"))))


def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of the corpus within two edits of a misspelt one."""
    return text.fuzzy_terms(_vocabulary(spark, d), "govermnent").unionByName(text.fuzzy_terms(_vocabulary(spark, d), "repart")).unionByName(text.fuzzy_terms(_vocabulary(spark, d), "counsil"))


def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the telling words of every document whose id is divisible by 100, over the bodies of all languages."""
    return text.more_like_these(_docs(spark, d), "doc_id", ["body_en", "body_ru"], F.col("doc_id") % 100 == 0)


def highlight(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.highlight(F.col("body_en"), QUERY).alias("snippet")).where("snippet <> ''")


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of words at most two apart in English titles, with how often they meet."""
    t = _docs(spark, d).where("title_en is not null").select("doc_id", F.posexplode(text.terms(F.col("title_en"))).alias("pos", "term"))
    # positions are matched by exploding each word to the places it reaches, an equi-join without ranges
    reach = t.select("doc_id", "term", F.explode(F.array(F.col("pos") + 1, F.col("pos") + 2)).alias("pos"))
    return reach.withColumnRenamed("term", "left").join(t.withColumnRenamed("term", "right"), ["doc_id", "pos"]).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def text_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """``cooccurrence`` within the title and within the body of every document, in all languages."""
    words = lambda c: text.terms(F.col(c))
    # a pair lies within a field, so the lists are shifted against themselves and nothing is joined
    t = _docs(spark, d).select(F.explode(F.array(*[words(c) for c in FIELDS["EN"] | FIELDS["RU"]])).alias("w"))
    shifted = lambda k: F.arrays_zip(F.col("w").alias("left"), F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))).alias("right"))
    pairs = t.select(F.explode(F.concat(shifted(1), shifted(2))).alias("p")).where("p.right is not null")
    return pairs.groupBy("p.left", "p.right").agg(F.count(F.lit(1)).alias("n"))


def _index(spark: SparkSession, d: str) -> str:
    """Folder of an index of the documents, built where there is none of these files yet."""
    status = search_index._files(spark, d).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet"))
    stamp = hashlib.md5(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}".encode()).hexdigest()
    folder = f"{checkpoint_folder(spark)}/index-{stamp}"
    if not search_index.manifest(spark, folder)["segments"]:
        search_index.build(_docs(spark, d), folder, dict.fromkeys(fields_for("ALL"), "plain"), stored=["path", "language"])
    return folder


def index_best_fields(spark: SparkSession, d: str) -> DataFrame:
    """``bm25_best_fields`` from postings: only those of the query's terms are read."""
    return search_index.search(spark, _index(spark, d), " ".join(QUERY), fields_for("ALL"), size=None).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def index_min_match(spark: SparkSession, d: str) -> DataFrame:
    return search_index.search(spark, _index(spark, d), " ".join(QUERY), fields_for("EN"), 0.7, size=None).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def index_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a phrase, from the places in the postings."""
    return search_index.phrase(spark, _index(spark, d), "annual report on exports", list(fields_for("ALL"))).select(F.col("doc").alias("doc_id"), "field", F.size("places").alias("n"))


def index_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The ten best hits of misspelt words, each counted as its best expansion, with what is stored of them."""
    folder = _index(spark, d)
    hits = search_index.search(spark, folder, "anual repart exprots", fields_for("ALL"), fuzzy=True)
    return search_index.documents(spark, folder).join(F.broadcast(hits), "doc").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "path", "language")  # ten rows


def index_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """A search of stems: English and Russian analysers over their own fields."""
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    kinds = {f: "english" if f.endswith("_en") else "russian" for f in fields_for("ALL")}
    search_index.build(_docs(spark, d), folder, kinds)
    return search_index.search(spark, folder, "annual reports exporting экспорта", fields_for("ALL"), size=None).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Articles by ``id``: those fetched first are indexed, all are upserted, and the latest of each stands."""
    docs = _docs(spark, d).select("id", "doc_id", "fetched_at", "title_en", "body_en").where("id is not null")
    newest = [F.col("fetched_at").isNull(), F.negative(F.unix_micros(F.col("fetched_at").cast("timestamp"))), F.negative("doc_id")]
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    search_index.build(docs, folder, dict.fromkeys(("title_en", "body_en"), "plain"), "id", order=[F.col("fetched_at").isNull(), F.col("fetched_at"), F.col("doc_id")])
    search_index.upsert(docs, folder, newest)
    search_index.compact(spark, folder, search_index.latest(docs, "id", newest))
    return search_index.search(spark, folder, " ".join(QUERY), fields_for("EN"), size=None).select(F.col("doc").alias("id"), F.round("score", 6).alias("score"))


INDEX_QUERIES = (index_best_fields, index_min_match, index_phrase, index_fuzzy, index_stemmed, index_upsert)
QUERIES = {
    f.__name__: f
    for f in (search_docs, latest_by_key, bm25_search, bm25_best_fields, min_should_match, search_top, phrase_search, fuzzy_terms, more_like_this, highlight, cooccurrence, text_cooccurrence, *INDEX_QUERIES)
}

_CUT = "[^a-z0-9а-яёіїєґ]+"


def _words(f: str, least: int = 2) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({f}, '')), '{_CUT}'), lambda x: length(x) >= {least})"


def _bm25_sql(fields: dict[str, float], words: list[str], need: int, source: str = "documents", key: str = "doc_id") -> str:
    parts = []
    for f, boost in fields.items():
        parts.append(f"""
        select {key}, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * {boost} as s from (
          select w.{key}, q.term, len(list_filter(w.w, lambda x: x = q.term)) as tf, len(w.w) as dl from (select {key}, {_words(f)} as w from {source}) w, (select unnest({words!r}) as term) q) t
        join (select term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) as idf from (select q.term, count(*) filter (list_contains(w, q.term)) as df, any_value(n) as n from (select {_words(f)} as w from {source}), (select unnest({words!r}) as term) q,
             (select count(*) filter (len({_words(f)}) > 0) as n from {source}) group by 1)) using (term), (select avg(len({_words(f)})) filter (len({_words(f)}) > 0) as avgdl from {source})
        where tf > 0 group by {key} having count(*) >= {need}""")
    return f"select {key}, max(s) as score from (" + " union all ".join(parts) + ") group by 1"


_PIECES = "list_transform(range(0, cast(greatest(floor((length(coalesce({0}, '')) - 1) / 160), 0) as int) + 1), lambda i: substring({0}, i * 160 + 1, 160))"


def _highlight_sql(f: str) -> str:
    p = "(?i)\\b(" + "|".join(QUERY) + ")\\b"
    return f"array_to_string(list_transform(list_filter({_PIECES.format(f)}, lambda x: regexp_matches(x, '{p}'))[1:2], lambda x: regexp_replace(x, '{p}', '<mark>\\1</mark>', 'g')), ' ... ')"


def _fuzzy_sql(word: str) -> str:
    # the checker's distance counts bytes, so each letter beyond ASCII is made one byte that no query word has
    d = f"levenshtein(regexp_replace(term, '[^a-z0-9]', '~', 'g'), '{word}')"
    return f"(select term, {d} as distance from voc where term[1] = '{word[0]}' and {d} <= {text.edits_allowed(len(word))} order by 2, 1 limit 50)"


_PHRASE = "contains(' ' || array_to_string({0}, ' ') || ' ', ' annual report on exports ')"
_LATEST = "(select * from (select *, row_number() over (partition by id order by fetched_at desc nulls last, doc_id desc) as _n from documents where id is not null) where _n = 1)"
_PHRASE_PLACES = "len(list_filter(range(1, len({0}) - 2), lambda i: array_to_string({0}[i:i + 3], ' ') = 'annual report on exports'))"
SQL = {
    "index_best_fields": f"select doc_id, round(score, 6) as score from ({_bm25_sql(fields_for('ALL'), QUERY, 1)})",
    "index_min_match": f"select doc_id, round(score, 6) as score from ({_bm25_sql(fields_for('EN'), QUERY, 2)})",
    "index_phrase": "select * from (" + " union all ".join(f"select doc_id, '{f}' as field, {_PHRASE_PLACES.format('w')} as n from (select doc_id, {_words(f)} as w from documents)" for f in fields_for("ALL")) + ") where n > 0",
    "index_upsert": f"select id, round(score, 6) as score from ({_bm25_sql(fields_for('EN'), QUERY, 1, _LATEST, 'id')})",
    "search_docs": r"""select doc_id, upper(string_split(path, '/')[1]) || ':' || path as key,
        coalesce(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\v\f\r\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{85}\x{B}]+|[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{85}\x{B}]+$', '', 'g')), lambda x: x <> '')[1], regexp_extract(path, '([^/]+)\.txt$', 1)) as title,
        length(regexp_replace(text, '^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{85}\x{B}]+|[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}\x{85}\x{B}]+$', '', 'g')) as n_body from documents where text is not null""",
    "latest_by_key": "select id, doc_id from (select id, doc_id, row_number() over (partition by id order by fetched_at desc nulls last, doc_id desc) as n from documents where id is not null) where n = 1",
    "bm25_search": f"select doc_id, round(score, 6) as score from ({_bm25_sql({'body_en': 1.0}, QUERY, 1)})",
    "bm25_best_fields": f"select doc_id, round(score, 6) as score from ({_bm25_sql(fields_for('ALL'), QUERY, 1)})",
    "min_should_match": f"select doc_id, round(score, 6) as score from ({_bm25_sql(fields_for('EN'), QUERY, 2)})",
    "search_top": f"""select doc_id, score, coalesce(nullif(title_en, ''), nullif(title_ru, ''), '') as title, path, language, {_highlight_sql("coalesce(body_en, '')")} as snippet
        from (select doc_id, round(score, 6) as score from ({_bm25_sql(fields_for('EN'), QUERY, 1)}) order by round(score, 6) desc, doc_id limit 10) join documents using (doc_id)""",
    "phrase_search": f"select doc_id from documents where {_PHRASE.format(_words('body_en', 1))} or {_PHRASE.format(_words('title_en', 1))}",
    "fuzzy_terms": f"with voc as (select distinct unnest({_words('body_en')}) as term from documents) {_fuzzy_sql('govermnent')} union all {_fuzzy_sql('repart')} union all {_fuzzy_sql('counsil')}",
    "highlight": f"select doc_id, {_highlight_sql('body_en')} as snippet from documents where body_en is not null and {_highlight_sql('body_en')} <> ''",
    "text_cooccurrence": "with w as (" + " union all ".join(f"select {_words(f)} as w from documents" for f in fields_for("ALL")) + """),
        p as (select unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) as p from w where len(w) > 1 union all select unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 2]])) from w where len(w) > 2)
        select p[1] as "left", p[2] as "right", count(*) as n from p group by 1, 2""",
    "cooccurrence": f"""with t as (select doc_id, unnest({_words('title_en')}) as term, generate_subscripts({_words('title_en')}, 1) as pos from documents where title_en is not null)
        select a.term as "left", b.term as "right", count(*) as n from t a join t b on a.doc_id = b.doc_id and b.pos - a.pos between 1 and 2 group by 1, 2""",
}
