"""Interactions, splits and content-based recommendation over ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions import normalize
from millrace.operators import recommend, relational, text
from millrace.session import batches_of, durable

#: The first article; an event's key counts from it.
FIRST_ARTICLE = 1001


def articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("content_id"), "lang", "text")


def events(spark: SparkSession, d: str) -> DataFrame:
    shifted = F.concat(F.lit('{"k": '), (F.get_json_object("props", "$.k").cast("long") + FIRST_ARTICLE).cast("string"), F.lit("}"))
    return table(spark, d, "events").select("user_id", "event_type", "ts", "value", shifted.alias("props"))


def _interactions(spark: SparkSession, d: str) -> DataFrame:
    return recommend.interactions(events(spark, d), articles(spark, d))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return relational.leave_last_out(recommend.eligible(_interactions(spark, d)), "person_id", ["ts", "content_id"])


def interaction_strength(spark: SparkSession, d: str) -> DataFrame:
    return _interactions(spark, d)


def eligible_users(spark: SparkSession, d: str) -> DataFrame:
    return _interactions(spark, d).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("total")).where("n >= 5")


def semi_join_eligible(spark: SparkSession, d: str) -> DataFrame:
    return recommend.eligible(_interactions(spark, d)).select("person_id", "content_id", "strength")


def leave_last_out_test(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[1]


def leave_last_out_train(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[0]


def right_join_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the persons that read them, unread articles with a null person."""
    i = _interactions(spark, d).select("content_id", "person_id", "strength")
    return i.join(articles(spark, d).select("content_id", "lang"), "content_id", "right").select("content_id", "person_id", "strength", "lang")


def value_counts_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("events"))


def activity_curve(spark: SparkSession, d: str) -> DataFrame:
    """How many persons have how many events."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events")).groupBy("n_events").agg(F.count(F.lit(1)).alias("n_users"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Total strength of every person in a hundred bins of equal width."""
    s = _interactions(spark, d).groupBy("person_id").agg(F.sum("strength").alias("total"))
    edge = s.agg(F.min("total").alias("low"), F.max("total").alias("high"))
    width = (F.col("high") - F.col("low")) / 100
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("total") - F.col("low")) / F.when(width > 0, width)), F.lit(99)))
    return s.crossJoin(F.broadcast(edge)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row is broadcast


def random_split_train(spark: SparkSession, d: str) -> DataFrame:
    """Persons' interactions split 70 to 30, stratified by person."""
    i = _interactions(spark, d).withColumn("key", F.col("person_id") * 100_000 + F.col("content_id"))
    return relational.stratified_split(i, F.col("person_id"), "key", 0.3, 13).where("part = 'train'").select("person_id", "content_id", "strength")


def _english_terms(spark: SparkSession, d: str) -> tuple[DataFrame, str, Column, int]:
    docs = articles(spark, d).where("lang = 'en'")
    return docs, "content_id", text.with_ngrams(text.without_stop_words(text.terms(F.col("text")))), docs.count()


def _vectors(spark: SparkSession, d: str, limit: int = 5000, min_df: int = 2, max_df: float = 0.8) -> DataFrame:
    return text.tfidf(*_english_terms(spark, d), min_df, max_df, limit)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of every English text, counted."""
    docs = articles(spark, d).where("lang = 'en'")
    return text.term_counts(docs, "content_id", text.terms(F.col("text")))


def ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring words of every English text, counted."""
    docs = articles(spark, d).where("lang = 'en'")
    return text.term_counts(docs, "content_id", text.once(text.terms(F.col("text")), lambda w: text.ngrams(w)))


def term_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return text.document_frequency(tokens(spark, d))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("content_id", "term", F.round("w", 6).alias("w"))


def tfidf_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The commonest thousand terms without limits of frequency."""
    return _vectors(spark, d, 1000, 1, 1.0).select("content_id", "term", F.round("w", 6).alias("w"))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train, test = map(durable, _split(spark, d))
    vectors, terms = text.tfidf_rows(*_english_terms(spark, d))
    with batches_of(spark, text.ROWS_AT_ONCE):
        vectors = durable(vectors)
    return recommend.top_unseen(train, vectors, terms), test


def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    train, _ = _split(spark, d)
    return recommend.profiles(train, _vectors(spark, d)).select("person_id", "term", F.round("w", 6).alias("w"))


def recommend_topn(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)[0].select("person_id", "content_id", F.round("score", 5).alias("score"))


def rec_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked, test = _ranked(spark, d)
    return recommend.ranking_metrics(test, ranked).select(*[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr_at_10")], "persons")


def baseline_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank of the held-out item among the commonest items, a miss counting as the last place."""
    train, test = _split(spark, d)
    counts = train.groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))
    popular = relational.dense_ids(counts.withColumn("_o", F.struct(F.negative("n").alias("n"), "content_id")), "_o").select("content_id", (F.col("id") + 1).alias("rank"))
    n = popular.count()
    return test.join(popular, "content_id", "left").agg(F.round(F.avg(1.0 / F.coalesce("rank", F.lit(max(n, 1)))), 6).alias("mrr"))


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Title and body of every document as one text."""
    return table(spark, d, "documents").select("doc_id", F.md5(normalize.title_and_text(F.coalesce("title_en", "title_ru"), F.coalesce("body_en", "body_ru"))).alias("text"))


def recommend_with_articles(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations with what is known of their articles; an unknown article keeps its row."""
    known = table(spark, d, "documents").select(F.col("doc_id").alias("content_id"), "lang", F.coalesce("title_en", "title_ru").alias("title"))
    return recommend_topn(spark, d).join(known, "content_id", "left").select("person_id", "content_id", "score", "lang", "title")


QUERIES = {
    f.__name__: f
    for f in (
        interaction_strength, eligible_users, semi_join_eligible, leave_last_out_test, leave_last_out_train, right_join_articles, value_counts_lang, distinct_users,
        activity_curve, score_histogram, random_split_train, tokens, ngrams, term_doc_freq, tfidf, tfidf_baseline, user_profiles, recommend_topn, rec_metrics, baseline_mrr, document_texts, recommend_with_articles,
    )
}

_I = """
art as (select doc_id as content_id, lang, text from documents where text is not null),
inter as (
  select e.user_id as person_id, cast(json_extract(e.props, '$.k') as bigint) + 1001 as content_id,
         max(case event_type when 'view' then 1.0 when 'click' then 2.0 else 5.0 end)::double as strength, max(ts) as ts
  from events e join art on art.content_id = cast(json_extract(e.props, '$.k') as bigint) + 1001
  where event_type in ('view', 'click', 'purchase') group by 1, 2),
elig as (select * from inter where person_id in (select person_id from inter group by 1 having count(*) >= 5)),
split as (select *, row_number() over (partition by person_id order by ts desc, content_id desc) as n from elig),
train as (select person_id, content_id, strength, ts from split where n > 1),
test as (select person_id, content_id, strength, ts from split where n = 1)"""
_TOK = """
tok as (select content_id, list_filter(string_split_regex(lower(text), '[^a-z0-9а-яёіїєґ]+'), lambda x: length(x) >= 2) as w from art where lang = 'en')"""
_STOP = "(" + ",".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


def _tfidf_sql(limit: int, min_df: int, max_df: float) -> str:
    return f"""
{_TOK},
kept as (select content_id, list_filter(w, lambda x: x not in {_STOP}) as w from tok),
grams as (
  select content_id, unnest(w) as term from kept
  union all
  select content_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) from kept),
tf as (select content_id, term, count(*) as tf from grams where term is not null group by 1, 2),
nd as (select count(*) as n from tok),
voc as (
  select term, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from (select term, count(*) as df, sum(tf) as total from tf group by 1), nd
  where df >= {min_df} and df <= {max_df} * n order by total desc, term limit {limit}),
raw as (select content_id, term, tf * idf as w from tf join voc using (term)),
vec as (select content_id, term, w / sqrt(sum(w * w) over (partition by content_id)) as w from raw)"""


_PROFILE = """
pw as (select person_id, sum(strength) as tot from train group by 1),
prof as (select person_id, term, sum(strength * w) / any_value(tot) as w from train join vec using (content_id) join pw using (person_id) group by 1, 2)"""
_RANKED = """
pn as (select person_id, sqrt(sum(w * w)) as norm from prof group by 1),
sc as (select person_id, v.content_id, round(sum(p.w * v.w) / any_value(norm), 9) as score from prof p join vec v using (term) join pn using (person_id) group by 1, 2),
ranked as (
  select * from (select *, row_number() over (partition by person_id order by score desc, content_id) as rank
  from sc where not exists (select 1 from train t where t.person_id = sc.person_id and t.content_id = sc.content_id)) where rank <= 10)"""

SQL = {
    "interaction_strength": f"with {_I} select * from inter",
    "eligible_users": f"with {_I} select person_id, count(*) as n, sum(strength) as total from inter group by 1 having count(*) >= 5",
    "semi_join_eligible": f"with {_I} select person_id, content_id, strength from elig",
    "leave_last_out_test": f"with {_I} select * from test",
    "leave_last_out_train": f"with {_I} select * from train",
    "right_join_articles": f"with {_I} select content_id, person_id, strength, lang from art left join inter using (content_id)",
    "value_counts_lang": "select lang, count(*) as n from documents group by 1",
    "distinct_users": "select count(distinct user_id) as users, count(distinct event_type) as kinds, count(*) as events from events",
    "activity_curve": "select n_events, count(*) as n_users from (select user_id, count(*) as n_events from events group by 1) group by 1",
    "score_histogram": f"""with {_I}, s as (select person_id, sum(strength) as total from inter group by 1), e as (select min(total) as lo, max(total) as hi from s)
        select cast(case when hi = lo then 0 else least(floor((total - lo) / ((hi - lo) / 100)), 99) end as int) as bin, count(*) as n from s, e group by 1""",
    "random_split_train": f"""with {_I}, h as (select *, {relational.order_hash_sql('person_id * 100000 + content_id', 13)} as h from inter),
        r as (select *, row_number() over (partition by person_id order by h, person_id * 100000 + content_id) as r, count(*) over (partition by person_id) as n from h)
        select person_id, content_id, strength from r where r > round(n * 0.3)""",
    "tokens": f"with {_I}, {_TOK} select content_id, term, count(*) as tf from (select content_id, unnest(w) as term from tok) group by 1, 2",
    "ngrams": f"with {_I}, {_TOK} select content_id, term, count(*) as tf from (select content_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as term from tok) group by 1, 2",
    "term_doc_freq": f"with {_I}, {_TOK}, c as (select content_id, term, count(*) as tf from (select content_id, unnest(w) as term from tok) group by 1, 2) select term, count(*) as df, cast(sum(tf) as bigint) as total from c group by 1",
    "tfidf": f"with {_I}, {_tfidf_sql(5000, 2, 0.8)} select content_id, term, round(w, 6) as w from vec",
    "tfidf_baseline": f"with {_I}, {_tfidf_sql(1000, 1, 1.0)} select content_id, term, round(w, 6) as w from vec",
    "user_profiles": f"with {_I}, {_tfidf_sql(5000, 2, 0.8)}, {_PROFILE} select person_id, term, round(w, 6) as w from prof",
    "recommend_topn": f"with {_I}, {_tfidf_sql(5000, 2, 0.8)}, {_PROFILE}, {_RANKED} select person_id, content_id, round(score, 5) as score from ranked",
    "rec_metrics": f"""with {_I}, {_tfidf_sql(5000, 2, 0.8)}, {_PROFILE}, {_RANKED},
        hit as (select t.person_id, min(rank) as first from test t left join ranked r on r.person_id = t.person_id and r.content_id = t.content_id group by 1)
        select round(avg(case when first <= 5 then 1.0 else 0.0 end), 6) as recall_at_5, round(avg(case when first <= 10 then 1.0 else 0.0 end), 6) as recall_at_10,
               round(avg(case when first <= 10 then 1.0 / first else 0.0 end), 6) as mrr_at_10, count(*) as persons from hit""",
    "document_texts": "select doc_id, md5(regexp_replace(coalesce(title_en, title_ru, '') || ' ' || coalesce(body_en, body_ru, ''), '^[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x{85}\\x{B}]+|[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x{85}\\x{B}]+$', '', 'g')) as text from documents",
    "recommend_with_articles": f"with {_I}, {_tfidf_sql(5000, 2, 0.8)}, {_PROFILE}, {_RANKED} select person_id, content_id, round(score, 5) as score, lang, coalesce(title_en, title_ru) as title from ranked left join documents on doc_id = content_id",
    "baseline_mrr": f"""with {_I}, pop as (select content_id, row_number() over (order by count(*) desc, content_id) as rank from train group by 1)
        select round(avg(1.0 / coalesce(rank, (select count(*) from pop))), 6) as mrr from test left join pop using (content_id)""",
}
