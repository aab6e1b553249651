"""Rating prediction over ``ratings``, ``users`` and ``books``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions import normalize as N
from millrace.operators import ratings as R
from millrace.operators import relational
from millrace.session import durable


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return R.usable(table(spark, d, "ratings"))


def clean_users(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_users(table(spark, d, "users"))


def clean_books(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_books(table(spark, d, "books"))


def _smoothed(key: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _rows(spark, d)
        base = R.enriched(rows, R.clean_users(table(spark, d, "users")), R.clean_books(table(spark, d, "books")))
        out = R.smoothed(base, key, rows.agg(F.avg("rating")).scalar())
        return out.select(key, F.round("mean", 6).alias("mean"), "n")

    query.__doc__ = f"Smoothed mean rating of every {key}."
    return query


def user_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy("user_id").agg(F.round(F.avg("rating"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def book_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy("book_id").agg(F.round(F.avg("rating"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def bias_terms_user(spark: SparkSession, d: str) -> DataFrame:
    return R.fit_biases(_rows(spark, d))[1].select("user_id", F.round("bias", 6).alias("bias"))


def bias_terms_item(spark: SparkSession, d: str) -> DataFrame:
    return R.fit_biases(_rows(spark, d))[2].select("book_id", F.round("bias", 6).alias("bias"))


def bias_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return R.bias_predictions(rows, *R.fit_biases(rows)).select("row_id", F.round("prediction", 6).alias("prediction"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = relational.stratified_split(_rows(spark, d), F.lit(0), "row_id", 0.1)
    return split.where("part = 'train'").drop("part"), split.where("part = 'dev'").drop("part")


def validation_rows(spark: SparkSession, d: str) -> DataFrame:
    """A random tenth of the rows, always the same."""
    return _parts(spark, d)[1].select("row_id")


def bias_rmse(spark: SparkSession, d: str) -> DataFrame:
    """Error of the global mean and of the biases on the held-out tenth."""
    train, dev = _parts(spark, d)
    mu, user, item = R.fit_biases(train)
    p = R.bias_predictions(dev, mu, user, item)
    return p.agg(F.round(F.sqrt(F.avg(F.pow(F.col("rating") - F.lit(mu), 2))), 6).alias("rmse_mean"), F.round(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))), 6).alias("rmse_bias"))


def hybrid_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    out = R.features(rows, rows, R.clean_users(table(spark, d, "users")), R.clean_books(table(spark, d, "books")), R.fit_biases(rows))
    return out.select("row_id", *[F.round(c, 5).alias(c) for c in out.columns if c.startswith("f_")])


def rating_submission(spark: SparkSession, d: str) -> DataFrame:
    """Rounded predictions under dense ids in row order."""
    rows = _rows(spark, d)
    p = R.bias_predictions(rows, *R.fit_biases(rows)).select("row_id", N.round_rating(F.round("prediction", 9)).alias("rating"))
    return relational.dense_ids(p, "row_id").select("id", "rating")


def data_profile(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and shares of the rating data on one row."""
    train, dev = _parts(spark, d)
    rows = train.agg(F.count(F.lit(1)).alias("train_rows"), F.round(F.avg((F.col("rating") == 0).cast("double")) * 100, 6).alias("zero_pct"))
    out = rows
    for key in ("user_id", "book_id"):
        seen = train.select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(1))
        cold = dev.join(seen, F.col(key) == F.col("_k"), "left").agg(F.round(F.avg(F.col("_seen").isNull().cast("double")) * 100, 6).alias(f"cold_{key}_pct"))
        sizes = train.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.median("n"), 6).alias(f"median_{key}"), F.round(F.percentile("n", F.lit(0.99)), 6).alias(f"p99_{key}"))
        out = out.crossJoin(cold).crossJoin(sizes)  # one row each
    users, books = R.clean_users(table(spark, d, "users")), R.clean_books(table(spark, d, "books"))
    ages = users.agg(F.count(F.lit(1)).alias("users"), F.round(F.avg(F.col("age_missing").cast("double")) * 100, 6).alias("invalid_age_pct"))
    years = books.agg(F.count(F.lit(1)).alias("books"), F.round(F.avg(F.col("year_missing").cast("double")) * 100, 6).alias("invalid_year_pct"))
    return out.crossJoin(ages).crossJoin(years)


def hybrid_gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    """Predictions for every row by the model with the lower error on the held-out tenth, fitted again on all rows: biases, or biases with boosted residuals."""
    from millrace.operators.models import boosted_residuals

    users, books = R.clean_users(table(spark, d, "users")), R.clean_books(table(spark, d, "books"))

    def inputs(fitted: DataFrame, *rows: DataFrame) -> list[DataFrame]:
        biases = R.fit_biases(fitted)
        return [durable(R.features(x, fitted, users, books, biases)) for x in (fitted, *rows)]

    e = boosted_residuals(*inputs(*_parts(spark, d))).agg(F.avg(F.pow(F.col("rating") - F.col("f_bias_pred"), 2)).alias("b"), F.avg(F.pow(F.col("rating") - F.col("hybrid"), 2)).alias("h")).first()
    best = "bias" if e["b"] is None or e["b"] <= e["h"] else "hybrid"
    final = inputs(_rows(spark, d))[0]
    prediction = F.col("f_bias_pred") if best == "bias" else F.col("hybrid")
    return (final if best == "bias" else boosted_residuals(final, final)).select("row_id", prediction.alias("prediction"), F.lit(best).alias("model"))


def hybrid_submission(spark: SparkSession, d: str) -> DataFrame:
    """Rounded predictions of the chosen model under dense ids in row order; ``rating_submission`` has those of the biases, as its SQL does."""
    p = hybrid_gbt_predict(spark, d).select("row_id", N.round_rating(F.round("prediction", 9)).alias("rating"))
    return relational.dense_ids(p, "row_id").select("id", "rating")


QUERIES = {
    f.__name__: f
    for f in (clean_users, clean_books, user_stats, book_stats, bias_terms_user, bias_terms_item, bias_predict, validation_rows, bias_rmse, hybrid_features, rating_submission, data_profile, hybrid_gbt_predict, hybrid_submission)
} | {f"smoothed_{k}": _smoothed(k) for k in R.GROUPS}

_USERS = """
u1 as (select user_id, arg_max(struct_pack(c := country, a := age), struct_pack(u := updated_at, a := coalesce(age, -1e300))) as r from users where user_id is not null group by 1),
u2 as (select user_id, coalesce(nullif(regexp_replace(r.c, '^\\s+|\\s+$', '', 'g'), ''), 'Unknown') as country, case when r.a between 5 and 100 then r.a end as valid from u1),
cu as (select user_id, country, coalesce(valid, (select median(valid) from u2)) as age_clean, cast(valid is null as int) as age_missing,
       cast(floor(coalesce(valid, (select median(valid) from u2)) / 10) * 10 as int) as age_bin from u2)"""
_TRIM = "coalesce(nullif(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), ''), 'Unknown') as {0}"
_BOOKS = f"""
b0 as (select *, row_number() over (partition by book_id order by title nulls first, author nulls first, publisher nulls first, pub_year nulls first) as n from books where book_id is not null),
b1 as (select book_id, {_TRIM.format('title')}, {_TRIM.format('author')}, {_TRIM.format('publisher')},
       case when try_cast(pub_year as double) between 1800 and 2026 then try_cast(pub_year as double) end as valid from b0 where n = 1),
cb as (select book_id, title, author, publisher, coalesce(valid, (select median(valid) from b1)) as year_clean, cast(valid is null as int) as year_missing,
       cast(floor(coalesce(valid, (select median(valid) from b1)) / 5) * 5 as int) as year_bin from b1)"""
_ROWS = "rr as (select row_id, user_id, book_id, cast(rating as double) as rating from ratings where user_id is not null and book_id is not null and rating between 0 and 10)"
_SPLIT = f"""
h as (select *, {relational.order_hash_sql('row_id')} as h from rr),
k as (select *, row_number() over (order by h, row_id) as r, count(*) over () as n from h),
dev as (select row_id, user_id, book_id, rating from k where r <= round(n * 0.1)),
trn as (select row_id, user_id, book_id, rating from k where r > round(n * 0.1))"""


def _bias_sql(rows: str) -> str:
    out = [f"mu as materialized (select avg(rating) as m from {rows})", f"e as materialized (select user_id, book_id, rating - m as x from {rows}, mu)"]
    last = None
    for i in range(R.ROUNDS):
        user = "e" if last is None else f"e left join {last} using (book_id)"
        less = "x" if last is None else "x - coalesce(bias, 0)"
        out.append(f"u_{i} as materialized (select user_id, sum({less}) / ({R.LAMBDA_USER} + count(*)) as bias from {user} group by 1)")
        out.append(f"i_{i} as materialized (select book_id, sum(x - coalesce(bias, 0)) / ({R.LAMBDA_ITEM} + count(*)) as bias from e left join u_{i} using (user_id) group by 1)")
        last = f"i_{i}"
    return ", ".join(out)


_LAST = R.ROUNDS - 1
_PRED = "least(greatest(m + coalesce(u.bias, 0) + coalesce(i.bias, 0), 0), 10)"
_PRED_FROM = f"left join u_{_LAST} u using (user_id) left join i_{_LAST} i using (book_id) cross join mu"
_ENR = """
enr as (select rr.*, coalesce(country, 'Unknown') as country, coalesce(author, 'Unknown') as author, coalesce(publisher, 'Unknown') as publisher, coalesce(age_bin, -1) as age_bin, coalesce(year_bin, -1) as year_bin,
        coalesce(age_clean, -1.0) as age_clean, coalesce(year_clean, -1.0) as year_clean, coalesce(age_missing, 1) as age_missing, coalesce(year_missing, 1) as year_missing
        from rr left join cu using (user_id) left join cb using (book_id))"""

SQL = {
    "clean_users": f"with {_USERS} select user_id, country, age_clean, age_missing, age_bin from cu",
    "clean_books": f"with {_BOOKS} select * from cb",
    "user_stats": f"with {_ROWS} select user_id, round(avg(rating), 6) as mean, count(*) as n from rr group by 1",
    "book_stats": f"with {_ROWS} select book_id, round(avg(rating), 6) as mean, count(*) as n from rr group by 1",
    "bias_terms_user": f"with {_ROWS}, {_bias_sql('rr')} select user_id, round(bias, 6) as bias from u_{_LAST}",
    "bias_terms_item": f"with {_ROWS}, {_bias_sql('rr')} select book_id, round(bias, 6) as bias from i_{_LAST}",
    "bias_predict": f"with {_ROWS}, {_bias_sql('rr')} select row_id, round({_PRED}, 6) as prediction from rr {_PRED_FROM}",
    "validation_rows": f"with {_ROWS}, {_SPLIT} select row_id from dev",
    "bias_rmse": f"with {_ROWS}, {_SPLIT}, {_bias_sql('trn')} select round(sqrt(avg(power(rating - m, 2))), 6) as rmse_mean, round(sqrt(avg(power(rating - {_PRED}, 2))), 6) as rmse_bias from dev {_PRED_FROM}",
    "rating_submission": f"with {_ROWS}, {_bias_sql('rr')} select row_number() over (order by row_id) - 1 as id, cast(round_even(round({_PRED}, 9), 0) as int) as rating from rr {_PRED_FROM}",
    "data_profile": f"""with {_ROWS}, {_SPLIT}, {_USERS}, {_BOOKS},
        su as (select count(*) as n from trn group by user_id), sb as (select count(*) as n from trn group by book_id)
        select (select count(*) from trn) as train_rows, (select round(avg(cast(rating = 0 as double)) * 100, 6) from trn) as zero_pct,
        (select round(avg(cast(user_id not in (select user_id from trn) as double)) * 100, 6) from dev) as cold_user_id_pct, (select round(median(n), 6) from su) as median_user_id, (select round(quantile_cont(n, 0.99), 6) from su) as p99_user_id,
        (select round(avg(cast(book_id not in (select book_id from trn) as double)) * 100, 6) from dev) as cold_book_id_pct, (select round(median(n), 6) from sb) as median_book_id, (select round(quantile_cont(n, 0.99), 6) from sb) as p99_book_id,
        (select count(*) from cu) as users, (select round(avg(age_missing) * 100, 6) from cu) as invalid_age_pct, (select count(*) from cb) as books, (select round(avg(year_missing) * 100, 6) from cb) as invalid_year_pct""",
    "hybrid_features": f"""with {_ROWS}, {_USERS}, {_BOOKS}, {_bias_sql('rr')}, {_ENR},
        um as (select user_id, avg(rating) as um, count(*) as uc from rr group by 1), bm as (select book_id, avg(rating) as bm, count(*) as bc from rr group by 1),
        {', '.join(f"s_{k} as (select {k}, (sum(rating) + any_value(m) * 10.0) / (count(*) + 10.0) as {k}_mean, count(*) as {k}_n from enr, mu group by 1)" for k in R.GROUPS)}
        select row_id, round({_PRED}, 5) as f_bias_pred, round(coalesce(u.bias, 0), 5) as f_user_bias, round(coalesce(i.bias, 0), 5) as f_book_bias, round(um, 5) as f_user_mean, round(ln(1.0 + uc), 5) as f_user_count,
        round(bm, 5) as f_book_mean, round(ln(1.0 + bc), 5) as f_book_count, {', '.join(f"round({k}_mean, 5) as f_{k}_mean" for k in R.GROUPS)}, round(ln(1.0 + author_n), 5) as f_author_count, round(ln(1.0 + publisher_n), 5) as f_publisher_count,
        round(age_clean, 5) as f_age, cast(age_missing as double) as f_age_missing, round(year_clean, 5) as f_year, cast(year_missing as double) as f_year_missing, cast(uc = 0 as double) as f_cold_user, round(um * bm, 5) as f_user_x_book
        from enr {_PRED_FROM} join um using (user_id) join bm using (book_id) {' '.join(f"join s_{k} using ({k})" for k in R.GROUPS)}""",
} | {
    f"smoothed_{k}": f"with {_ROWS}, {_USERS}, {_BOOKS}, {_ENR} select {k}, round((sum(rating) + 10.0 * (select avg(rating) from rr)) / (count(*) + 10.0), 6) as mean, count(*) as n from enr group by 1"
    for k in R.GROUPS
}
