"""Cleaning, smoothed statistics, alternating biases and features for rating prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.session import durable

#: Fixed values of the model.
ALPHA, LAMBDA_USER, LAMBDA_ITEM, ROUNDS = 10.0, 15.0, 10.0, 8
AGES, YEARS = (5, 100), (1800, 2026)


def clean_users(users: DataFrame) -> DataFrame:
    """One row for each user (the latest), country filled, age validated, imputed by the median and binned."""
    one = users.where("user_id is not null").groupBy("user_id").agg(F.max_by(F.struct("country", "age"), F.struct("updated_at", "age")).alias("r"))
    ok = F.when(N.in_range(F.col("r.age"), *AGES), F.col("r.age"))
    rows = one.select("user_id", N.clean_text(F.col("r.country")).alias("country"), ok.alias("valid"))
    return _imputed(rows, "age", 10)


def clean_books(books: DataFrame) -> DataFrame:
    """One row for each book, names filled, year validated, imputed by the median and binned."""
    one = books.where("book_id is not null").groupBy("book_id").agg(F.min(F.struct("title", "author", "publisher", "pub_year")).alias("r"))
    year = F.expr("try_cast(r.pub_year as double)")
    rows = one.select("book_id", *[N.clean_text(F.col(f"r.{c}")).alias(c) for c in ("title", "author", "publisher")], F.when(N.in_range(year, *YEARS), year).alias("valid"))
    return _imputed(rows, "year", 5)


def _imputed(rows: DataFrame, name: str, width: int) -> DataFrame:
    middle = rows.agg(F.median("valid").alias("m")).scalar()
    value = F.coalesce("valid", middle)
    return rows.withColumn(f"{name}_clean", value).withColumn(f"{name}_missing", F.col("valid").isNull().cast("int")).withColumn(f"{name}_bin", N.binned(value, width)).drop("valid")


def usable(ratings: DataFrame) -> DataFrame:
    """``row_id, user_id, book_id, rating`` of the rows with both keys and a rating of 0..10."""
    return ratings.where("user_id is not null and book_id is not null and rating between 0 and 10").select("row_id", "user_id", "book_id", F.col("rating").cast("double").alias("rating"))


def smoothed(rows: DataFrame, key: str, mu: Column, alpha: float = ALPHA) -> DataFrame:
    """Mean of every key drawn to the global mean by ``alpha`` rows, and its count."""
    return rows.groupBy(key).agg(((F.sum("rating") + mu * alpha) / (F.count(F.lit(1)) + alpha)).alias("mean"), F.count(F.lit(1)).alias("n"))


def fit_biases(rows: DataFrame, rounds: int = ROUNDS, lambda_user: float = LAMBDA_USER, lambda_item: float = LAMBDA_ITEM) -> tuple[float, DataFrame, DataFrame]:
    """(mean, user biases, book biases) after alternating rounds of regularised means of residuals.

    Rows are first reduced to the sum and count of every (user, book), which is all that a
    round needs; a hot key still has a pair for each of its partners. The pairs are not laid
    out by key, as that would put a hot key's pairs into one task: the bias table of the other
    side is joined by broadcast while its measured size allows, else by a merge join that
    adaptive execution splits, and sums leave each task once for each key. The books'
    biases are written after each round, so the plan does not grow and a lost executor costs one round.
    """
    mu = rows.agg(F.avg("rating")).first()[0] or 0.0
    pairs = durable(rows.groupBy("user_id", "book_id").agg(F.sum(F.col("rating") - F.lit(mu)).alias("s"), F.count(F.lit(1)).alias("c")))
    user = item = None
    for n in range(rounds):
        user = _half(pairs, "user_id", "book_id", item, lambda_user)
        user = durable(user) if n == rounds - 1 else user
        item = durable(_half(pairs, "book_id", "user_id", user, lambda_item))
    return mu, user, item


def _half(pairs: DataFrame, key: str, other: str, bias: DataFrame | None, lam: float) -> DataFrame:
    if bias is None:
        part = pairs.select(key, "s", "c")
    else:
        part = pairs.join(bias.withColumnRenamed("bias", "_b"), other, "left").select(key, (F.col("s") - F.col("c") * F.coalesce("_b", F.lit(0.0))).alias("s"), "c")
    return part.groupBy(key).agg((F.sum("s") / (F.lit(lam) + F.sum("c"))).alias("bias"))


def bias_predictions(rows: DataFrame, mu: float, user: DataFrame, item: DataFrame) -> DataFrame:
    """``rows`` with the clipped prediction; keys that the fit has not seen count as unbiased."""
    raw = F.lit(mu) + F.coalesce("bias_user", F.lit(0.0)) + F.coalesce("bias_item", F.lit(0.0))
    return (
        rows.join(user.withColumnRenamed("bias", "bias_user"), "user_id", "left")
        .join(item.withColumnRenamed("bias", "bias_item"), "book_id", "left")
        .withColumn("prediction", N.clip_rating(raw))
    )


def rmse(rows: DataFrame, actual: str = "rating", predicted: str = "prediction") -> DataFrame:
    d = F.col(actual) - F.col(predicted)
    return rows.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def enriched(rows: DataFrame, users: DataFrame, books: DataFrame) -> DataFrame:
    return (
        rows.join(users, "user_id", "left").join(books, "book_id", "left")
        .withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("country", "author", "publisher")})
        .withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("age_bin", "year_bin")})
        .withColumns({c: F.coalesce(c, F.lit(1)) for c in ("age_missing", "year_missing")})
    )


GROUPS = ("author", "publisher", "country", "age_bin", "year_bin")


def group_means(base: DataFrame, keys: Sequence[str], mu: float) -> dict[str, DataFrame]:
    """``key, key_mean, key_count`` of every one of ``keys``: smoothed means, all from one pass over ``base``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.col(k).cast("string").alias("v")) for k in keys]))
    sums = durable(base.select(each.alias("_k"), "rating").groupBy("_k.g", "_k.v").agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n")))
    mean = (F.col("s") + F.lit(mu) * ALPHA) / (F.col("n") + ALPHA)
    return {k: sums.where(F.col("g") == k).select(F.col("v").alias(f"_{k}"), mean.alias(f"{k}_mean"), F.col("n").alias(f"{k}_count")) for k in keys}


def features(rows: DataFrame, fitted: DataFrame, users: DataFrame, books: DataFrame, biases: tuple[float, DataFrame, DataFrame]) -> DataFrame:
    """Twenty features for every row, from statistics of the ``fitted`` rows.

    What is known of a user - cleaned columns, bias, mean and count - is put together user by
    user first, and so for books, so that the rows are joined once for each entity.
    """
    mu, user, item = biases
    sides = []
    for key, name, entity, bias in (("user_id", "user", users, user.withColumnRenamed("bias", "bias_user")), ("book_id", "book", books, item.withColumnRenamed("bias", "bias_item"))):
        s = fitted.groupBy(key).agg(F.avg("rating").alias(f"{name}_mean"), F.count(F.lit(1)).alias(f"{name}_count"))
        sides.append(entity.join(bias, key, "full").join(s, key, "full"))
    base = enriched(fitted, users, books)
    out = enriched(rows, *sides)
    raw = F.lit(mu) + F.coalesce("bias_user", F.lit(0.0)) + F.coalesce("bias_item", F.lit(0.0))
    out = out.withColumn("prediction", N.clip_rating(raw))
    for key, s in group_means(base, GROUPS, mu).items():
        out = out.join(s, F.col(key).cast("string") == F.col(f"_{key}"), "left").drop(f"_{key}")
    mean = lambda c: F.coalesce(c, F.lit(mu))
    count = lambda c: F.log1p(F.coalesce(c, F.lit(0)).cast("double"))
    zero = F.lit(0.0)
    return out.select(
        "row_id", "user_id", "book_id", "rating",
        F.col("prediction").alias("f_bias_pred"), F.coalesce("bias_user", zero).alias("f_user_bias"), F.coalesce("bias_item", zero).alias("f_book_bias"),
        mean("user_mean").alias("f_user_mean"), count("user_count").alias("f_user_count"), mean("book_mean").alias("f_book_mean"), count("book_count").alias("f_book_count"),
        *[mean(f"{k}_mean").alias(f"f_{k}_mean") for k in GROUPS], count("author_count").alias("f_author_count"), count("publisher_count").alias("f_publisher_count"),
        F.coalesce("age_clean", F.lit(-1.0)).alias("f_age"), F.col("age_missing").cast("double").alias("f_age_missing"),
        F.coalesce("year_clean", F.lit(-1.0)).alias("f_year"), F.col("year_missing").cast("double").alias("f_year_missing"),
        (F.coalesce("user_count", F.lit(0)) == 0).cast("double").alias("f_cold_user"), (mean("user_mean") * mean("book_mean")).alias("f_user_x_book"),
    )
