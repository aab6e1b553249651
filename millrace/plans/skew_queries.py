"""Queries of problem 3: statistics per key under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators.skew import eager_join_states, fact_rows, heavy_keys, key_states, keyed_statistics, roll_up

HEAVY_SHARE = 0.02


def _valid_rating():
    r = F.col("rating")
    return F.when(r.between(0, 10), r)


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    ratings = table(spark, d, "ratings").select("user_id", "book_id", "rating")
    return keyed_statistics(
        ratings, {"user_id": table(spark, d, "users").select("user_id"), "book_id": table(spark, d, "books").select("book_id")}, _valid_rating()
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_statistics(spark, d), HEAVY_SHARE)


def p3_key_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Rows, valid ratings and mean of every user and book, and how many rows the dimension has for it."""
    s = _statistics(spark, d).where("key_id is not null")
    return s.select("key_name", "key_id", fact_rows().alias("n_rows"), "n_values", F.round(F.col("total") / F.when(F.col("n_values") > 0, F.col("n_values")), 6).alias("mean"), "n_copies")


def p3_country_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Rows, valid ratings and mean of ratings joined to users, by country as typed: joined as states, then rolled up."""
    ratings = table(spark, d, "ratings").select("user_id", "rating").where("user_id is not null")
    states = eager_join_states(key_states(ratings, ["user_id"], _valid_rating()), table(spark, d, "users").select("user_id", "country"), "user_id", ["country"])
    return roll_up(states.where("matched"), ["country"]).select("country", "n_rows", "n_values", F.round("mean", 6).alias("mean"))


QUERIES = {"p3_found": p3_found, "p3_key_statistics": p3_key_statistics, "p3_country_ratings": p3_country_ratings}

_STATS = """
    select '{k}' as key_name, {k} as key_id, count(*) as n_rows,
           count(case when rating between 0 and 10 then rating end) as n_values,
           round(avg(case when rating between 0 and 10 then cast(rating as double) end), 6) as mean,
           coalesce((select count(*) from {t} x where x.{k} = r.{k}), 0) as n_copies
    from ratings r where {k} is not null group by {k}"""

SQL = {
    "p3_found": """
        select 'user_id' as key_name, user_id as key_id from ratings where user_id is not null
        group by user_id having count(*) >= 0.02 * (select count(*) from ratings)
        union all
        select 'book_id', book_id from ratings where book_id is not null
        group by book_id having count(*) >= 0.02 * (select count(*) from ratings)""",
    "p3_key_statistics": _STATS.format(k="user_id", t="users") + " union all " + _STATS.format(k="book_id", t="books"),
    "p3_country_ratings": """
        select country, count(*) as n_rows, count(case when rating between 0 and 10 then rating end) as n_values,
               round(avg(case when rating between 0 and 10 then cast(rating as double) end), 6) as mean
        from ratings join users using (user_id) group by country""",
}
