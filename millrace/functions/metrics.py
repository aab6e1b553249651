"""Evaluation measures as aggregates; each gives one row or one row for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import running_total


def label_sets_equal(gold: Column, predicted: Column) -> Column:
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    return clean(gold) == clean(predicted)


def answer_accuracy(questions: DataFrame, predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``evaluated, exact_match, top1``: questions without gold letters are skipped, missing predictions are empty."""
    p = predictions.select("id", "labels", *(by or []))
    j = questions.where("size(gold_letters) > 0").select("id", "gold_letters").join(p, "id", "left" if not by else "inner")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    exact = label_sets_equal(F.col("gold_letters"), labels).cast("double")
    top = F.coalesce(F.lower(F.trim(F.get("gold_letters", F.lit(0)))) == F.lower(F.trim(F.get(labels, F.lit(0)))), F.lit(False)).cast("double")
    out = j.select(exact.alias("e"), top.alias("t"), *(by or []))
    aggs = [F.count(F.lit(1)).alias("evaluated"), F.coalesce(F.avg("e"), F.lit(0.0)).alias("exact_match"), F.coalesce(F.avg("t"), F.lit(0.0)).alias("top1")]
    return out.groupBy(*by).agg(*aggs) if by else out.agg(*aggs)


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    d = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"))


def micro_macro(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro and macro precision, recall and F; the macro F is that of the macro precision and recall."""
    g, p = F.col(gold), F.col(predicted)
    cells = (
        df.select(F.explode(F.array(F.struct(p.alias("label"), F.lit(1).alias("said"), F.lit(0).alias("real"), (g == p).cast("int").alias("hit")), F.struct(g.alias("label"), F.lit(0).alias("said"), F.lit(1).alias("real"), F.lit(0).alias("hit")))).alias("c"))
        .select("c.*").where("label is not null").groupBy("label").agg(F.sum("said").alias("said"), F.sum("real").alias("real"), F.sum(F.coalesce("hit", F.lit(0))).alias("hit"))
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = cells.agg(
        ratio(F.sum("hit"), F.sum("said")).alias("p_micro"), ratio(F.sum("hit"), F.sum("real")).alias("r_micro"),
        F.avg(ratio(F.col("hit"), F.col("said"))).alias("p_macro"), F.avg(ratio(F.col("hit"), F.col("real"))).alias("r_macro"),
    )
    f = lambda k: ratio(2 * F.col(f"p_{k}") * F.col(f"r_{k}"), F.col(f"p_{k}") + F.col(f"r_{k}")).alias(f"f1_{k}")
    return m.select("p_micro", "r_micro", f("micro"), "p_macro", "r_macro", f("macro"))


def binary_counts(df: DataFrame, gold: Column, predicted: Column, beta: float = 2.0) -> DataFrame:
    """Precision, recall, accuracy, F1 and F-beta of a yes-or-no prediction."""
    s = lambda c: F.sum(c.cast("double"))
    m = df.agg(s(gold & predicted).alias("tp"), s(~gold & predicted).alias("fp"), s(gold & ~predicted).alias("fn"), s(~gold & ~predicted).alias("tn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    fb = lambda b: (1 + b * b) * p * r / (b * b * p + r)
    return m.select(p.alias("precision"), r.alias("recall"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), fb(1.0).alias("f1"), fb(beta).alias("f_beta"))


def ranked_quality(ranked: DataFrame, group: str, rank: str, gain: str, k: int = 10, half_life: float = 5.0) -> DataFrame:
    """Per group: average precision, reciprocal rank, P@k, R-precision, DCG, nDCG and half-life utility of ranked gains."""
    w = Window.partitionBy(group).orderBy(rank)
    ideal = Window.partitionBy(group).orderBy(F.desc(gain), rank)
    hit = (F.col(gain) > 0).cast("double")
    x = ranked.select(group, rank, gain, hit.alias("hit"), F.sum(hit).over(w).alias("hits"), F.row_number().over(ideal).alias("best"), F.sum(hit).over(Window.partitionBy(group)).alias("all"))
    discount = lambda c: F.greatest(F.lit(1.0), F.log2(c.cast("double")))
    return x.groupBy(group).agg(
        F.coalesce(F.sum(F.col("hit") * F.col("hits") / F.col(rank)) / F.nullif(F.sum("hit"), F.lit(0.0)), F.lit(0.0)).alias("ap"),
        F.coalesce(F.max(F.col("hit") / F.col(rank)), F.lit(0.0)).alias("rr"),
        (F.sum(F.when(F.col(rank) <= k, F.col("hit")).otherwise(0.0)) / k).alias("p_at_k"),
        F.coalesce(F.sum(F.when(F.col(rank) <= F.col("all"), F.col("hit")).otherwise(0.0)) / F.nullif(F.max("all"), F.lit(0.0)), F.lit(0.0)).alias("r_precision"),
        F.sum(F.col(gain) / discount(F.col(rank))).alias("dcg"),
        F.coalesce(F.sum(F.col(gain) / discount(F.col(rank))) / F.nullif(F.sum(F.col(gain) / discount(F.col("best"))), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
        F.sum(F.col(gain) / F.pow(F.lit(2.0), (F.col(rank) - 1) / (half_life - 1))).alias("half_life"),
    )


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the rank of ``value``, equal values sharing their mean rank; only distinct values are ordered, range by range."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    r = running_total(counts, "_v", "_c", "_upto").select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(r, F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return average_ranks(average_ranks(df, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("spearman"))
