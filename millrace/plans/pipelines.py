"""Whole jobs over the questions: prepare, train, evaluate, predict, all of them, and a comparison of models.

Each step reads what the one before has written, so a step can be run again by itself. Reports
are of a row for each model; ids, questions and predictions are written by the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import metrics
from millrace.operators import models, relational
from millrace.plans import question_queries as Q
from millrace.plans import rating_queries
from millrace.plans.config import RunSettings
from millrace.sources import writers

TRAINED = ("logreg", "svm", "mlp", "word2vec")


def prepare(spark: SparkSession, data: str, out: str, settings: RunSettings) -> None:
    """Normalised questions with options, labelled and split: ``questions`` (Parquet and JSON lines) and ``split`` (ids)."""
    q = Q.normalised(spark, data).where(F.size("choice_labels") > 0)
    if settings.split.sample_ratio < 1:
        q = relational.exact_sample(q, "row_id", settings.split.sample_ratio, settings.split.seed)
    labelled = q.where("size(gold_letters) > 0")
    part = relational.stratified_split(labelled, F.get("gold_letters", F.lit(0)), "row_id", settings.split.dev_size, settings.split.seed).select("id", "part")
    q.join(part, "id", "left").write.mode("overwrite").parquet(f"{out}/questions")
    prepared = spark.read.parquet(f"{out}/questions")
    writers.write_questions(prepared, f"{out}/questions.jsonl")
    writers.write_split_ids(prepared.where("part is not null"), f"{out}/split")


def _parts(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = spark.read.parquet(f"{out}/questions")
    return q, q.where("part = 'train'"), q.where("part = 'dev'")


def train(spark: SparkSession, out: str, settings: RunSettings) -> list[str]:
    """Fit and save every enabled model that learns; the names of those saved."""
    done = []
    for kind in settings.models.enabled:
        if kind in TRAINED:
            writers.save_model(models.fit_pairs(Q.options_of(_parts(spark, out)[1]), kind), f"{out}/models/{kind}")
            done.append(kind)
    return done


def labels_by(spark: SparkSession, out: str, kind: str, questions: DataFrame) -> DataFrame:
    """``id, labels`` of a model for questions."""
    if kind == "lexical":
        return Q._lexical(questions)
    if kind == "common_letter":
        known = _parts(spark, out)[1].groupBy(F.get("gold_letters", F.lit(0)).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
        letter = known.agg(F.coalesce(F.min_by("letter", F.struct(-F.col("n"), "letter")), F.lit("a"))).first()[0]
        return questions.select("id", F.array(F.lit(letter)).alias("labels"))
    if kind not in TRAINED:
        raise ValueError(f"no model {kind!r}")
    return models.best_labels(models.predict_pairs(writers.load_model(f"{out}/models/{kind}"), Q.options_of(questions)))


def evaluate(spark: SparkSession, out: str, settings: RunSettings) -> DataFrame:
    """Exact match and first label of every enabled model on the held-out questions; written as JSON and as a Markdown table."""
    dev = _parts(spark, out)[2]
    registry = [(k, True, lambda _, rows, kind=k: labels_by(spark, out, kind, rows)) for k in settings.models.enabled]
    result = metrics.answer_accuracy(dev, models.run_registry(registry, dev, dev), ["model"])
    writers.write_metrics(result, f"{out}/metrics")
    result = spark.read.json(f"{out}/metrics")
    writers.write_text(spark, writers.markdown_table(result, "exact_match"), f"{out}/metrics.md")
    return result


def predict(spark: SparkSession, out: str, settings: RunSettings) -> None:
    """The submission of the model that the settings name, over all questions."""
    q = _parts(spark, out)[0]
    labels = q.select("id").join(labels_by(spark, out, settings.models.submit, q), "id", "left")
    writers.write_submission(labels.select("id", Q.N.labels_to_answer(F.coalesce("labels", F.array().cast("array<string>"))).alias("answer")), f"{out}/submission")


def run_all(spark: SparkSession, data: str, out: str, settings: RunSettings) -> DataFrame:
    """Every step, one after the other; the comparison of the models."""
    prepare(spark, data, out, settings)
    train(spark, out, settings)
    result = evaluate(spark, out, settings)
    predict(spark, out, settings)
    return result


def profile(spark: SparkSession, data: str, out: str) -> None:
    """Sizes and shares of the rating data as a Markdown report."""
    writers.write_text(spark, writers.markdown_facts(rating_queries.data_profile(spark, data), "Rating data"), f"{out}/profile.md")
