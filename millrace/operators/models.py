"""Trained models on pyspark.ml: option pairs, residual boosting, factorisation, naive Bayes, and a registry."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, NGram, Normalizer, PCA, PCAModel, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import axes, network
from millrace.session import durable

#: Fixed values of the pair networks.
HIDDEN, TERMS, AXES, MLP_ROUNDS = (256, 64), 50_000, 256, 250
VECTOR, WINDOW, EPOCHS, WORD_ROUNDS = 200, 5, 20, 300

#: Words and word pairs of the linear models.
FEATURES = 40_000

#: Bound on the vocabulary of ``text_components``, above the words of every table at hand.
WORDS = 1 << 20

#: Most rounds of boosting.
BOOSTS = 500


def text_vectors(column: str = "feature_text", size: int = FEATURES) -> list:
    """Stages from text to tf-idf rows of unit length over the ``size`` commonest words and word pairs; the vocabulary is bounded by ``size``."""
    return [
        RegexTokenizer(inputCol=column, outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=2),
        NGram(inputCol="_tok", outputCol="_bi", n=2),
        SQLTransformer(statement="select *, concat(_tok, _bi) as _grams from __THIS__"),
        CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=size, minDF=1),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_x"),
    ]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with weights that give every class the same mass."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(F.broadcast(total)).select("_l", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))  # a row for each class
    return df.join(F.broadcast(w), F.col(label) == F.col("_l")).drop("_l")


def fit_pairs(train: DataFrame, kind: str) -> PipelineModel:
    """A classifier of question and option pairs; ``kind`` is logreg, svm, mlp or word2vec."""
    t = train.withColumn("label", F.col("target").cast("double"))
    if kind == "logreg":
        t = balanced(t, "label")
        stages = [*text_vectors(), LogisticRegression(featuresCol="_x", weightCol="weight", regParam=0.001, maxIter=50)]
    elif kind == "svm":
        t = balanced(t, "label")
        stages = [*text_vectors(), LinearSVC(featuresCol="_x", weightCol="weight", regParam=0.001, maxIter=50)]
    elif kind == "mlp":
        t = durable(t.select("id", "feature_text", "label"))
        t = durable(t.repartition(_tasks(t), "id").sortWithinPartitions("id"))  # read for the vocabulary, the rarity, the axes and the network
        return _fit_network(term_axes(t), t, "_p", MLP_ROUNDS)
    elif kind == "word2vec":
        return _fit_network(pair_vectors(t), t, "_v", WORD_ROUNDS)
    else:
        raise ValueError(f"no model of kind {kind}")
    return Pipeline(stages=stages).fit(t)


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that are read many times: all cores, and no more than so many rows each."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / network.TASK))


def _fit_network(vectors: PipelineModel, train: DataFrame, column: str, rounds: int) -> PipelineModel:
    """``vectors`` and a network over their ``column``, which is standardised if it is ``_p``."""
    x = durable(vectors.transform(train).select(column, "label"))
    stages = []
    if column == "_p":
        stages = [StandardScaler(inputCol="_p", outputCol="_s", withMean=True)]
    width = len(x.first()[column])
    scale = Pipeline(stages=stages).fit(x)
    learnt = network.fit(scale.transform(x), "_s" if stages else column, "label", [width, *HIDDEN, 2], rounds)
    return PipelineModel([*vectors.stages, *scale.stages, learnt])


def term_axes(train: DataFrame) -> PipelineModel:
    """Stages from ``feature_text`` to ``_p``: tf-idf of the ``TERMS`` commonest words and word pairs on their first ``AXES`` singular vectors."""
    stages = [
        RegexTokenizer(inputCol="feature_text", outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=2),
        NGram(inputCol="_tok", outputCol="_bi", n=2),
        SQLTransformer(statement="select *, concat(_tok, _bi) as _grams from __THIS__"),
        CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=TERMS, minDF=1),
        IDF(inputCol="_tf", outputCol="_x"),
    ]
    model = Pipeline(stages=stages).fit(train)
    found = axes.right_vectors(model.transform(train).select("_x", "id"), AXES, len(model.stages[3].vocabulary))
    return PipelineModel([*model.stages, _projection(train.sparkSession, axes.jvm_matrix(train.sparkSession.sparkContext, found))])


def singular_axes(vectors: DataFrame, k: int, width: int) -> PCAModel:
    """A stage from ``_x`` to ``_p``, the projection on the first ``k`` right singular vectors of ``_x``; the vectors are not centred."""
    x = vectors.select("_x").persist(StorageLevel.MEMORY_AND_DISK)  # read once for each step of the decomposition
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(x, "_x")).computeSVD(min(k, width))
    x.unpersist()
    return _projection(vectors.sparkSession, svd._java_model.V().asML())  # the matrix stays in the JVM


def _projection(spark: SparkSession, v) -> PCAModel:
    """A projection on given axes is what the model of PCA does."""
    sc = spark.sparkContext
    share = sc._jvm.org.apache.spark.ml.linalg.Vectors.dense(0.0, sc._gateway.new_array(sc._jvm.double, 0))
    model = PCAModel(sc._jvm.org.apache.spark.ml.feature.PCAModel("singular_axes", v, share.toDense()))
    return model._set(k=v.numCols()).setInputCol("_x").setOutputCol("_p")


def latin_words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{2,}"), 0)


class PairVectors(Transformer):
    """``_v``: mean vectors of the known words of ``question`` and ``option_text``, their absolute difference and their product."""

    def __init__(self, vectors: DataFrame):
        super().__init__()
        self.vectors = vectors

    def _means(self, df: DataFrame, column: str, out: str) -> DataFrame:
        words = df.select(column).distinct().select(column, F.explode(latin_words(column)).alias("word"))
        means = words.join(self.vectors, "word").groupBy(F.col(column).alias("_text")).agg(vector_to_array(Summarizer.mean(F.col("vector"))).alias("_m"))
        none = F.array_repeat(F.lit(0.0), VECTOR)
        return df.join(means, F.col(column) == F.col("_text"), "left").withColumn(out, F.coalesce("_m", none)).drop("_text", "_m")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        both = self._means(self._means(dataset, "question", "_q"), "option_text", "_o")
        apart = F.zip_with("_q", "_o", lambda q, o: F.abs(q - o))
        return both.withColumn("_v", array_to_vector(F.concat("_q", "_o", apart, F.zip_with("_q", "_o", lambda q, o: q * o)))).drop("_q", "_o")


def pair_vectors(train: DataFrame) -> PipelineModel:
    """Skip-gram vectors learnt from the questions and options of ``train``, as a stage that embeds both apart."""
    corpus = train.select(latin_words("question").alias("_w")).unionAll(train.select(latin_words("option_text").alias("_w")))
    words = Word2Vec(inputCol="_w", outputCol="_v", vectorSize=VECTOR, windowSize=WINDOW, minCount=1, maxIter=EPOCHS, seed=42).fit(durable(corpus))
    return PipelineModel([PairVectors(words.getVectors())])


def predict_pairs(model: PipelineModel, options: DataFrame) -> DataFrame:
    """``id, label, score`` of every option."""
    out = model.transform(options)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select("id", "label", vector_to_array(column)[1].alias("score"))


def best_labels(scores: DataFrame) -> DataFrame:
    """``id, labels``: the best option, equal scores by label."""
    return scores.groupBy("id").agg(F.array(F.min_by("label", F.struct(-F.col("score"), "label"))).alias("labels"))


def fit_four_way(train: DataFrame) -> PipelineModel:
    """One-against-rest linear machines on the texts of four-option questions, ``answer`` 0..3."""
    svm = OneVsRest(classifier=LinearSVC(regParam=0.01, maxIter=20), featuresCol="_x", labelCol="answer")
    return Pipeline(stages=[*text_vectors(size=1 << 12), svm]).fit(train)


def boosted_residuals(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``hybrid``: the clipped bias prediction plus a boosted residual.

    A tenth of ``train`` stops the rounds early, at the first that no longer lowers its error.
    """
    from millrace.functions.normalize import clip_rating
    from millrace.operators.relational import order_hash

    inputs = [c for c in train.columns if c.startswith("f_")]
    gbt = GBTRegressor(featuresCol="_x", labelCol="residual", stepSize=0.05, maxIter=BOOSTS, maxDepth=6, minInstancesPerNode=20, validationIndicatorCol="_held", validationTol=1e-7, seed=42)
    # other seed than the split's, else its hash would hold out rows of one end of the remaining range
    t = durable(train.withColumn("residual", F.col("rating") - F.col("f_bias_pred")).withColumn("_held", order_hash(F.col("row_id"), 7) % 10 == 0))
    if t.agg(F.count_if("_held")).first()[0] == 0:  # too few rows to hold any out
        gbt.clear(gbt.validationIndicatorCol)
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_x"), gbt]).fit(t)
    return model.transform(rows).withColumn("hybrid", clip_rating(F.col("f_bias_pred") + F.col("prediction")))


def factors(ratings: DataFrame, rank: int = 8) -> DataFrame:
    """``kind, id, factors`` of users and items by alternating least squares."""
    model = ALS(userCol="user_id", itemCol="book_id", ratingCol="rating", rank=rank, maxIter=5, seed=42, coldStartStrategy="drop").fit(ratings.select(F.col("user_id").cast("int"), F.col("book_id").cast("int"), "rating"))
    return model.userFactors.select(F.lit("user").alias("kind"), "id", F.col("features").alias("factors")).unionByName(
        model.itemFactors.select(F.lit("item").alias("kind"), "id", F.col("features").alias("factors"))
    )


def naive_bayes(train: DataFrame, rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", minTokenLength=2), HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=1 << 14), NaiveBayes(featuresCol="_tf", labelCol=label)]
    return Pipeline(stages=stages).fit(train).transform(rows)


def text_components(df: DataFrame, text: str, k: int = 8) -> DataFrame:
    """``df`` with ``components``: tf-idf vectors of all words (at most ``WORDS``) on their first ``k`` singular vectors."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"(?U)\W+", minTokenLength=2), CountVectorizer(inputCol="_tok", outputCol="_tf", vocabSize=WORDS, minDF=1), IDF(inputCol="_tf", outputCol="_x")]
    model = Pipeline(stages=stages).fit(df)
    found = singular_axes(model.transform(df), k, len(model.stages[1].vocabulary))
    return found.transform(model.transform(df)).withColumn("components", vector_to_array("_p"))


def nearest_labels(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``vec_id, predicted``: commonest label of the ``k`` nearest others by cosine; a stated query set against all rows."""
    from millrace.operators.recommend import against_all, dot

    norm = lambda c: F.sqrt(dot(c, c))
    q = queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"))
    s = against_all(vectors.select("vec_id", "label", "embedding"), q, "vec_id").where("vec_id <> qid").select("qid", "label", "vec_id", F.round(dot(F.col("embedding"), F.col("qe")) / (norm(F.col("embedding")) * norm(F.col("qe"))), 6).alias("score"))
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    votes = top.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("qid").alias("vec_id")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted"))


Runner = Callable[[DataFrame, DataFrame], DataFrame]


def run_registry(registry: Iterable[tuple[str, bool, Runner]], train: DataFrame, dev: DataFrame) -> DataFrame:
    """``model, id, labels`` of every enabled model; a model that gives none is left out."""
    out = None
    for name, enabled, run in registry:
        if enabled and (p := run(train, dev)) is not None:
            p = p.select(F.lit(name).alias("model"), "id", "labels")
            out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no model is enabled")
    return out


#: Rounds of the online learners, and the factor of a Winnow step.
ONLINE_ROUNDS, PROMOTION = 10, 1.5


def _epoch(batches: Iterator[pd.DataFrame], weights: list[float], kind: str) -> Iterator[pd.DataFrame]:
    """One pass over a task's rows from the round's weights; the weights it ends with and the rows it saw."""
    w, n = np.array(weights), 0
    for b in batches:
        for x, y in zip(b["x"], b["y"], strict=True):
            v = _online_input(np.asarray(x, dtype=float), kind)
            said = _online_margin(v, w, kind) > 0
            if kind == "perceptron" and said != bool(y):
                w = w + (1 if y else -1) * v
            elif kind == "winnow" and said != bool(y):
                w = w * np.where(v > 0, PROMOTION if y else 1 / PROMOTION, 1.0)
            n += 1
    yield pd.DataFrame({"w": [w.tolist()], "n": [n]})


def _online_input(v: np.ndarray, kind: str) -> np.ndarray:
    """A perceptron reads the numbers and a constant; Winnow whether each is above and whether it is below zero."""
    return np.append(v, 1.0) if kind == "perceptron" else np.concatenate([v > 0, v < 0]).astype(float)


def _online_margin(v: np.ndarray, w: np.ndarray, kind: str) -> float:
    return float(v @ w) - (len(w) / 2 if kind == "winnow" else 0.0)


def fit_online(df: DataFrame, features: str, label: str, kind: str, rounds: int = ONLINE_ROUNDS) -> list[float]:
    """Weights of a ``perceptron`` or ``winnow`` learner of labels 0 and 1 by parameter mixing.

    Every round each task learns from its rows alone, from the same weights, and their results
    are averaged by the rows they come from: a row a task reaches the driver, and the weights,
    as many as features, go back.
    """
    if kind not in ("perceptron", "winnow"):
        raise ValueError(f"no learner of kind {kind}")
    first = df.select(F.size(features)).first()
    width = first[0] if first else 0
    weights = [0.0] * (width + 1) if kind == "perceptron" else [1.0] * (2 * width)
    rows = df.select(F.col(features).alias("x"), F.col(label).alias("y"))
    for _ in range(rounds):
        parts = [r for r in rows.mapInPandas(partial(_epoch, weights=weights, kind=kind), "w array<double>, n long").collect() if r["n"]]
        seen = sum(r["n"] for r in parts)
        if seen:
            weights = [sum(r["w"][k] * r["n"] for r in parts) / seen for k in range(len(weights))]
    return weights


def online_score(features: Column, weights: list[float], kind: str) -> Column:
    """1 where the learner says so, else 0; by built-in expressions."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    x = F.transform(features, lambda v: v.cast("double"))
    if kind == "perceptron":
        v, floor = F.concat(x, F.array(F.lit(1.0))), 0.0
    else:
        v, floor = F.concat(F.transform(x, lambda a: (a > 0).cast("double")), F.transform(x, lambda a: (a < 0).cast("double"))), len(weights) / 2
    dot = F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    return (dot - floor > 0).cast("int")


def tree_labels(df: DataFrame, features: str, label: str, depth: int = 5) -> DataFrame:
    """``df`` with ``said``, the label by a decision tree fitted on it."""
    x = df.withColumn("_x", array_to_vector(F.transform(features, lambda v: v.cast("double")))).withColumn("_y", F.col(label).cast("double"))
    return DecisionTreeClassifier(featuresCol="_x", labelCol="_y", predictionCol="said", maxDepth=depth, seed=42).fit(x).transform(x).drop("_x", "_y", "rawPrediction", "probability")


def score_batches(df: DataFrame, columns: Sequence[str], load: Callable[[], Callable[..., Sequence[float]]], out: str = "score") -> DataFrame:
    """``df`` with ``out``, the scores of a model of any library over batches of ``columns``.

    ``load`` is called once in each task and gives the scorer, a function from as many lists
    of values to as many scores as rows: a cross-encoder, a session of a stored network, a
    language model. Nothing but the columns reaches it, and it is never called for single rows.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        score = load()
        for parts in batches:
            yield pd.Series(list(score(*[p.tolist() for p in parts])), dtype="float64")

    return df.withColumn(out, F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(*[F.col(c) for c in columns]))
