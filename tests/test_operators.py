"""Fixtures, differential checks and edge cases of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import metrics
from millrace.operators import collaborative, ontology, ratings, recommend, relational, skew, text, tree
from millrace.plans import config, tree_queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


TREES = {
    "path": ([(i, i + 1) for i in range(5)], [(5, 0, 0), (5, 3, 3), (4, 4, 4), (2, 5, -1), (3, -1, -1)]),
    "binary": ([(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)], [(3, 0, 0), (3, 1, 1), (3, 2, 3), (6, 0, 0), (6, 1, 2)]),
    "star": ([(0, i) for i in range(1, 10)], [(i, 0, 0) for i in range(1, 10)] + [(i, 1, i) for i in range(1, 10)]),
    "spine": (
        [(0, 1), (0, 2), (1, 3), (1, 4), (4, 5), (5, 6), (5, 7), (7, 8), (7, 9), (9, 10), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)],
        [(2, 0, 0), (3, 1, 1), (6, 2, 4), (8, 3, 5), (15, 10, 14), (15, 5, 9), (15, 11, 15), (15, 12, -1), (10, 6, 10)],
    ),
}


@pytest.mark.parametrize("name", TREES)
def test_level_ancestor(spark, name):
    edges, expected = TREES[name]
    e = spark.createDataFrame(edges, "parent long, child long")
    q = spark.createDataFrame([x[:2] for x in expected], "u long, d int")
    assert rows(tree.level_ancestor(q, e)) == sorted(expected)


def test_tree_against_walks(spark):
    random.seed(42)
    parent = {i: random.randrange(max(0, i - 4), i) for i in range(1, 120)}

    def up(u):
        out = [u]
        while u in parent:
            u = parent[u]
            out.append(u)
        return out

    e = spark.createDataFrame([(p, c) for c, p in parent.items()], "parent long, child long")
    q = [(random.randrange(120), random.randrange(120)) for _ in range(200)]
    expected = sorted({(u, v, next(x for x in up(u) if x in set(up(v)))) for u, v in q})
    assert rows(tree.lowest_common_ancestor(spark.createDataFrame(q, "u long, v long"), e)) == expected
    depth = {r[0]: r[1] for r in tree.lifting_table(e)[0].collect()}
    assert depth == {u: len(up(u)) - 1 for u in range(120)}
    facts = {r["node"]: (r["depth"], r["height"], r["size"]) for r in tree.node_facts(e).collect()}
    assert facts[0][2] == 120 and all(facts[u][0] == depth[u] for u in depth)


def test_biases(spark):
    r = spark.createDataFrame([("u1", "b1", 8.0), ("u1", "b2", 6.0), ("u2", "b1", 4.0)], "user_id string, book_id string, rating double")
    mu, user, item = ratings.fit_biases(r, rounds=1)
    assert mu == 6.0
    u, i = dict(rows(user)), dict(rows(item))
    assert round(u["u1"], 6) == 0.117647 and round(u["u2"], 6) == -0.125
    assert round(i["b1"], 6) == 0.000613 and round(i["b2"], 6) == -0.010695
    p = ratings.bias_predictions(spark.createDataFrame([("zz", "b1", 1.0)], "user_id string, book_id string, rating double"), mu, user, item).first()
    assert round(p["prediction"], 6) == 6.000613


def test_smoothed(spark):
    r = spark.createDataFrame([("a", 10.0), ("a", 0.0)], "k string, rating double")
    assert rows(ratings.smoothed(r, "k", F.lit(5.0))) == [("a", 5.0, 2)]


def test_answer_accuracy(spark):
    q = spark.createDataFrame([("1", ["a", "c"]), ("2", ["a"]), ("3", []), ("4", ["b"])], "id string, gold_letters array<string>")
    p = spark.createDataFrame([("1", ["c", "a"]), ("2", ["a", "b"]), ("3", ["a"]), ("4", [])], "id string, labels array<string>")
    got = metrics.answer_accuracy(q, p).first()
    assert (got[0], round(got[1], 6), round(got[2], 6)) == (3, 0.333333, 0.333333)
    assert tuple(metrics.answer_accuracy(q.where("id = '3'"), p).first()) == (0, 0.0, 0.0)


def test_ranking_metrics(spark):
    test = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "person_id long, content_id long")
    ranked = spark.createDataFrame([(1, 10, 1), (2, 10, 7), (3, 11, 1)], "person_id long, content_id long, rank int")
    got = recommend.ranking_metrics(test, ranked).first()
    assert [round(x, 6) for x in got[:3]] == [0.333333, 0.666667, 0.380952]


def test_leave_last_out(spark):
    d = spark.createDataFrame([("u", "c1", 5), ("u", "c2", 5), ("u", "c3", 4)], "person_id string, content_id string, ts int")
    train, test = relational.leave_last_out(d, "person_id", ["ts", "content_id"])
    assert rows(test.select("content_id")) == [("c2",)] and rows(train.select("content_id")) == [("c1",), ("c3",)]


def test_samples_and_splits(spark):
    d = spark.range(7)
    assert relational.exact_sample(d, "id", 0.1).count() == 1 and relational.exact_sample(d, "id", 1.0).count() == 7
    with pytest.raises(ValueError):
        relational.exact_sample(d, "id", 0)
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("s"))
    split = relational.stratified_split(big, F.col("s"), "id", 0.2)
    counts = {r["s"]: (r["dev"], r["n"]) for r in split.groupBy("s").agg(F.sum((F.col("part") == "dev").cast("int")).alias("dev"), F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n for _, n in counts.values()) == 3000 and all(dev == int(n * 0.2 + 0.5) for dev, n in counts.values())
    nulls = relational.stratified_split(spark.createDataFrame([(1, None), (2, None)], "id long, s string"), F.col("s"), "id", 0.5)
    assert rows(nulls.groupBy("part").count()) == [("dev", 1), ("train", 1)]


def test_keep_first(spark):
    d = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (5, None, "w")], "row_id long, k string, v string")
    assert rows(relational.keep_first(d, ["k"], [F.col("row_id")]).select("row_id", "v")) == [(1, "y"), (2, "z")]
    u = relational.union_first_source(spark.createDataFrame([(9, "1")], "row_id long, id string"), spark.createDataFrame([(1, "1"), (2, "2")], "row_id long, id string"), "id", "row_id")
    assert rows(u.select("row_id", "id")) == [(2, "2"), (9, "1")]


def test_skew_states(spark):
    hot = [(i, 1, i % 11) for i in range(300)] + [(300 + i, 2 + i % 50, 5) for i in range(600)] + [(990, None, 3), (991, 1, None)]
    facts = spark.createDataFrame(hot, "row_id long, user_id long, rating int").withColumn("book_id", F.lit(None).cast("long"))
    users = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "user_id long, country string")
    books = spark.createDataFrame([], "book_id long")
    s = skew.keyed_statistics(facts, {"user_id": users, "book_id": books}, F.col("rating"))
    assert rows(skew.heavy_keys(s, 0.3)) == [("user_id", 1)]
    states = skew.eager_join_states(skew.key_states(facts.where("user_id is not null"), ["user_id"], F.col("rating")), users, "user_id", ["country"])
    got = {r["country"]: (r["n_rows"], r["n_values"], r["total"]) for r in skew.roll_up(states.where("matched"), ["country"]).collect()}
    raw = facts.join(users, "user_id").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("v"), F.sum(F.col("rating").cast("double")).alias("t")).collect()
    assert got == {r["country"]: (r["n"], r["v"], r["t"]) for r in raw}
    empty = skew.keyed_statistics(facts.limit(0), {"user_id": users}, F.col("rating"))
    assert rows(skew.heavy_keys(empty, 0.02)) == []


def test_text(spark):
    d = spark.createDataFrame([(1, "The annual report, 2020"), (2, ""), (3, None)], "id long, t string")
    assert [r[0] for r in d.select(text.terms(F.col("t"))).collect()] == [["the", "annual", "report", "2020"], [], []]
    assert [r[0] for r in d.select(text.ngrams(text.terms(F.col("t")))).collect()] == [["the annual", "annual report", "report 2020"], [], []]
    assert [r[0] for r in d.select(text.contains_phrase(F.col("t"), "Annual report")).collect()] == [True, False, False]
    v = spark.createDataFrame([("government",), ("governor",), ("gov",)], "term string")
    assert rows(text.fuzzy_terms(v, "goverment")) == [("government", 1)]
    s = {r["id"]: r["score"] for r in text.bm25(spark.createDataFrame([(1, "cash cash debt"), (2, "debt"), (3, "")], "id long, t string"), "id", {"t": 1.0}, ["cash"]).collect()}
    assert list(s) == [1]
    h = d.where("id = 1").select(text.highlight(F.col("t"), ["annual"])).first()[0]
    assert h == "The <mark>annual</mark> report, 2020"


def test_pearson(spark):
    r = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("b", 1, 4.0), ("b", 2, 2.0)], "u string, i long, r double")
    assert [(x["a"], x["b"], round(x["sim"], 6)) for x in collaborative.user_pearson(r, 2).collect()] == [("a", "b", 1.0)]


def test_micro_macro(spark):
    d = spark.createDataFrame([("X", "X"), ("X", "X"), ("Y", "X"), ("Y", "Y")], "g string, p string")
    m = metrics.micro_macro(d, "g", "p").first()
    assert round(m["p_micro"], 6) == 0.75 and round(m["p_macro"], 6) == 0.833333 and round(m["f1_macro"], 6) == 0.789474


def test_ontology_with_facts(spark):
    extra = [("BostonCeltics", "winPercentage", "0.65"), ("Old", "type", "Player"), ("Old", "age", "35"), ("Old", "playsFor", "BostonCeltics")]
    t = tree_queries.triples(spark).union(spark.createDataFrame(extra, "s string, p string, o string"))
    c = tree_queries._classes(t, tree_queries.subclasses(spark))
    assert rows(c["contender_team"]()) == [("BostonCeltics",), ("HarborHerons",), ("LakesideLynx",)]
    assert rows(c["veteran_ring_chaser"]()) == [("Old",), ("OldNoRing",)]
    chain = spark.createDataFrame([("a", "in", "b"), ("b", "in", "c")], "s string, p string, o string")
    assert rows(ontology.transitive(chain, "in")) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_config():
    s = config.overlay(config.RunSettings(), {"split": {"seed": 7}, "models": {"enabled": ["lexical"]}})
    assert s.split.seed == 7 and s.models.enabled == ("lexical",) and s.split.dev_size == 0.2
    with pytest.raises(KeyError):
        config.overlay(config.RunSettings(), {"nope": 1})
