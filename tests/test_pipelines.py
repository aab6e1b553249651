"""The whole jobs over the smallest tables, and single pieces of the methods of ``social`` and ``relational``."""

import json
import math

import pytest
from pyspark.sql import functions as F

from millrace import __main__ as command
from millrace.operators import collaborative, language_model, models, relational, social, text, tree
from millrace.plans import config, pipelines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_run_all(spark, data, tmp_path):
    out = str(tmp_path / "out")
    (tmp_path / "c.json").write_text(json.dumps({"models": {"enabled": ["lexical", "common_letter"], "submit": "common_letter"}, "split": {"seed": 3}}))
    settings = config.load_settings(spark, str(tmp_path / "c.json"))
    assert settings.models.enabled == ("lexical", "common_letter") and settings.split.seed == 3
    got = {r["model"]: r["evaluated"] for r in pipelines.run_all(spark, data, out, settings).collect()}
    split = spark.read.json(f"{out}/split")
    assert set(got.values()) == {split.where("part = 'dev'").count()} and set(got) == {"lexical", "common_letter"}
    questions, submission = spark.read.json(f"{out}/questions.jsonl"), spark.read.csv(f"{out}/submission", header=True)
    assert rows(questions.select("id")) == rows(submission.select("id")) and submission.select("answer").distinct().count() == 1
    assert "| lexical |" in (tmp_path / "out" / "metrics.md").read_text()
    command.main(["profile", "--data", data, "--out", out])
    assert (tmp_path / "out" / "profile.md").read_text().startswith("# Rating data")
    with pytest.raises(ValueError):
        pipelines.labels_by(spark, out, "nothing", questions)


def test_model_hook(spark):
    d = spark.createDataFrame([("a", "bb"), ("ccc", None)], "q string, o string")
    load = lambda: lambda q, o: [len(x) + len(y or "") for x, y in zip(q, o, strict=True)]
    assert [r["score"] for r in models.score_batches(d, ["q", "o"], load).collect()] == [3.0, 3.0]


def test_tags_and_trust(spark):
    r = spark.createDataFrame([(1, 10, 5.0), (1, 11, 1.0), (2, 10, 5.0), (2, 12, 2.0)], "u long, i long, r double")
    t = spark.createDataFrame([(10, "x"), (11, "y"), (12, "x"), (12, "only"), (11, None)], "i long, k string")
    got = {(u, i): (m, round(s, 6)) for u, i, m, s, _ in rows(social.tag_scores(r, t.where("k is not null")))}
    assert got[(1, 10)] == (5.0, 5.0) and got[(2, 10)] == (5.0, 3.5) and (1, 11) not in got
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.8), ("a", "c", 0.1), ("c", "a", 1.0), ("c", "c", 1.0)], "a string, b string, w double")
    got = {(a, b): (round(w, 6), h) for a, b, w, h in rows(social.trust_within(e, 2))}
    assert got[("a", "c")] == (0.4, 2) and got[("b", "a")] == (0.8, 2) and ("c", "c") not in got
    assert rows(social.strongest(e.where("a = 'a'"), 1)) == [("a", "b", 0.5)]


def test_attacks(spark):
    r = spark.createDataFrame([(u, i, float((u + i) % 5)) for u in range(40) for i in range(8)], "u long, i long, r double")
    seg = spark.createDataFrame([(1,), (2,)], "i long")
    for kind in social.ATTACKS:
        fake = social.attack(r, 3, kind, seg, 0.05, 4)
        got = fake.collect()
        assert len(got) == 2 * 5 and {x["u"] for x in got} == {-1, -2} and all(0 <= x["r"] <= 10 for x in got)
        assert {x["r"] for x in got if x["i"] == 3} == ({0.0} if kind == "love_hate" else {10.0})
    with pytest.raises(ValueError):
        social.attack(r, 3, "none", seg)


def test_mixtures_and_relations(spark):
    a = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.0), ("g", 3, 0.5)], "g string, i long, score double")
    b = spark.createDataFrame([("g", 1, 7.0), ("g", 2, 9.0), ("g", 4, 1.0)], "g string, i long, score double")
    assert rows(social.mixed({"a": a, "b": b}, "g", "i", 1)) == [("g", 1, 0.5, "a", 1), ("g", 2, 9.0, "b", 1)]
    assert rows(social.cascade(a, b, ["g", "i"])) == [("g", 1, 7.0), ("g", 2, 0.0), ("g", 4, 0.0)]
    p = social.priorities(b, F.col("score"), 0.5).select("i", "p").collect()
    assert sum(x["p"] for x in p) == pytest.approx(1) and {x["i"]: x["p"] for x in p}[2] == pytest.approx(3 / (3 + 1 + math.sqrt(7)))
    rel = spark.createDataFrame([("x", "p", "y"), ("x", "p", None), ("y", "p", "x")], "head_type string, predicate string, tail_type string")
    assert rows(social.allowed_relations(rel, rel.where("head_type = 'x'").unionByName(rel))) == [("x", "p", "y"), ("y", "p", "x")]


def test_neighbours_of_items(spark):
    r = spark.createDataFrame([(u, i, float(1 + (u * i) % 4)) for u in range(6) for i in (1, 2)] + [(9, 1, 3.0)], "u long, i long, r double")
    (a, b, n, sim) = rows(collaborative.item_cosine(r, 1))[0]
    x, y = [1 + u % 4 for u in range(6)] + [3], [1 + (2 * u) % 4 for u in range(6)]
    expected = sum(p * q for p, q in zip(x, y, strict=False)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    assert (a, b, n) == (1, 2, 6) and sim == pytest.approx(expected)
    assert dict((tuple(k[:2]), k[2]) for k in rows(collaborative.predict_from_items(r, collaborative.item_cosine(r, 1))))[(9, 2)] == pytest.approx(3.0)


def test_beam_and_learners(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c"],), (["a", "d", "e"],), (["x"],)], "w array<string>")
    assert [tuple(r)[1] for r in language_model.beam(d, "w", "a", 2, 2).orderBy("rank").collect()] == ["a b c", "a d e"]
    assert [tuple(r)[1] for r in language_model.beam(d, "w", "a", 9, 1).collect()] == ["a b c"]
    x = spark.createDataFrame([([float(k), 1.0, -float(k)], int(k > 0)) for k in range(-30, 31) if k], "x array<double>, y int")
    for kind in ("perceptron", "winnow"):
        w = models.fit_online(x, "x", "y", kind)
        assert x.where(models.online_score(F.col("x"), w, kind) != F.col("y")).count() <= 2
    assert models.tree_labels(x, "x", "y").where("said <> y").count() == 0
    with pytest.raises(ValueError):
        models.fit_online(x, "x", "y", "none")


def test_counts_within_rows(spark):
    d = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"])], "id long, w array<string>")
    assert rows(text.term_counts(d, "id", F.col("w"))) == [(1, "a", 1), (1, "b", 2), (4, "a", 1)]
    assert text.term_counts(d.limit(0), "id", F.col("w")).count() == 0
    w = {(i, t): x for i, t, x in rows(text.tfidf(d, "id", F.col("w"), 4, 1, 1.0))}
    ia, ib = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    assert w[(4, "a")] == pytest.approx(1) and w[(1, "b")] == pytest.approx(2 * ib / math.hypot(2 * ib, ia))


def test_ranges_and_hashes(spark):
    d = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit(2).alias("v"))
    assert all(r["t"] == 2 * (r["k"] + 1) for r in relational.running_total(d, "k", "v", "t").collect())
    assert all(r["id"] == r["k"] for r in relational.dense_ids(d, "k").collect())
    big = spark.createDataFrame([(k,) for k in (5, 5 + relational.BASE, 5 + relational.BASE**2, 2**62)], "k long")
    got = [r[0] for r in big.select(relational.order_hash(F.col("k"))).collect()]
    assert len(set(got)) == 4 and all(0 <= h < relational.MODULUS for h in got)


def test_trees_with_a_cycle(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent long, child long")
    with pytest.raises(ValueError):
        tree.node_facts(ring)
    with pytest.raises(ValueError):
        tree.closure(ring)
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "parent long, child long")
    assert rows(tree.node_facts(chain)) == [(k, k, 21 - k, 21 - k) for k in range(21)]


def test_tree_in_order(spark):
    edges = [(1, 5), (1, 3), (3, 9), (3, 4), (5, 7), (20, 21)]
    got = {r["node"]: r["place"] for r in tree.preorder(spark.createDataFrame(edges, "parent long, child long")).collect()}
    assert sorted(got, key=got.get) == [1, 3, 4, 9, 5, 7, 20, 21] and sorted(got.values()) == list(range(8))


def test_trigrams(spark):
    d = spark.createDataFrame([(["a", "b", "c", "a", "b"],), (["a", "b", "d"],), (["a", "b"],), ([],), (None,)], "w array<string>")
    assert rows(language_model.ngram_model(d, "w", 3)) == [("a b", "c", 1, 0.5), ("a b", "d", 1, 0.5), ("b c", "a", 1, 1.0), ("c a", "b", 1, 1.0)]
