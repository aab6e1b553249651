"""Queries that once did less than their whole job."""

import math

from pyspark.sql import functions as F

from millrace.operators import models, text
from millrace.plans import measure_queries, rating_queries, search_queries


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_title_bleu_reads_whole_bodies(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(40))
    d = written(spark, tmp_path, "documents", [(1, long, long), (2, "aa bb", "cc dd ee aa bb")], "doc_id long, title_en string, body_en string")
    got = {r["doc_id"]: r["log_bleu"] for r in measure_queries.title_bleu(spark, d).collect()}
    assert len(long) > 100 and got[1] == 0.0
    assert math.isclose(got[2], 1 - 5 / 2)


PAIRS = [(str(i), "a", f"what is the share price of stock {'one two three'.split()[i % 3]}", f"option {'low high'.split()[i % 2]}", i % 2) for i in range(12)]
PAIR_SCHEMA = "id string, label string, question string, option_text string, target int"


def pairs(spark):
    return spark.createDataFrame(PAIRS, PAIR_SCHEMA).withColumn("feature_text", F.concat_ws(" ", "question", "option_text"))


def test_word_vectors_embed_question_and_option_apart(spark):
    vectors = spark.createDataFrame([("aa", [1.0] * 200), ("bb", [3.0] * 200), ("cc", [5.0] * 200)], "word string, v array<double>")
    stage = models.PairVectors(vectors.select("word", models.array_to_vector("v").alias("vector")))
    got = stage.transform(spark.createDataFrame([("1", "aa bb unknown", "CC"), ("2", "unknown", None)], "id string, question string, option_text string"))
    v = {r["id"]: r["_v"].toArray().tolist() for r in got.collect()}
    assert v["1"] == [2.0] * 200 + [5.0] * 200 + [3.0] * 200 + [10.0] * 200 and v["2"] == [0.0] * 800


def test_pair_networks_have_the_sizes_of_the_survey(spark):
    w = models.fit_pairs(pairs(spark), "word2vec")
    assert list(w.stages[-1].getLayers()) == [800, 256, 64, 2] and w.stages[-1].getMaxIter() == 300
    m = models.fit_pairs(pairs(spark), "mlp")
    assert list(m.stages[-1].getLayers())[1:] == [256, 64, 2] and m.stages[3].getVocabSize() == 50_000 and "share price" in m.stages[3].vocabulary
    for model in (w, m):
        s = {r["id"]: r["score"] for r in models.predict_pairs(model, pairs(spark)).collect()}
        assert all((s[i] > 0.5) == bool(t) for i, _, _, _, t in PAIRS)


def test_more_like_this_takes_every_hundredth_document_in_all_languages(spark, data):
    got = search_queries.more_like_this(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "body_en", "body_ru")
    seeds = {r["doc_id"]: r for r in docs.where("doc_id % 100 = 0").collect()}
    assert seeds and {r["seed"] for r in got} <= set(seeds) and all(r["seed"] != r["doc_id"] for r in got)
    # documents of both sides under ids divisible by 100
    both = docs.where("body_en <> ''").limit(8).unionAll(docs.where("body_ru <> ''").limit(8)).collect()
    rows = [(100 * k, r["body_en"], r["body_ru"]) for k, r in enumerate(both)]
    small = spark.createDataFrame(rows, "doc_id long, body_en string, body_ru string")
    found = text.more_like_these(small, "doc_id", ["body_en", "body_ru"], F.col("doc_id") % 100 == 0).collect()
    assert {r["seed"] for r in found} & set(range(0, 800, 100)) and {r["seed"] for r in found} & set(range(800, 1600, 100))
    for f in ("body_en", "body_ru"):
        words = {i: [t for t in ts if t] for i, ts in small.select("doc_id", text.terms(F.col(f))).collect()}
        n = sum(bool(w) for w in words.values())
        df = lambda t: sum(t in w for w in words.values())  # noqa: E731, B023
        for seed, w in words.items():
            able = [t for t in set(w) if w.count(t) >= 2 and df(t) >= 5]
            top = sorted(able, key=lambda t: (-round(w.count(t) * (1 + math.log(n / (df(t) + 1))), 9), t))[:25]
            expected = {} if not top else {r["doc_id"]: r["score"] for r in text.bm25(small, "doc_id", {f: 1.0}, top).collect() if r["doc_id"] != seed}
            if w:
                mine = {r["doc_id"]: r["score"] for r in found if r["seed"] == seed}
                assert mine.keys() == expected.keys() and all(abs(mine[i] - expected[i]) < 2e-5 for i in mine)


def test_hybrid_predictions_cover_all_rows(spark, data, monkeypatch):
    usable = rating_queries._rows(spark, data)
    p = rating_queries.hybrid_gbt_predict(spark, data)
    assert p.count() == usable.count() and p.join(usable, "row_id").count() == usable.count()
    used = []
    fit = models.GBTRegressor._fit
    monkeypatch.setattr(models.GBTRegressor, "_fit", lambda self, t: used.append((self.getMaxIter(), self.isSet("validationIndicatorCol"), t.count())) or fit(self, t))
    s = rating_queries.hybrid_submission(spark, data)
    assert sorted(r["id"] for r in s.collect()) == list(range(usable.count()))
    assert all(u[:2] == (500, True) for u in used)
    sizes = [rating_queries._parts(spark, data)[0].count()] + [usable.count()] * (p.first()["model"] == "hybrid")
    assert [u[2] for u in used] == sizes


TEXTS = [(1, "s", "alpha title", "alpha title\n\nbeta gamma delta", "", ""), (2, "t", "", "", "друга новина", "друга новина\n\nбета гама"), (3, "t", None, None, None, None)]
TEXT_SCHEMA = "doc_id long, source string, title_en string, body_en string, title_ru string, body_ru string"


def test_feature_selection_and_pairs_over_whole_texts(spark, tmp_path):
    d = written(spark, tmp_path, "documents", TEXTS, TEXT_SCHEMA)
    words = {"alpha", "title", "beta", "gamma", "delta", "друга", "новина", "бета", "гама"}
    assert {r["term"]: r["chi2"] for r in measure_queries.text_chi2_terms(spark, d).collect()} == dict.fromkeys(words, 2.0)
    assert {r["term"]: r["gain"] for r in measure_queries.text_info_gain(spark, d).collect()} == dict.fromkeys(words, 1.0)
    assert {(r["term"], r["mi"]) for r in measure_queries.text_mutual_information(spark, d).collect()} == {(w, 1.0) for w in words}
    pairs = {(r["left"], r["right"]): r["n"] for r in search_queries.text_cooccurrence(spark, d).collect()}
    assert pairs[("alpha", "title")] == 2 and pairs[("gamma", "delta")] == 1 and pairs[("beta", "delta")] == 1 and pairs[("друга", "бета")] == 1
    assert ("beta", "beta") not in pairs and len(pairs) == 12


def test_text_queries_agree_with_titles(spark, tmp_path):
    """Without bodies and Cyrillic titles, whole texts are the English titles that SQL checks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit("") for c in ("body_en", "title_ru", "body_ru")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for m, name in ((measure_queries, "chi2_terms"), (measure_queries, "info_gain"), (measure_queries, "mutual_information"), (search_queries, "cooccurrence")):
        a, b = (sorted(map(tuple, m.QUERIES[q](spark, str(tmp_path)).collect())) for q in (name, f"text_{name}"))
        assert a and a == b


def test_lsa_gives_words_their_own_columns(spark, tmp_path):
    d = written(spark, tmp_path, "documents", TEXTS, TEXT_SCHEMA)
    got = {r["doc_id"]: r["components"] for r in measure_queries.svd_lsa(spark, d).collect()}
    assert set(got) == {1, 2}
    assert abs(sum(a * b for a, b in zip(got[1], got[2], strict=True))) < 1e-9 and all(any(abs(x) > 0.1 for x in v) for v in got.values())
