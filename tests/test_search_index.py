"""The inverted index against scoring by hand, its changes, and the stems of the analysers."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import analysis
from millrace.operators import search_index
from millrace.operators.text import B, K1

DOCS = [
    (1, "annual report", "the annual report on exports was late", 1),
    (2, "exports", "report on annual exports and exports again", 1),
    (3, "other", "nothing to see here", 1),
    (4, None, None, 1),
    (5, "", "annual", 1),
    (5, "", "annual annual report", 2),
    (None, "annual", "annual", 1),
]
FIELDS = {"title": "plain", "body": "plain"}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, body string, version int")


def brute(docs, query, boosts, need=1):
    out = {}
    for f, boost in boosts.items():
        words = {d[0]: analysis.ANALYSERS["plain"](d[1 if f == "title" else 2] or "") for d in docs}
        full = [w for w in words.values() if w]
        mean = sum(map(len, full)) / max(len(full), 1)
        for k, w in words.items():
            s, hits = 0.0, 0
            for q in query.split():
                n, tf = sum(q in x for x in full), w.count(q)
                if tf:
                    hits += 1
                    s += math.log(1 + (len(full) - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            if hits >= need:
                out[k] = max(out.get(k, 0), s * boost)
    return out


def check(got, expected):
    got = {r["doc"]: r["score"] for r in got.collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_index_against_brute_force(spark, tmp_path):
    folder = str(tmp_path / "index")
    newest = [F.negative("version")]
    search_index.build(frame(spark, DOCS), folder, FIELDS, order=newest, stored=["version"])
    live = [*DOCS[:4], DOCS[5]]
    boosts = {"title": 3.0, "body": 1.0}
    check(search_index.search(spark, folder, "annual exports", boosts, size=None), brute(live, "annual exports", boosts))
    check(search_index.search(spark, folder, "annual exports", boosts, share=1.0, size=None), brute(live, "annual exports", boosts, 2))
    assert [r["doc"] for r in search_index.search(spark, folder, "anual", {"body": 1.0}, fuzzy=True, size=2).collect()] == [5, 1]
    assert search_index.search(spark, folder, "unheard of", boosts).count() == 0
    got = search_index.phrase(spark, folder, "report on", ["title", "body"])
    assert sorted(map(tuple, got.collect())) == [(1, "body", [2]), (2, "body", [0])]
    assert {r["doc"] for r in search_index.documents(spark, folder).collect()} == {1, 2, 3, 4, 5}


def test_index_changes(spark, tmp_path):
    folder, newest = str(tmp_path / "index"), [F.negative("version")]
    with pytest.raises(ValueError):
        search_index.upsert(frame(spark, DOCS), folder, newest)
    search_index.build(frame(spark, DOCS), folder, FIELDS, order=newest)
    new = [(1, "annual report", "no more of it", 2), (1, "older", "annual exports", 1), (9, "exports", "annual exports", 1)]
    search_index.upsert(frame(spark, new), folder, newest)
    found = {r["doc"] for r in search_index.search(spark, folder, "annual exports", {"body": 1.0}, size=None).collect()}
    assert found == {2, 5, 9}  # of 1 the newest row stands, which has neither
    rows = [*DOCS[1:4], DOCS[5], new[0], new[2]]
    search_index.compact(spark, folder, frame(spark, rows))
    check(search_index.search(spark, folder, "annual exports", {"body": 1.0}, size=None), brute(rows, "annual exports", {"body": 1.0}))
    assert len(search_index.manifest(spark, folder)["segments"]) == 1


def test_index_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "index")
    search_index.build(frame(spark, []), folder, FIELDS)
    assert search_index.search(spark, folder, "annual", {"body": 1.0}).count() == 0


def test_stems(spark):
    english = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat sized:size hopping:hop falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam predication:predic operator:oper feudalism:feudal hopefulness:hope formality:formal triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv allowance:allow inference:infer adjustable:adjust replacement:replac adoption:adopt communism:commun effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil"
    for pair in english.split():
        word, stem = pair.split(":")
        assert analysis.english_stem(word) == stem, word
    russian = "вагоны:вагон важная:важн важнее:важн важнейшие:важн важничал:важнича важно:важн важности:важност валенках:валенк валился:вал валом:вал валяется:валя книгами:книг"
    for pair in russian.split():
        word, stem = pair.split(":")
        assert analysis.russian_stem(word) == stem, word
    d = spark.createDataFrame([("The company's reports",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(analysis.analysed(F.col("t"), "english")).collect()] == [["compani", "report"], [], []]
