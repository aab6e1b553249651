"""Readers and sinks, round trips through files, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import ontology
from millrace.sources import readers, writers
from millrace.streaming import interactions


def test_suffixes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,"a ""quoted"" one"\n')
    assert readers.read_any(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_any(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert sorted(r["y"] for r in readers.read_any(spark, str(tmp_path / "a.csv")).collect()) == ['a "quoted" one', "two\nlines"]
    with pytest.raises(ValueError):
        readers.read_any(spark, "a.txt")


def test_questions(spark, tmp_path):
    row = {"id": "1", "question": "Q", "choice_labels": ["a"], "option_texts": {"a": "x"}, "gold_letters": ["a"]}
    (tmp_path / "q.jsonl").write_text(json.dumps(row) + "\n\n")
    q = readers.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert q.first()["dataset_source"] == "unknown"
    writers.write_questions(q, str(tmp_path / "out"))
    assert readers.read_questions(spark, str(tmp_path / "out")).first()["option_texts"] == {"a": "x"}
    writers.label_csv(spark.createDataFrame([("1", ["a", "b"])], "id string, labels array<string>"), str(tmp_path / "p"))
    assert readers.read_csv(spark, str(tmp_path / "p")).first()["labels"] == "a,b"


def test_corpus(spark, tmp_path):
    d = tmp_path / "c" / "sub"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes("Заголовок\nТекст".encode("cp1251"))
    (tmp_path / "c" / "b.txt").write_bytes("\nЗаголовок\nТекст\n".encode())
    (tmp_path / "c" / "e.txt").write_text("")
    (tmp_path / "c" / "x.md").write_text("no")
    got = {r["path"]: (r["id"], r["title_ru"], r["body_ru"], r["title_en"]) for r in readers.read_text_corpus(spark, str(tmp_path / "c"), "ru").collect()}
    assert got["sub/a.txt"] == ("RU:sub/a.txt", "Заголовок", "Заголовок\nТекст", "")
    assert got["b.txt"][1] == "Заголовок" and got["e.txt"][1:3] == ("e", "") and len(got) == 3
    with pytest.raises(ValueError):
        readers.read_text_corpus(spark, str(tmp_path), "de")


def test_bytes_by_language(spark):
    """Bytes that are no UTF-8 are Windows-1251 in Russian only; in English the faulty ones go."""
    d = spark.createDataFrame([(bytearray("Да".encode("cp1251")),), (bytearray(b"caf\xe9!"),), (bytearray("Да".encode()),), (None,)], "c binary")
    assert [r[0] for r in d.select(readers.decoded(F.col("c"), "RU")).collect()] == ["Да", "cafй!", "Да", None]
    assert [r[0] for r in d.select(readers.decoded(F.col("c"), "EN")).collect()] == ["", "caf!", "Да", None]


def test_first_documents(spark, tmp_path):
    for n in "bca":
        (tmp_path / f"{n}.txt").write_text(n)
    assert [r["path"] for r in readers.read_text_corpus(spark, str(tmp_path), "EN", 2).orderBy("path").collect()] == ["a.txt", "b.txt"]


def test_small_sinks(spark, tmp_path):
    parts = spark.createDataFrame([("1", "dev"), ("2", "train"), ("3", "dev")], "id string, part string")
    writers.write_split_ids(parts, str(tmp_path / "split"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "split")).select("id", "part").collect())) == [("1", "dev"), ("2", "train"), ("3", "dev")]
    text = writers.markdown_facts(spark.createDataFrame([(3, 0.25)], "train_rows int, zero_pct double"), "Facts")
    assert text.splitlines()[-2:] == ["| train rows | 3 |", "| zero pct | 0.2500 |"]
    for content in ("old", text):
        writers.write_text(spark, content, str(tmp_path / "facts.md"))
    assert (tmp_path / "facts.md").read_text() == text


def test_markdown(spark):
    t = writers.markdown_table(spark.createDataFrame([("a", 0.5), ("b", 0.75)], "model string, exact double"), "exact")
    assert t.splitlines()[2] == "| b | 0.7500 |"


def test_triples(spark, tmp_path):
    (tmp_path / "o.rdf").write_text(
        '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:n="n"><owl:NamedIndividual rdf:about="http://x#A"><rdf:type rdf:resource="http://x#P"/><n:won rdf:resource="http://x#C"/><n:won rdf:resource="http://x#D"/><n:age>30</n:age></owl:NamedIndividual></rdf:RDF>'
    )
    got = sorted(tuple(r) for r in readers.read_triples(spark, str(tmp_path / "o.rdf")).collect())
    assert got == [("A", "age", "30"), ("A", "type", "P"), ("A", "won", "C"), ("A", "won", "D")]


def test_keyed_json(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"p1": {"label": "x"}, "p2": {"label": null}}')
    assert sorted((r["key"], r["label"]) for r in readers.read_keyed_json(spark, str(tmp_path / "k.json"), "struct<label:string>").collect()) == [("p1", "x"), ("p2", None)]


def test_stream(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    interactions.run_to_end(interactions.windowed_strengths(interactions.read_events(spark, str(tmp_path / "in"))), out, state)
    got = spark.read.parquet(out)
    batch = spark.read.parquet(f"{data}/events.parquet").where(F.col("event_type").isin("view", "click", "purchase"))
    # rows of windows that the watermark has not passed yet stay in the state
    assert 0 < got.agg(F.sum("n")).first()[0] <= batch.count()
    assert got.groupBy("start", "person_id").count().where("count > 1").isEmpty()


def test_axioms(spark, tmp_path):
    """Definitions read from a document hold for the individuals of the same document."""
    iri = "http://example.org/o#"
    restrict = lambda p, body: f'<owl:Restriction><owl:onProperty rdf:resource="{iri}{p}"/>{body}</owl:Restriction>'
    named = lambda c: f'<rdf:Description rdf:about="{iri}{c}"/>'
    least = '<owl:someValuesFrom><rdfs:Datatype><owl:withRestrictions rdf:parseType="Collection"><rdf:Description><xsd:minInclusive>32</xsd:minInclusive></rdf:Description></owl:withRestrictions></rdfs:Datatype></owl:someValuesFrom>'
    only = f'<owl:allValuesFrom><owl:Class><owl:oneOf rdf:parseType="Collection">{named("Red")}{named("Blue")}</owl:oneOf></owl:Class></owl:allValuesFrom>'

    def define(name, *parts):
        return f'<owl:Class rdf:about="{iri}{name}"><owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection">{"".join(parts)}</owl:intersectionOf></owl:Class></owl:equivalentClass><rdfs:subClassOf rdf:resource="{iri}Person"/></owl:Class>'

    people = {"ann": ("40", ["Red"], "T1"), "bob": ("31", ["Red", "Green"], "T1"), "cid": ("32", [], "T2")}
    individuals = "".join(
        f'<owl:NamedIndividual rdf:about="{iri}{n}"><rdf:type rdf:resource="{iri}Person"/><o:age>{a}</o:age><o:playsFor rdf:resource="{iri}{t}"/>{"".join(f"<o:likes rdf:resource={iri + c!r}/>" for c in cs)}</owl:NamedIndividual>'.replace("='", '="').replace("'/>", '"/>')
        for n, (a, cs, t) in people.items()
    )
    document = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:xsd="http://www.w3.org/2001/XMLSchema#" xmlns:o="{iri}">
    <owl:ObjectProperty rdf:about="{iri}hasWonAward"><rdfs:subPropertyOf rdf:resource="{iri}hasWon"/></owl:ObjectProperty>
    {define("Old", named("Person"), restrict("age", least))}
    {define("Plain", named("Person"), restrict("likes", only))}
    {define("OfT1", named("Person"), restrict("playsFor", f'<owl:hasValue rdf:resource="{iri}T1"/>'))}
    {define("OldNotT1", named("Old"), f'<owl:Class><owl:complementOf rdf:resource="{iri}OfT1"/></owl:Class>')}
    {individuals}</rdf:RDF>"""
    (tmp_path / "o.rdf").write_text(document)
    path = str(tmp_path / "o.rdf")
    axioms, above, below = readers.read_axioms(spark, path)
    assert axioms["OldNotT1"] == ("and", ("class", "Old"), ("not", ("class", "OfT1"))) and ("Old", "Person") in above and below == {"hasWon": ["hasWonAward"]}
    t, sub = readers.read_triples(spark, path), spark.createDataFrame(above, "child string, parent string")
    got = {c: sorted(r[0] for r in ontology.members(("class", c), t, sub, axioms).collect()) for c in axioms}
    assert got == {"Old": ["ann", "cid"], "Plain": ["ann", "cid"], "OfT1": ["ann", "bob"], "OldNotT1": ["cid"]}
    either = ("or", ("class", "OldNotT1"), ("not", ("class", "Old")))
    assert sorted(r[0] for r in ontology.members(either, t, sub, axioms).collect()) == ["bob", "cid"]
    with pytest.raises(ValueError):
        ontology.members(("class", "A"), t, sub, {"A": ("not", ("class", "A"))})
