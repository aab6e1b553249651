"""Readers of files and folders; each gives a DataFrame with a declared schema and reads nothing until asked."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import normalize as N

QUESTIONS = "id string, question string, query string, choice_labels array<string>, option_texts map<string,string>, gold_letters array<string>, dataset_source string"


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by the suffix of its path: parquet, csv, jsonl or json (an array); any other is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        return reader.json(path, multiLine=True)
    raise ValueError(f"no reader for files of kind {kind!r}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A table with a header; quoted fields may hold line ends."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True, multiLine=True, escape='"', sep=sep)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Normalised questions from JSON lines; a missing source is ``unknown``, missing lists are empty."""
    q = spark.read.schema(QUESTIONS).json(path)
    empty = F.array().cast("array<string>")
    return q.where("id is not null or question is not null").withColumns({
        "dataset_source": F.coalesce("dataset_source", F.lit("unknown")),
        "choice_labels": F.coalesce("choice_labels", empty), "gold_letters": F.coalesce("gold_letters", empty),
    })


def read_partitioned_questions(spark: SparkSession, path: str, language: str, split: str) -> DataFrame:
    """A folder laid out as ``language=/split=``; only the wanted partition is listed and read."""
    return spark.read.parquet(path).where((F.col("language") == language) & (F.col("split") == split))


def read_sources(spark: SparkSession, source: str, paths: dict[str, str], explicit: str | None = None) -> DataFrame:
    """``finmmeval``, ``bbf`` or ``both``; an explicit path wins; of equal ids the first source's row stays."""
    from millrace.operators.relational import union_first_source

    if explicit:
        return read_any(spark, explicit)
    if source in ("finmmeval", "bbf"):
        return read_any(spark, paths[source])
    if source != "both":
        raise ValueError(f"no source {source!r}")
    return union_first_source(read_any(spark, paths["finmmeval"]), read_any(spark, paths["bbf"]), "id", "id")


def decoded(content: Column, lang: str = "RU") -> Column:
    """Text of bytes: UTF-8 where that is valid, else Windows-1251 in Russian, else UTF-8 without its faulty bytes."""
    russian = lang.upper() == "RU"

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return bytes(b).decode("utf-8-sig")
            except UnicodeDecodeError:
                pass
            try:
                return bytes(b).decode("cp1251" if russian else "utf-8")
            except UnicodeDecodeError:
                return bytes(b).decode("utf-8", "ignore")

        return raw.map(one)

    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(decode(content))


def empty_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``path, content`` of the files without a byte, which the file sources skip; found in the listing alone."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = folder.getFileSystem(hadoop).listFiles(folder, True)
    found = []
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(suffix):
            found.append((f.getPath().toString(), bytearray()))
    return spark.createDataFrame(found, "path string, content binary")


def read_text_corpus(spark: SparkSession, root: str, lang: str, max_docs: int | None = None) -> DataFrame:
    """Every ``*.txt`` under ``root`` as a search document of one language, with title and body in that language's columns; the first ``max_docs`` by path if given."""
    lang = lang.upper()
    if lang not in ("EN", "RU"):
        raise ValueError(f"no fields for language {lang!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root).select("path", "content")
    files = files.unionByName(empty_files(spark, root, ".txt"))
    base = F.lit(root.rstrip("/") + "/")
    path = F.element_at(F.split(F.col("path"), base, 2), -1)
    text = files.select(path.alias("path"), decoded(F.col("content"), lang).alias("text"))
    title, body = N.title_and_body(F.col("text"), F.regexp_extract("path", r"([^/]+)\.txt$", 1))
    if max_docs is not None:
        text = text.orderBy("path").limit(max_docs)
    mine = lambda c, k: c if lang == k else F.lit("")
    return text.select(
        F.concat_ws(":", F.lit(lang), "path").alias("id"), "path", F.lit(lang).alias("language"),
        mine(title, "EN").alias("title_en"), mine(body, "EN").alias("body_en"), mine(title, "RU").alias("title_ru"), mine(body, "RU").alias("body_ru"),
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o`` of the individuals of an RDF/XML document, by the built-in XML source."""
    x = spark.read.format("xml").option("rowTag", "owl:NamedIndividual").load(path)
    local = lambda c: F.regexp_extract(c, r"([^#/:]+)$", 1)
    parts = []
    for f in x.schema.fields:
        if f.name.startswith("_"):
            continue
        kind = f.dataType
        many = kind.typeName() == "array"
        value = F.explode_outer(F.col(f"`{f.name}`")) if many else F.col(f"`{f.name}`")
        inner = kind.elementType if many else kind
        y = x.select(local(F.col("`_rdf:about`")).alias("s"), F.lit(f.name.split(":")[-1]).alias("p"), value.alias("v"))
        names = inner.fieldNames() if inner.typeName() == "struct" else []
        if "_rdf:resource" in names:
            o = local(F.col("v.`_rdf:resource`"))
        elif "_VALUE" in names:
            o = F.col("v._VALUE").cast("string")
        else:
            o = F.col("v").cast("string")
        parts.append(y.select("s", "p", o.alias("o")).where("o is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Bytes of an ontology document that the driver may parse.
MOST_ONTOLOGY = 64 << 20

_OWL, _RDF, _RDFS, _XSD = ("{http://www.w3.org/%s#}" % x for x in ("2002/07/owl", "1999/02/22-rdf-syntax-ns", "2000/01/rdf-schema", "2001/XMLSchema"))


def read_axioms(spark: SparkSession, path: str) -> tuple[dict[str, tuple], list[tuple[str, str]], dict[str, list[str]]]:
    """Class definitions, (class, superclass) pairs, and sub-properties by property of an RDF/XML document.

    Definitions are expressions as ``operators.ontology.members`` takes them. Axioms are a
    schema and few, so they are parsed on the driver, up to a checked size; what lies beyond
    the forms known is an error and not left out.
    """
    raw = spark.read.format("binaryFile").load(path).select("length", "content")
    if (raw.agg(F.sum("length")).first()[0] or 0) > MOST_ONTOLOGY:
        raise ValueError(f"{path} is too large for an ontology")
    root = ElementTree.fromstring(bytes(raw.first()["content"]))
    local = lambda iri: re.split("[#/:]", iri)[-1]
    about = lambda x: local(x.get(f"{_RDF}about") or x.get(f"{_RDF}resource") or "")

    def expression(x) -> tuple:
        """An element that stands for a class: a name, a restriction, or an anonymous class."""
        if x.get(f"{_RDF}about") or x.get(f"{_RDF}resource"):
            return ("class", about(x))
        if x.tag == f"{_OWL}Restriction":
            return restriction(x)
        for child in x:
            if child.tag in (f"{_OWL}intersectionOf", f"{_OWL}unionOf"):
                return ("and" if child.tag.endswith("intersectionOf") else "or", *[expression(c) for c in child])
            if child.tag == f"{_OWL}complementOf":
                return ("not", ("class", about(child)) if len(child) == 0 else expression(child[0]))
            if child.tag == f"{_OWL}oneOf":
                return ("one_of", *[about(c) for c in child])
        raise ValueError(f"no class expression in {x.tag}")

    def restriction(x) -> tuple:
        p = about(x.find(f"{_OWL}onProperty"))
        for form, kind in (("hasValue", "value"), ("someValuesFrom", "some"), ("allValuesFrom", "only")):
            v = x.find(f"{_OWL}{form}")
            if v is None:
                continue
            if kind == "value":
                return ("value", p, about(v) or (v.text or "").strip())
            low = v.find(f".//{_XSD}minInclusive")
            if low is not None:
                return ("least", p, float(low.text))
            return (kind, p, ("class", about(v)) if len(v) == 0 else expression(v[0]))
        raise ValueError(f"no restriction on {p}")

    definitions: dict[str, tuple] = {}
    above: list[tuple[str, str]] = []
    for c in root.findall(f"{_OWL}Class"):
        for e in c.findall(f"{_OWL}equivalentClass"):
            definitions[about(c)] = ("class", about(e)) if len(e) == 0 else expression(e[0])
        above += [(about(c), about(s)) for s in c.findall(f"{_RDFS}subClassOf") if about(s)]
    below: dict[str, list[str]] = {}
    for p in root.findall(f"{_OWL}ObjectProperty"):
        for s in p.findall(f"{_RDFS}subPropertyOf"):
            below.setdefault(about(s), []).append(about(p))
    return definitions, above, below


def read_annotations(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Annotation rows of separated values with a header."""
    return read_csv(spark, path, sep=sep)


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """``key`` and the fields of each value of a JSON object keyed by document."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "v")).select("key", "v.*")
