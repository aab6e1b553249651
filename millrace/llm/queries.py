"""Queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.llm import exact_duplicates, languages, leakage, lookalikes, mojibake, name_variants, split_overlap, tokenizer, value_mapping


def _question_members(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select("row_id", "question", "option_texts")
    return exact_duplicates.duplicate_members(q, exact_duplicates.canonical_key(F.col("question"), F.col("option_texts")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    m = _question_members(spark, d)
    return m.where("row_id <> head").select(F.col("head").alias("row_a"), F.col("row_id").alias("row_b")).distinct()


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each group of duplicates, with its exact number of copies."""
    return exact_duplicates.representatives(_question_members(spark, d))


def _mapped_users(spark: SparkSession, d: str) -> DataFrame:
    reference = value_mapping.reference_list(table(spark, d, "countries"), "country_code", "country_name")
    users = table(spark, d, "users").select("user_id", "country")
    return value_mapping.map_values(users, F.col("country"), reference, "country_code", value_mapping.country_names(spark, reference))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = F.broadcast(table(spark, d, "countries").select(F.col("country_name").alias("country")))
    m = _mapped_users(spark, d).where("country_code is not null and user_id is not null")
    return m.join(names, "country", "left_anti").select("user_id", "country_code").distinct()


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value typed, the code it was mapped to, and its rows."""
    return _mapped_users(spark, d).groupBy("country", "country_code").agg(F.count(F.lit(1)).alias("n_rows"))


def _languages(spark: SparkSession, d: str, what: str) -> DataFrame:
    return languages.label_languages(table(spark, d, "documents").select("doc_id", "text", "language"), what)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, "cases").distinct()


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its language and a confidence."""
    return _languages(spark, d, "documents")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every passage with its span, language and a confidence."""
    return _languages(spark, d, "segments")


NAME_FIELDS = ["author", "publisher"]


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling that has variants, with a class for its person or house, the number of spellings linked to it and its best link's rarity."""
    c = name_variants.variant_classes(table(spark, d, "books").select(*NAME_FIELDS), NAME_FIELDS)
    n = c.groupBy("field_name", "class").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return c.hint("merge").join(n.hint("merge"), ["field_name", "class"]).select("field_name", "name", "class", "n_links", "score")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(name_variants.variant_classes(table(spark, d, "books").select(*NAME_FIELDS), NAME_FIELDS))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlapping_rows(table(spark, d, "questions").select("row_id", "split_name", "question", "option_texts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    o = _overlaps(spark, d)
    return o.select(F.least("eval_id", "train_id").alias("row_a"), F.greatest("eval_id", "train_id").alias("row_b")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs, and the evaluation rows in them, by split and source."""
    rows = table(spark, d, "questions").select(F.col("row_id").alias("eval_id"), "split_name", "dataset_source")
    return _overlaps(spark, d).hint("merge").join(rows.hint("merge"), "eval_id").groupBy("split_name", "dataset_source").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_rows")
    )


GARBLED_FIELDS = ["body_ru", "title_ru"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", *GARBLED_FIELDS)
    return mojibake.garbled_fields(mojibake.garbled_tokens(docs, "doc_id", GARBLED_FIELDS)).select("doc_id", "field_name")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled fields, given back readable as far as their words have one original."""
    return mojibake.restore(table(spark, d, "documents").select("doc_id", *GARBLED_FIELDS), "doc_id", GARBLED_FIELDS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document and item it holds, with the words matched and the spans to be removed."""
    return leakage.leaked_items(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "heldout_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a look-alike: its class, the digest of the form, and the number of its look-alikes."""
    return lookalikes.same_looking_classes(table(spark, d, "documents"))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one form."""
    return lookalikes.normalise_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_values": p2_values,
    "p4_found": p4_found,
    "p4_documents": p4_documents,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_texts": p10_texts,
}
SQL: dict[str, str] = {}
