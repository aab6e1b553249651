"""Every query of the ten problems on empty tables, on nulls in every column, and beside columns of clashing names."""

import datetime

import pytest

from millrace.llm import queries

CLASH = ["_key", "class", "form", "token", "word", "head", "block", "key", "field_name", "spelling", "lang_x", "a", "b", "x", "n"]
SCHEMAS = {
    "questions": "row_id long, id string, split_name string, dataset_source string, question string, query_text string, choice_labels array<string>, option_texts map<string,string>, gold_letters array<string>, loaded_at timestamp",
    "users": "user_id long, country string, age double, updated_at timestamp",
    "books": "book_id long, title string, author string, publisher string, pub_year string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, id string, path string, language string, title_en string, body_en string, title_ru string, body_ru string, published_at timestamp, fetched_at timestamp",
    "countries": "country_code string, country_name string",
    "heldout_items": "item_id long, item_text string, item_kind string",
}
NOW = datetime.datetime(2024, 1, 1)
ROWS = {
    "questions": [
        (None, None, None, None, None, None, None, None, None, None),
        (1, "q", "train", None, "What is 1,000 worth?", None, ["A"], {"A": None, "B": "x"}, [], NOW),
        (2, "q", "dev", "bbf", "what is 1 000 worth", None, None, {"b": "X", "a": ""}, None, None),
        (3, "", "test", "bbf", "", "", [], {}, [], NOW),
        (3, "", "train", "bbf", "", "", [], {}, [], NOW),
        (4, "r", "other", "bbf", "w " * 30_000, "", [], {"a": "y" * 5000}, [], NOW),
    ],
    "users": [(None, None, None, None), (1, "germany", 5.0, NOW), (1, "germany", 6.0, NOW), (2, " ", None, NOW), (3, "Z" * 3000, None, NOW), (None, "France", None, NOW), (4, "Germany", None, NOW)],
    "books": [(None, None, None, None, None), (1, "t", "Ann Bolt", "Bolt & Sons", "1"), (1, "t", "bolt, ann", "bolt and sons", "1"), (2, "t", "", " ", "1"), (3, "t", "unknown", "n/a", "1"), (4, "t", "a " * 300, "z" * 900, "1")],
    "documents": [
        (None,) * 14,
        (1, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, "i", "p", "EN", "", "", "", "", NOW, NOW),
        (3, "The cat sat on the mat and looked at the moon. " * 40, "en", "s", 5, "i", "p", "EN", "t", "b", "", "", NOW, NOW),
        (4, "Кошка сидела на ковре и смотрела на луну. " * 40, "ru", "s", 5, "i", "p", "EN", "", "", "Кошка", "Кошка сидела на ковре", NOW, NOW),
        (5, "Кошка сидела".encode().decode("latin-1"), "ru", "s", 5, "i", "p", None, "", "", None, "Кошка сидела".encode().decode("latin-1"), NOW, NOW),
        (6, "The cаt sat on the mat and looked at the moon. " * 40, "en", "s", 5, "i", "p", "EN", "t", "b", "", "", NOW, NOW),
        (6, "The cаt sat on the mat and looked at the moon. " * 40, "en", "s", 5, "i", "p", "EN", "t", "b", "", "", NOW, NOW),
    ],
    "countries": [("DE", "Germany"), ("FR", "France"), (None, "Nowhere"), ("XX", None)],
    "heldout_items": [(1, "The cat sat on the mat and looked at the moon.", "mcq"), (2, None, None), (3, "", "mcq"), (None, "x", "mcq")],
}
#: Rows that each query gives for the tables above, where a case defines them.
EXPECTED = {
    "p1_found": [(1, 2)],
    "p2_found": [(1, "DE"), (3, "NONE")],
    "p5_found": [("author", "Ann Bolt", "bolt, ann"), ("publisher", "Bolt & Sons", "bolt and sons")],
    "p6_found": [(1, 2)],
    "p7_found": [(5, "body_ru")],
    "p9_found": [(3, 1), (6, 1)],
    "p10_found": [(3, 6)],
}


def write(spark, folder, tables, clash):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(tables.get(name, []), schema)
        for c in CLASH if clash else []:
            if c not in df.columns:
                df = df.selectExpr("*", f"'clash' as `{c}`")
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edges")
    return write(spark, base / "empty", {}, False), write(spark, base / "odd", ROWS, True)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "p8_ids"])
def test_edges(spark, folders, name):
    empty, odd = folders
    assert queries.QUERIES[name](spark, empty).count() == 0
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, odd).collect()) if name in EXPECTED else queries.QUERIES[name](spark, odd).collect()
    if name in EXPECTED:
        assert got == EXPECTED[name]


def test_token_edges(spark, folders):
    empty, odd = folders
    assert queries.p8_ids(spark, empty).count() == 0
    got = queries.p8_ids(spark, odd).collect()
    assert len(got) == len(ROWS["documents"]) and [list(r["ids"]) for r in got if r["doc_id"] in (1, 2)] == [[], []]
