"""Literal fixtures of the row-level normalisers."""

from pyspark.sql import functions as F

from millrace.functions import normalize as N


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_candidate_to_label(spark):
    rows = [("(A)", 0), ("B.", 0), ("2", 0), ("1", 0), ("0", 0), ("27", 0), ("option_c", 0), ("opt 3", 0), ("Answer", 0), ("", 3), ("--", 2), (None, 1)]
    got = values(spark, rows, "c string, i int", N.candidate_to_label(F.col("c"), F.col("i")))
    # of a word the last letter counts
    assert got[:8] == ["a", "b", "b", "a", "a", "option_27", "c", "c"]
    assert got[8:] == ["r", "d", "c", "b"]


def test_candidates_of_any_form(spark):
    rows = [("a-", 5), ("12b", 5), ("option 2 b", 5), ("x" * 30 + "7", 5), ("9" * 40, 5), ("007", 5), ("é", 5), ("№ 12.", 3)]
    assert values(spark, rows, "c string, i int", N.candidate_to_label(F.col("c"), F.col("i"))) == ["a", "b", "b", "g", "option_" + "9" * 40, "g", "f", "d"]


def mixed(spark, rows, kind, query=None):
    df = spark.createDataFrame(rows, f"o {kind}, q string")
    out = df.select(N.mixed_options(F.col("o"), df.schema["o"].dataType, F.col("q") if query else None).alias("m")).collect()
    return [(r["m"]["labels"], r["m"]["texts"]) for r in out]


def test_mixed_options(spark):
    rows = [({"A": " one "}, None), ({"(b)": None}, None), ({"3": ""}, None), (None, None), ({}, "A. x\nC. y")]
    assert mixed(spark, rows, "map<string,string>") == [(["a"], {"a": "one"}), (["b"], {"b": "Option A"}), (["c"], {"c": "Option A"}), ([], {}), ([], {})]
    assert mixed(spark, [({"B": "new"}, "C. y\nB. old"), ({"D": ""}, "C. y")], "map<string,string>", True) == [(["b", "c"], {"b": "new", "c": "y"}), (["c", "d"], {"c": "y", "d": "Option B"})]
    assert mixed(spark, [(["A. one", " ", "two", None, "C: three"], None)], "array<string>") == [(["a", "c"], {"a": "one", "c": "three"})]
    assert mixed(spark, [("['x', 'B) y']", None), ("p, q", None)], "string") == [(["a", "b"], {"a": "x", "b": "y"}), (["a", "b"], {"a": "p", "b": "q"})]
    rows = [([{"Label": "c", "text": "t"}, {"value": "v"}, {"TEXT": None, "value": "no", "id": "9"}], None)]
    assert mixed(spark, rows, "array<map<string,string>>") == [(["c", "b", "i"], {"c": "t", "b": "v", "i": "Option C"})]
    rows = [([("d", "t"), (None, "u")], None)]
    assert mixed(spark, rows, "array<struct<key:string,Content:string>>") == [(["d", "b"], {"d": "t", "b": "u"})]
    assert mixed(spark, [({"A": ("x",)}, None)], "map<string,struct<choice:string>>") == [(["a"], {"a": "x"})]


def test_parts_and_prompts(spark):
    rows = [("English", "zh_1"), (" ENGLISH ", ""), ("chinese", "en_1"), (None, "zh_1"), ("", "en_1"), (None, None)]
    assert values(spark, rows, "s string, i string", N.english_only(F.col("s"), F.col("i"))) == [True, True, False, False, True, True]
    got = values(spark, [("Why?", {"a": "x"})], "q string, m map<string,string>", N.answer_prompt(F.col("q"), F.array(F.lit("a"), F.lit("b")), F.col("m")))
    assert got[0].endswith("Question:\nWhy?\n\nOptions:\nA. x\nB. \n\nAnswer:")
    assert values(spark, [("t", None), (None, "x"), (None, None)], "a string, b string", N.title_and_text(F.col("a"), F.col("b"))) == ["t", "x", ""]


def test_parse_list(spark):
    rows = [(None,), ("",), ('["x","y"]',), ("['x','y']",), ("x, y,",), ("2",)]
    assert values(spark, rows, "s string", N.parse_list(F.col("s"))) == [[], [], ["x", "y"], ["x", "y"], ["x", "y"], ["2"]]


def test_choices_and_answers(spark):
    assert values(spark, [(["A", "(b) cash", "12", "Net"],)], "c array<string>", N.parse_choices(F.col("c"))) == [["a", "b", "n"]]
    rows = [("A",), ("['A','C']",), ("Option A",), (None,)]
    assert values(spark, rows, "s string", N.answer_letters(F.col("s"))) == [["a"], ["a", "c"], ["o", "p", "t", "i", "n", "a"], []]


def test_gold_indices(spark):
    rows = [("[0, 2]",), ("2",), ("1,1",), ("x",), (None,)]
    assert values(spark, rows, "s string", N.gold_indices(F.col("s"))) == [[0, 2], [2], [1], [], []]
    rows = [("(1, 2,)",), ("-1, +3, x4, 2.5",), ("option 2",), ("9" * 12,)]
    assert values(spark, rows, "s string", N.gold_indices(F.col("s"))) == [[1, 2], [-1, 3], [], [int("9" * 12)]]


def test_option_map(spark):
    text = "stem\nA. one\n more\nB) two\n\nx"
    rows = [(text,), (None,), ("A. \nB. y\nb: z",)]
    assert values(spark, rows, "s string", N.parse_option_map(F.col("s"))) == [{"a": "one more", "b": "two x"}, {}, {"b": "z"}]


def test_indices_to_labels(spark):
    rows = [([1, 4],), ([1],), ([0, 4],), ([],)]
    got = values(spark, rows, "i array<int>", N.indices_to_labels(F.col("i"), F.array(*[F.lit(x) for x in "abcd"])))
    assert got == [["a", "d"], ["b"], ["a", "d"], []]


def test_gold(spark):
    labels = F.array(*[F.lit(x) for x in "abcd"])
    options = F.create_map(F.lit("a"), F.lit("Cash"), F.lit("b"), F.lit("9 units"), F.lit("c"), F.lit("Cash"))
    rows = [(None, "B"), (None, "debt"), (None, "9 units"), ("[0]", "['c', 'zzz']"), (None, "[1, 'D']"), ("2", None), (None, None), ("x", "nothing!")]
    got = values(spark, rows, "g string, s string", N.gold_generic(F.col("g"), F.col("s"), labels, options))
    # letters anywhere in the answer count, an option's text only where nothing else does
    assert got == [["b"], ["d", "b"], ["b"], ["a", "c"], ["b", "d"], ["c"], [], []]
    assert values(spark, [("c",)], "s string", N.gold_by_index(F.array(F.lit(9)), N.answer_letters(F.col("s")), labels)) == [["c"]]


def test_question_type(spark):
    rows = [("MCQ",), ("Multiple Choice",), ("Rearrange",), ("",), (None,)]
    assert values(spark, rows, "s string", N.matches_question_type(F.col("s"), "MCQ")) == [True, True, False, False, False]


def test_answer_string(spark):
    rows = [([],), (["B"],), (["a", "c", "a"],)]
    assert values(spark, rows, "l array<string>", N.labels_to_answer(F.col("l"))) == ["", "b", '["a", "c"]']


def test_text(spark):
    assert values(spark, [("One.  Two? Three!",)], "s string", N.first_sentences(F.col("s"))) == ["One. Two?"]
    assert values(spark, [("The answer is B.",)], "s string", N.predicted_letter(F.col("s"), F.array(F.lit("a"), F.lit("b")))) == [["b"]]
    assert values(spark, [("\t a \n",), ("  ",), (None,)], "s string", N.clean_text(F.col("s"))) == ["a", "Unknown", "Unknown"]
    assert values(spark, [(0,), (25,), (26,)], "i int", N.label_from_index(F.col("i"))) == ["a", "z", "option_27"]


def test_ratings(spark):
    assert values(spark, [(2.5,), (3.5,), (10.7,), (-1.0,), (None,)], "x double", N.round_rating(F.col("x"))) == [2, 4, 10, 0, None]
    assert values(spark, [(None,), (4.0,), (5.0,), (100.0,), (101.0,)], "x double", N.in_range(F.col("x"), 5, 100)) == [False, False, True, True, False]
    assert values(spark, [(30.0,), (5.0,), (100.0,)], "x double", N.binned(F.col("x"), 10)) == [30, 0, 100]


def test_maps(spark):
    got = values(spark, [("x", None, " ")], "a string, b string, c string", N.option_columns({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}))
    assert got == [{"a": "x"}]
    labels = F.array(F.lit("a"), F.lit("b"))
    assert values(spark, [({"a": " one "},)], "m map<string,string>", N.options_by_label(labels, F.col("m"))) == [{"a": "one", "b": "Option B"}]
    assert values(spark, [([1, 2, 3],)], "i array<int>", N.masked_labels(F.col("i"), F.lit(2))) == [[-100, -100, 3]]


def test_columns():
    assert N.resolve_column(["Id", "Correct Answer"], "correct_answer") == "Correct Answer"
    assert N.resolve_column(["ID"], "x", "id") == "ID"
    assert N.resolve_column([], "x") is None


def test_title_and_body(spark):
    t, b = N.title_and_body(F.col("s"), F.lit("stem"))
    rows = spark.createDataFrame([("\n Head \nbody\n",), ("",)], "s string").select(t, b).collect()
    assert [tuple(r) for r in rows] == [("Head", "Head \nbody"), ("stem", "")]
