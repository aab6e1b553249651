"""Operators on records: duplicates, value mapping, name variants, split overlap."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import components, exact_duplicates, name_variants, split_overlap, value_mapping

QUESTION = "row_id long, split_name string, question string, option_texts map<string,string>, head string, _key string, word string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def questions(spark, data):
    return spark.createDataFrame([(i, s, q, o, "h", "k", "w") for i, s, q, o in data], QUESTION)


def members(df):
    return exact_duplicates.duplicate_members(df, exact_duplicates.canonical_key(F.col("question"), F.col("option_texts")))


A = {"a": "1,012.48 units", "b": "-5 units"}


def test_duplicates_formatting(spark):
    d = questions(spark, [
        (5, "train", "What is the loan-to-value, at 15.3%?", A),
        (2, "dev", "  what IS the “loan–to–value” at 15.3% ?\n", {"B": "-5 UNITS", "A": "1012.48 units"}),
        (9, "test", "What is the loan-to-value, at 153%?", A),
        (8, "test", "What is the loan-to-value, at 15.3%?", {"a": "1,012.48 units", "b": "5 units"}),
        (7, "test", "Pay $6 817 153 now", {}), (6, "test", "pay $6,817,153 now.", None), (14, "dev", "pay $6 \n817\u00a0  153 now", None), (4, "test", "in 2007 345", None), (3, "test", "in 2007345", None),
        (11, None, None, None), (12, None, None, None), (13, None, "?", {"a": ""}),
    ])
    got = rows(members(d))
    assert got == [(2, 2), (3, 3), (4, 4), (5, 2), (6, 6), (7, 6), (8, 8), (9, 9), (14, 6)]
    assert rows(exact_duplicates.representatives(members(d))) == [(2, 2), (3, 1), (4, 1), (6, 3), (8, 1), (9, 1)]


def test_duplicates_hot_key(spark):
    """A key on a third of the rows is cut over partitions and still has one head."""
    random.seed(1)
    data = [(i, "train", "hot" if i % 3 == 0 else f"q {i % 400}", None) for i in range(1, 3000)]
    random.shuffle(data)
    d = questions(spark, data).repartition(7)
    expected, first = [], {}
    for i, _, q, _ in sorted(data):
        expected.append((i, first.setdefault(q, i)))
    assert rows(members(d)) == expected


def test_duplicates_empty_and_long(spark):
    assert rows(members(questions(spark, []))) == []
    long = "x" * 200_000
    assert rows(members(questions(spark, [(1, "a", long, None), (2, "a", long.upper() + "!", None), (2, "a", "y", None), (2, "a", "y", None)]))) == [(1, 1), (2, 1), (2, 2), (2, 2)]


REFERENCE = [("US", "United States"), ("GB", "United Kingdom"), ("DE", "Germany"), ("NE", "Niger"), ("NG", "Nigeria"), ("GN", "Guinea"), ("PG", "Papua New Guinea"), ("IR", "Iran"), ("IQ", "Iraq")]


def test_country_values(spark):
    cases = {
        "United States": "US", " united_states ": "US", "Unnietd States": "US", "UnitedStates": "US", "USA (Texas)": "US", "Gantry Point,United States": "US", "Castle Dunmere / Germany": "DE", "america": "US", "АМЕРИКА": "US",
        "England": "GB", "Deutschland": "DE", "Allemagne": "DE", "DEU": "DE", "Gemany": "DE", "Niger": "NE", "Nigera": None, "papua new guinea": "PG", "Zzyvex Islands": "NONE", "Republic of Malvetia": "NONE", "12345": "NONE", "?": "NONE",
        "": None, "  ": None, "x" * 50_000: "NONE", "word " * 5000: "NONE",
    }
    names = value_mapping.country_names(spark, REFERENCE)
    d = spark.createDataFrame([(k, "old") for k in cases] + [(None, "old")], "country string, code string")
    got = {r[0]: r[1] for r in value_mapping.map_values(d, F.col("country"), REFERENCE, "code", names).collect()}
    for k, v in cases.items():
        if k != "Nigera":
            assert got[k] == v, k[:40]
    assert got["Nigera"] in ("NE", "NG") and got[None] is None
    sharded = value_mapping.map_values(d, F.col("country"), REFERENCE, "code", names, shard_entries=40)
    assert {r[0]: r[1] for r in sharded.collect()} == got
    assert value_mapping.map_values(d.limit(0), F.col("country"), [], "code", {}).count() == 0


def test_country_parts(spark):
    """Places come from the locale's time zones, the states of large countries and a gazetteer of one's own."""
    reference = [*REFERENCE, ("IN", "India"), ("CN", "China"), ("MX", "Mexico"), ("BR", "Brazil"), ("JP", "Japan")]
    names = value_mapping.country_names(spark, reference, {"Gantry Point": "JP", "Germany": "BR", "elsewhere": "XX"})
    d = spark.createDataFrame([(x,) for x in ("Maharashtra", "Guangdong, China", "Jalisco", "Bahia", "Kolkata", "Tokyo", "gantry point", "Germany", "elsewhere")], "country string")
    got = [r[1] for r in value_mapping.map_values(d, F.col("country"), reference, "code", names).collect()]
    assert got == ["IN", "CN", "MX", "BR", "IN", "JP", "JP", "DE", "NONE"]
    small = spark.createDataFrame([("US", "United States"), (None, "x"), ("DE", None)], "c string, n string")
    assert value_mapping.reference_list(small, "c", "n") == [("US", "United States")]


def test_bk_tree_is_whole():
    random.seed(7)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(3, 9)))
    entries = {word() for _ in range(300)}
    tree = value_mapping.BKTree((w, w) for w in sorted(entries))
    for _ in range(200):
        s, k = word(), random.randint(0, 2)
        assert {n for _, n, _ in tree.within(s, k)} == {e for e in entries if value_mapping.edit_distance(s, e) <= k}


NAMES = ["Ivan R. Degrudrusvom", "Vanya Degrudrusvom", "DEGRUDRUSVOM, IVAN R", "I. Degrudrusvom", "Ivan Degrudruvsom", "Degrudrusvom Ivan", "Christine Degrudrusvom", "Dr. Christine Degrudrusvöm, PhD", "unknown", " ", None, "N/A"]


def test_person_variants(spark):
    d = spark.createDataFrame([(n, None, "clash", 1) for n in NAMES + NAMES], "author string, publisher string, name string, id int")
    pairs = {(a, b) for _, a, b in rows(name_variants.variant_pairs(name_variants.variant_classes(d, ["author", "publisher"])))}
    ivan, chris = [n for n in NAMES[:6]], NAMES[6:8]
    expected = {tuple(sorted(p)) for g in (ivan, chris) for p in itertools.combinations(g, 2)}
    assert pairs == expected


def test_house_variants(spark):
    names = ["Gristivugran Verlag", "The Gristivugran Verl.", "Verlag Gristivugran GmbH", "Gristivugran, VERLAG (paperbacks)", "Gramabragam & Sons", "and Sons Gramabragam", "Gramabragam + Sons Ltd Ltd.", "Rastalijind University Press", "Rastalijid U.P.", "Rastalijind Books", "unknown", "x" * 3000]
    d = spark.createDataFrame([(None, n) for n in names], "author string, publisher string")
    c = {}
    for _, name, k in rows(name_variants.variant_classes(d, ["author", "publisher"]).select("field_name", "name", "class")):
        c.setdefault(k, set()).add(name)
    assert sorted(map(sorted, c.values())) == sorted(map(sorted, [names[:4], names[4:7], names[7:9]]))


def test_names_empty(spark):
    d = spark.createDataFrame([], "author string, publisher string")
    assert name_variants.variant_pairs(name_variants.variant_classes(d, ["author", "publisher"])).count() == 0


def test_ambiguous_initial(spark):
    names = ["Patricia Saplelunem", "Paulo Saplelunem", "P. Saplelunem"]
    d = spark.createDataFrame([(n,) for n in names], "author string")
    assert name_variants.variant_pairs(name_variants.variant_classes(d, ["author"])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    got = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


BASE = "In January 2014, Grulaven Software issued 6,859,320 ordinary shares at $10.47 apiece. Assume a required rate of return of 43.4% and no other changes during the lease term. What is the most likely consequence for the credit rating?"
OPTIONS = {"a": "Only reported earnings rises", "b": "Both net income and leverage falls", "c": "12.5 units"}


def near(spark, data):
    return rows(split_overlap.overlapping_rows(questions(spark, data)))


def test_overlap(spark):
    filler = [(1000 + i, "train", f"{name} holds {i}00 bonds during the lease term. Assume a required rate of return and no other changes. What is the most likely outcome?", {"a": f"{i}"}) for i, name in enumerate("Abc Bcd Cde Def Efg Fgh Ghi Hij Ijk Jkl".split())]
    data = filler + [
        (1, "train", BASE, OPTIONS),
        (2, "dev", BASE.upper(), dict(zip("cab", OPTIONS.values(), strict=True))),
        (3, "test", "Read carefully. " + BASE.replace("during", "throughout").replace("required", "requird").replace("Assume a", "Assume"), OPTIONS),
        (4, "test", BASE.replace("43.4", "43.5"), OPTIONS),
        (5, "test", BASE.replace("Grulaven", "Bevemo"), OPTIONS),
        (6, "test", BASE.replace("is the most", "is not the most"), OPTIONS),
        (7, "test", BASE, OPTIONS | {"c": "13.5 units"}),
        (8, "dev", BASE, {"a": OPTIONS["a"]}),
        (9, "train", None, None), (10, "dev", None, None), (11, None, BASE, OPTIONS),
    ]
    assert near(spark, data) == [(2, 1), (3, 1)]


def test_overlap_copies_and_empty(spark):
    data = [(i, "train", BASE, OPTIONS) for i in range(1, 40)] + [(i, "dev", BASE + " ", OPTIONS) for i in range(50, 53)]
    assert near(spark, data) == [(e, t) for e in range(50, 53) for t in range(1, 40)]
    assert near(spark, []) == []


@pytest.mark.parametrize("common", [500, 3])
def test_prefix_join_is_whole(spark, common):
    """Against all pairs: every pair that verification accepts is found, whether a word is common or not."""
    random.seed(5)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)] + ["not", "7", "the"]
    questions, rows_ = [], []
    for _ in range(45):
        words = random.choices(vocabulary, weights=[1 / (1 + k) for k in range(len(vocabulary))], k=random.choice([1, 2, 3, 4, 5, 8, 14]))
        for _ in range(3):
            questions.append([w for w in words if random.random() > 0.2] + random.choices(vocabulary[:9], k=random.randint(0, 2)))
    for k, q in enumerate(questions):
        rows_.append((f"{k:04d}", " ".join(q), {"a": random.choice(["yes it is", "yes it was", "no"])}, k % 3 != 0, k % 3 == 0))
    d = spark.createDataFrame(rows_, "class string, question string, options map<string,string>, in_train boolean, in_eval boolean")
    expected = set()
    for x in rows_:
        for y in rows_:
            if x[4] and y[3] and x[1] and y[1]:
                a, b = split_overlap.told(x[1].split()), split_overlap.told(y[1].split())
                oa, ob = ([split_overlap.told(o.split(), True) for o in z[2].values()] for z in (x, y))
                if split_overlap.same_sense(a, b) and split_overlap.same_options(oa, ob):
                    expected.add((x[0], y[0]))
    assert len(expected) > 60
    assert set(rows(split_overlap.near_classes(d, common))) == expected


def test_overlap_at_any_size(spark):
    """A pair is judged alike in a small table and in one a hundred times larger."""
    pair = [(1, "train", "The lender must compute annual yield of bonds before the term ends", OPTIONS), (2, "dev", "The lender must compyte annul return of bonds before the term ends", OPTIONS)]
    other = [(100 + i, ("train", "dev")[i % 2], f"The lender must compute yield return of bonds {i} before the {chr(97 + i % 26)}{chr(97 + i // 26)} term", OPTIONS) for i in range(200)]
    small, large = near(spark, pair), near(spark, pair + other)
    assert small == [(2, 1)] and [p for p in large if p[0] == 2] == small
    assert near(spark, [(1, "train", "compute annual yield of bonds", OPTIONS), (2, "dev", "compyte annul yield of bonds", OPTIONS)]) == [(2, 1)]


def test_names_by_their_capitals():
    assert split_overlap.told("¶ Klidror Hotels buys bonds from Pellam ¶ What is due".split()).names == [True, True, False, False, False, True, False, False, False]
    assert set(split_overlap.told("all small letters here".split()).names) == {None} == set(split_overlap.told("ALL LARGE LETTERS HERE".split()).names)
    a, b = split_overlap.told("A firm in Pellam sells bonds".split()), split_overlap.told("a firm in harrow sells bonds".split())
    assert not split_overlap.same_sense(a, b)
    assert split_overlap.same_sense(split_overlap.told("A Pellam firm discovers gold".split()), split_overlap.told("a pellam firm finds gold".split()))


@pytest.mark.parametrize("text,out", [("A-5, b -5.2%", ["a", "5", "b", "-5.2%"]), ("loan–to–value $1 234.50!", ["loan", "to", "value", "$1234.50"]), ("", []), (None, [])])
def test_words(spark, text, out):
    d = spark.createDataFrame([(text,)], "t string").select(split_overlap.words_of(F.col("t")).alias("w"))
    got = d.first()["w"]
    assert got == out or [w for w in got if not re.fullmatch("–", w)] == out


def test_common_misspelling():
    """In a large table a misspelt given name goes with many families, too, but with far fewer than the name."""
    side = lambda given, partners: {"field": "author", "family": "hipatogral", "given": given, "initials": [], "partners": partners}
    assert name_variants.link_kind(side("samul", 140), side("samuel", 8000)) == 3
    assert name_variants.link_kind(side("marta", 140), side("marka", 300)) == 0


def test_initials_of_near_families(spark):
    """Initials with families that are misspellings of each other: each goes to the person of its own family."""
    one, two = {"Helena Dratrikrul", "Dratrikrul, Helena", "H. Dratrikrul"}, {"Hiroko Dratrokrul", "Dratrokrul, Hiroko", "H. Dratrokrul"}
    got = name_variants.variant_classes(spark.createDataFrame([(x,) for x in sorted(one | two)], "author string"), ["author"]).select("class", "name").collect()
    assert {frozenset(r["name"] for r in got if r["class"] == c) for c in {r["class"] for r in got}} == {frozenset(one), frozenset(two)}
