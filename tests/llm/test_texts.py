"""Operators on texts: languages, garbling, tokens, leakage, look-alikes."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import languages, leakage, lookalikes, mojibake, tokenizer

DOC = "doc_id long, text string, language string, body_ru string, title_ru string, form string, token string"


def docs(spark, data):
    return spark.createDataFrame([(i, t, lab, t, None, "f", "t") for i, t, lab in data], DOC)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# tokens


def test_tokens_against_library(spark, data):
    import tiktoken

    ranks = tokenizer.read_ranks(tokenizer.VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    texts = ["", "a" * 20_000, "ab" * 3000, " " * 999, "\n" * 500, "<|endoftext|>", "naïve café", "🙂👩‍👩‍👧 x", "русский текст, да!", "\u0000­", "0" * 5000]
    texts += ["".join(random.choice("aeinrst lo.,'’\nйцук") for _ in range(random.randint(1, 80))) for _ in range(300)]
    d = docs(spark, [(i, t, None) for i, t in enumerate([*texts, None])])
    got = {r["doc_id"]: list(r["ids"]) for r in tokenizer.encode_corpus(d).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate([*texts, None])}
    assert tokenizer.encode_corpus(d.limit(0)).count() == 0
    real = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r[0]: r[1] or "" for r in real.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in tokenizer.encode_corpus(real).collect()} == {k: reference.encode_ordinary(v) for k, v in texts.items()}


# look-alikes


def test_one_form():
    same = [
        ("the café ﬁle", "ｔｈｅ café file"), ("й и ё", "й и ё"), ("a b c", "a b c"), ("a​b­﻿", "ab"), ("well-being", "well‑being"), ("сор ёл", "cop ëл"), ("Ⅷ", "VIII"), ("", ""),
    ]
    for a, b in same:
        assert lookalikes.one_form(a) == lookalikes.one_form(b), (a, b)
    for a, b in [("e", "é"), ("a", "A"), ("1", "2"), (",", ";"), ("е", "ё"), ("и", "й"), ("a b", "ab"), ("a\nb", "a b")]:
        assert lookalikes.one_form(a) != lookalikes.one_form(b), (a, b)


def test_transducer_against_whole_text():
    """The clusters' forms one after another are the form of the whole text, mapped and composed."""
    table = lookalikes.character_table()
    pool = list("aeoiuAEеоаЕйё\u0456\u0439 -\t\n1") + [chr(k) for k in (0xE9, 0x1D8, 0x1EC7, 0x301, 0x308, 0x327, 0x323, 0x345, 0x200B, 0xAD, 0xFE0F, 0x1100, 0x1161, 0x11A8, 0xAC01, 0xFB01, 0xFF21, 0x9C7, 0x9BE, 0x1F600)]
    random.seed(7)
    for _ in range(20_000):
        s = "".join(random.choices(pool, k=random.randint(0, 9)))
        assert lookalikes.one_form(s) == unicodedata.normalize("NFC", unicodedata.normalize("NFD", s.translate(table))), [hex(ord(c)) for c in s]
    with pytest.raises(ValueError):
        lookalikes.cluster_rules.cache_clear()
        old = lookalikes.character_table
        try:
            lookalikes.character_table = lambda: {**table, ord("\u00e9"): "f", ord("f"): "g"}
            lookalikes.cluster_rules()
        finally:
            lookalikes.character_table = old


def test_same_looking_classes(spark):
    d = docs(spark, [(1, "cop", None), (2, "\u0441\u043e\u0440", None), (3, "cop", None), (4, "other", None), (5, "other", None), (6, None, None), (7, "", None)])
    assert rows(lookalikes.same_looking_classes(d).select("doc_id", "class", "n_links")) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    assert rows(lookalikes.same_looking_pairs(d)) == [(1, 2), (2, 3)]
    assert lookalikes.same_looking_classes(docs(spark, [])).count() == 0


def test_form_is_stable():
    table = lookalikes.character_table()
    assert not any(ord(c) in table for form in table.values() for c in form)
    for k in [*range(0x20, 0x600), *range(0xFF01, 0xFF60), 0xAC00]:
        once = lookalikes.one_form(chr(k))
        assert lookalikes.one_form(once) == once
        assert lookalikes.one_form(unicodedata.normalize("NFD", chr(k))) == once


def test_same_looking(spark):
    base = "Сорок тысяч cafés"
    other = unicodedata.normalize("NFD", base)
    third = base.replace("о", "o")
    data = [(1, base, None), (2, other, None), (3, base, None), (4, third, None), (5, base + ".", None), (6, None, None), (7, "", None), (8, "", None)]
    assert rows(lookalikes.same_looking_pairs(docs(spark, data))) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert rows(lookalikes.same_looking_pairs(docs(spark, []))) == []
    hot = [(i, base, None) for i in range(500)] + [(1000, other, None)]
    assert rows(lookalikes.same_looking_pairs(docs(spark, hot))) == [(i, 1000) for i in range(500)]
    forms = {r["doc_id"]: r["form"] for r in lookalikes.normalise_texts(docs(spark, data)).collect()}
    assert forms[1] == forms[2] == forms[4] and forms[6] is None and forms[7] == ""


# garbling

SENTENCE = "Городской совет обсуждает новый бюджет, сообщают два чиновника"


@pytest.mark.parametrize("written,read,times", [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1251", 1), ("utf-8", "koi8-r", 1), ("cp1251", "cp1252", 1), ("cp1251", "koi8-r", 1), ("koi8-r", "cp1251", 1), ("cp866", "cp1251", 1), ("cp1251", "cp866", 1), ("utf-8", "cp1252", 2), ("utf-8", "cp1251", 2)])
def test_garbled_and_restored(spark, written, read, times):
    bad = SENTENCE
    for _ in range(times):
        bad = bad.encode(written).decode(read, "millrace-keep")
    part = SENTENCE + ". " + bad
    d = docs(spark, [(1, SENTENCE + " и мэр", None), (2, bad, None), (3, part, None), (4, None, None), (5, "", None), (6, "Le café à Paris « déjà » │ 12 │", None), (7, "СССР и США", None), (8, bad, None)])
    fields = ["body_ru", "title_ru"]
    assert rows(mojibake.garbled_fields(mojibake.garbled_tokens(d, "doc_id", fields)).select("doc_id", "field_name")) == [(2, "body_ru"), (3, "body_ru"), (8, "body_ru")]
    restored = {r["doc_id"]: r["restored"] for r in mojibake.restore(d, "doc_id", fields).collect()}
    assert restored == {2: SENTENCE, 3: SENTENCE + ". " + SENTENCE, 8: SENTENCE}


def test_unrestorable(spark):
    lost = SENTENCE.encode("cp1251").decode("utf-8", "replace")
    d = docs(spark, [(1, SENTENCE, None), (2, lost, None)])
    fields = ["body_ru", "title_ru"]
    assert rows(mojibake.garbled_fields(mojibake.garbled_tokens(d, "doc_id", fields)).select("doc_id")) == [(2,)]
    assert mojibake.garbled_tokens(docs(spark, []), "doc_id", fields).count() == 0
    assert mojibake.restore(docs(spark, []), "doc_id", fields).count() == 0


def test_garbled_capitals_and_shared_forms(spark):
    """Words in capitals are found where their small letters are a clean word; a form keeps every chain that gives it."""
    clean = "новости города опубликованы сегодня утром редакцией газеты"
    d = docs(spark, [(1, clean, None), (2, "НОВОСТИ ГОРОДА".encode("utf-8").decode("latin-1"), None), (3, "НОВОСТИ ГОРОДА", None)])
    assert rows(mojibake.garbled_fields(mojibake.garbled_tokens(d, "doc_id", ["body_ru"])).select("doc_id")) == [(2,)]
    forms = mojibake.garbled("новости")
    chains = mojibake.chains()
    assert len(forms) < sum(map(len, forms.values()))
    for form, ks in forms.items():
        for k in ks:
            written, read, undefined, times = chains[k]
            s = "новости"
            for _ in range(times):
                s = s.encode(written).decode(read, undefined)
            assert s == form


# leakage

ITEM = "By 2021, because timber had become scarce, Delidund had exchanged copper coins for painted tiles. Later copies name Togund of Pellam, yet 709 tanners remembered Valot. Pluskihis counted 22,377 woollen coats and hid 758 more under a toll gate.\nA. 12.5 units\nB. 13.5 units"


def found(spark, texts, items, shard=leakage.SHARD_ITEMS):
    d = docs(spark, list(zip(range(len(texts)), texts, [None] * len(texts), strict=True)))
    return rows(leakage.leaked_items(d, spark.createDataFrame(items, "item_id long, item_text string"), shard_items=shard).select("doc_id", "item_id"))


def test_leakage(spark):
    wrapped = ITEM.replace("exchanged", "exch-\nanged").replace(" and ", "\n and ").upper()
    replaced = ITEM.replace("scarce", "rare").replace("yet", "[...]")
    half = ITEM[: len(ITEM) * 2 // 3]
    quote = " ".join(ITEM.split()[:12])
    others = ITEM.replace("Togund", "Xx").replace("709", "1").replace("Valot", "Yy").replace("copper", "Zz").replace("Delidund", "Qq").replace("22,377", "9").replace("toll", "Vv").replace("woollen", "Uu")
    shuffled = " ".join(reversed(ITEM.split()))
    bare = ITEM.replace(",", "").replace("\nA.", " ").replace("\nB.", " ")
    texts = ["x. " + ITEM + " y", wrapped, replaced, half, quote, others, shuffled, bare, None, "", "word " * 50_000, ITEM + ITEM]
    assert found(spark, texts, [(7, ITEM)]) == [(i, 7) for i in (0, 1, 2, 3, 7, 11)]
    assert found(spark, texts, [(7, ITEM), (8, "other words " * 9)], 1) == [(i, 7) for i in (0, 1, 2, 3, 7, 11)]
    assert found(spark, texts, []) == [] and found(spark, [], [(7, ITEM)]) == []
    assert found(spark, [ITEM], [(1, None), (2, ""), (3, ITEM), (4, ITEM)]) == [(0, 3), (0, 4)]


def test_index_against_scan():
    random.seed(11)
    stretches = [np.array([random.randint(1, 5) for _ in range(random.randint(1, 40))]) for _ in range(60)] + [np.array([2] * 30)] * 3
    fm = leakage.FMIndex(stretches, 5)
    for n in range(1, 6):
        codes = np.full((50, leakage.RUN), -1, dtype=np.int64)
        for r in codes:
            r[leakage.RUN - n :] = [random.randint(1, 5) for _ in range(n)]
        lo, hi = fm.search(codes)
        for k, r in enumerate(codes):
            word = r[leakage.RUN - n :].tolist()
            expected = sorted((i, j) for i, s in enumerate(stretches) for j in range(len(s) - n + 1) if s[j : j + n].tolist() == word)
            places = fm.locate(np.arange(lo[k], hi[k])) if hi[k] > lo[k] else np.array([], dtype=np.int64)
            which = np.searchsorted(fm.starts, places, side="right") - 1
            assert sorted(zip(which.tolist(), (places - fm.starts[which]).tolist(), strict=True)) == expected


def test_chain_against_brute_force():
    random.seed(5)
    for _ in range(300):
        before = {i: i for i in range(30)}
        matches = [(i + k, p + k) for i, p in ((random.randint(0, 20), random.randint(0, 60)) for _ in range(6)) for k in range(random.randint(1, 6))]
        words, spans = leakage.chain(matches, before)
        runs, open_ = [], {}
        for i, p in sorted(set(matches)):
            r = open_.get(p - i)
            if r and i == r[1] + 1:
                r[1] = i
            else:
                r = open_[p - i] = [i, i, p]
                runs.append(r)
        top = {}

        def best(k):
            if k not in top:
                a, b, p = runs[k]
                top[k] = max([b + leakage.RUN - a, *(best(m) + b + leakage.RUN - max(a, runs[m][1] + leakage.RUN) for m in range(len(runs)) if runs[m][1] < b and (runs[m][2], runs[m][0], runs[m][1]) < (p, a, b))])
            return top[k]

        assert words == max(map(best, range(len(runs))))
    before = {i: i for i in range(300)}
    words, spans = leakage.chain([(i, 500 * n + i) for n in range(300) for i in range(100)], before)
    assert words == 107 and len(spans) == 1


def test_blocks_do_not_matter(spark, monkeypatch):
    texts = ["x " + ITEM, "nothing here", ITEM.lower(), ITEM[:300]]
    whole = found(spark, texts, [(1, ITEM)])
    ph = leakage.phrases_of([(1, ITEM)])
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 30)

    class Shared:
        value = ph

    import pandas as pd

    got = pd.concat(list(leakage._search(iter([pd.DataFrame({"doc_id": range(4), "text": texts})]), Shared)))
    assert sorted(zip(got.doc_id, got.item_id, strict=True)) == whole


# languages


def test_automaton_counts_pieces():
    random.seed(2)
    text = np.array([random.randint(1, 3) for _ in range(200)], dtype=np.uint8)
    table = languages.suffix_automaton(text, 4)
    hay = "".join(map(str, text.tolist()))

    def walk(word):
        state = 0
        for c in word:
            state = table[state * 4 + int(c)]
            if state < 0:
                return False
        return True

    for _ in range(500):
        w = "".join(random.choice("123") for _ in range(random.randint(1, 9)))
        assert walk(w) == (w in hay)


def test_labels():
    assert [languages.label_language(x) for x in ("EN ", "en-GB", "русский", "Bulgarian", "und", "??", "", None, "-", "Spanish")] == ["en", "en", "ru", "bg", None, None, None, None, None, "es"]


def test_languages_on_held_out(spark, data):
    """Trained on the small tables, nearly every label of the labelled documents is confirmed."""
    folder = data.replace("sf0.001", "sf0.01")
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "language")
    got = languages.label_languages(d, "documents").withColumnRenamed("language", "told").join(d, "doc_id").where("text <> '' and language in ('EN','RU','BG','UK','DE','FR')").toPandas()
    agree = (got["told"] == got["language"].str.lower()).mean()
    assert len(got) > 800 and agree > 0.9


def test_language_cases(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    base = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "language")
    texts = {x: base.where((F.col("language") == x) & (F.length("text") > 600)).orderBy("doc_id").limit(3).toPandas()["text"].tolist() for x in ("EN", "RU")}
    en, ru = texts["EN"][1], texts["RU"][1]
    quote = en[:300].rsplit(".", 1)[0] + ". The sign read «Закрыто на ремонт» all week. " + en[300:]
    garbled = ru.encode("utf-8").decode("cp1252", "millrace-keep")
    extra = docs(spark, [(-1, en, "RU"), (-2, en, "english"), (-3, ru, None), (-4, en + "\n" + ru, "EN"), (-5, None, None), (-6, "", "EN"), (-7, quote, "EN"), (-8, garbled, "EN"), (-9, garbled, "ru-RU"), (-10, "12 34 !", "EN"), (-11, en * 300, "EN")])
    both = base.unionByName(extra.select("doc_id", "text", "language"))
    cases = [r for r in rows(languages.label_languages(both, "cases")) if r[0] < 0]
    got = {}
    for d, x in cases:
        got.setdefault(d, set()).add(x)
    mixed = [d for d, x in got.items() if len(x) > 1]
    assert got[-1] == {"en"} and got[-3] == {"ru"} and got[-4] == {"en", "ru"} and got[-8] == {"ru"}
    assert not set(got) & {-2, -5, -6, -7, -9, -10, -11} and mixed == [-4]
    segments = [r for r in rows(languages.label_languages(both, "segments")) if r[0] == -4]
    assert [s[3] for s in segments] == ["en", "ru"] and all(0 <= s[4] <= 1 for s in segments)


def test_unknown_language(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    base = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "language")
    finnish = "Kaupungin asukkaat odottivat eilen illalla junaa, joka ei koskaan saapunut perille. Pormestari lupasi kaikille matkustajille nopeaa ratkaisua tähän hankalaan asiaan."
    polish = "Wczoraj wieczorem mieszkańcy miasta czekali na przyjazd pociągu, który nigdy nie nadjechał. Burmistrz obiecał wszystkim podróżnym szybkie rozwiązanie tej sprawy."
    extra = docs(spark, [(-1, finnish, None), (-2, polish, "PL")]).select("doc_id", "text", "language")
    got = {r[0]: r[1] for r in languages.label_languages(base.unionByName(extra), "documents").where("doc_id < 0").select("doc_id", "language").collect()}
    assert got == {-1: languages.UNKNOWN, -2: languages.UNKNOWN}


def test_languages_empty(spark):
    empty = docs(spark, [])
    for what in ("cases", "segments", "documents"):
        assert languages.label_languages(empty, what).count() == 0
