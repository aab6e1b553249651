"""Text decoded with the wrong character encoding: found and restored through a table of garbled words.

The corpus says itself what its clean words are: tokens of Cyrillic letters in lower or title
case, with the quotation marks and dashes that stick to them. Every distinct clean word is
garbled under every chain of a wrong decoding - each encoding of Cyrillic text read as each
other one, with undefined bytes kept, replaced or dropped, and twice where that is common.
Words in capitals are garbled too where their small letters are a clean word. The table of
garbled forms, with every chain that gives a form, is joined to the distinct tokens of the
corpus that are neither clean nor plain; a form that looks like a clean word is no evidence. A
field is reported when the tokens it matched under one chain are long enough together. Its
tokens are substituted by their originals where the form has exactly one under that chain,
and words that the corpus has nowhere else are decoded back by the chain so found if they
come out clean and garble to the same form again.

Tokens lie between ASCII characters other than letters, since all these encodings keep ASCII
as it is; garbled letters may look like spaces or controls and must not cut a token.

Every field is cut into tokens once: distinct clean words and the suspects of each field leave
one map-side aggregation and are written. Both sides of the joins follow the data, so they are
merge joins, which spill and which adaptive execution splits at hot tokens; nothing is
broadcast. A form with many originals is added up in each task of the table first. Null and
empty fields hold nothing. Forms with several originals (all letters replaced by U+FFFD)
are found and left as they are.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import durable

#: Letters that the matched tokens of a field must have together, under one chain.
EVIDENCE = 5

#: Encodings of Cyrillic text, and encodings it is taken for.
WRITTEN = ("utf-8", "cp1251", "koi8-r", "koi8-u", "cp866", "iso8859-5", "mac-cyrillic")
READ = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "mac-roman", "cp437")
#: Encodings that UTF-8 text is often taken for twice.
TWICE = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866")

#: Not a token: ASCII that is no letter.
CUT = r"[\x00-@\[-`{-\x7f]+"
#: Letters of the corpus's own Cyrillic languages; those of others are what wrong decodings leave behind.
LETTERS = "а-яёіїєґ"
CAPITALS = "А-ЯЁІЇЄҐ"
SIGNS = "«»„“”‘’…—–№"
CLEAN = f"^[{SIGNS}]*(?:[{CAPITALS}]?[{LETTERS}]+|[{CAPITALS}])[{SIGNS}]*$"
#: A word in capitals, which may as well be a garbled word.
CAPITAL = f"^[{SIGNS}]*[{CAPITALS}]{{2,}}[{SIGNS}]*$"
#: What no token of interest is without.
FOREIGN = r"[^\x00-\x7f]"


def _keep_undefined(error: UnicodeError):
    raw = error.object[error.start : error.end]
    return raw.decode("latin-1"), error.end


def _back(error: UnicodeError):
    """Bytes that a decoding kept as controls; any other character was not read in this encoding."""
    part = error.object[error.start : error.end]
    if any(not 0x80 <= ord(c) < 0xA0 for c in part):
        raise error
    return part.encode("latin-1"), error.end


codecs.register_error("millrace-keep", _keep_undefined)
codecs.register_error("millrace-back", _back)


def chains() -> list[tuple[str, str, str, int]]:
    """(written, read, treatment of undefined bytes, times) of every wrong decoding."""
    out = [(w, r, "millrace-keep", 1) for w in WRITTEN for r in READ if w != r and {w, r} != {"koi8-r", "koi8-u"}]
    out += [(w, r, e, 1) for w in ("utf-8",) for r in ("cp1252", "cp1251") for e in ("replace", "ignore")]
    out += [(w, "utf-8", "replace", 1) for w in WRITTEN if w != "utf-8"]
    out += [("utf-8", r, e, 2) for r in TWICE for e in ("millrace-keep", "replace")]
    return out


CHAINS = chains()


def garbled(word: str) -> dict[str, list[int]]:
    """Every garbled form of a word and the chains that give it."""
    forms: dict[str, list[int]] = {}
    raw: dict[str, bytes | None] = {}
    for w in WRITTEN:
        try:
            raw[w] = word.encode(w)
        except UnicodeError:
            raw[w] = None
    for k, (written, read, undefined, times) in enumerate(CHAINS):
        if (b := raw[written]) is None:
            continue
        try:
            s = b.decode(read, undefined)
            if times == 2:
                s = s.encode(written).decode(read, undefined)
        except UnicodeError:
            continue
        if s and s != word:
            if s in forms:
                forms[s].append(k)
            else:
                forms[s] = [k]
    return forms


TABLE = pa.schema([("form", pa.string()), ("word", pa.string()), ("n_words", pa.int64()), ("chains", pa.list_(pa.int32()))])


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``form, word, n_words, chains``: the first original and the number of originals in a batch, for the chains in which they are the same."""
    clean = re.compile(CLEAN)
    for b in batches:
        originals: dict[str, list[tuple[str, list[int]]]] = {}
        for word in b.column(0).to_pylist():
            for form, ks in garbled(word).items():
                if form in originals:
                    originals[form].append((word, ks))
                elif not clean.match(form):
                    originals[form] = [(word, ks)]
        rows: list[tuple[str, str, int, list[int]]] = []
        for form, known in originals.items():
            if len(known) == 1:
                rows.append((form, known[0][0], 1, known[0][1]))
                continue
            words: dict[int, list[str]] = {}
            for word, ks in known:
                for k in ks:
                    words.setdefault(k, []).append(word)
            alike: dict[tuple[str, int], list[int]] = {}
            for k, ws in words.items():
                alike.setdefault((min(ws), len(ws)), []).append(k)
            rows += [(form, word, n, ks) for (word, n), ks in alike.items()]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, TABLE, strict=True)], schema=TABLE)


def tokens_of(text: Column) -> Column:
    """Distinct tokens of a text with a character beyond ASCII."""
    return F.filter(F.array_distinct(F.split(text, CUT)), lambda t: t.rlike(FOREIGN))


def corpus_tokens(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``doc_id, field_name, token, clean``, distinct: the tokens of each field, clean ones once for the corpus and without their field."""
    parts = F.array(*[F.struct(F.lit(f).alias("field_name"), tokens_of(F.col(f).cast("string")).alias("tokens")) for f in fields])
    rows = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(parts).alias("p"))
        .select("doc_id", "p.field_name", F.explode("p.tokens").alias("token"))
        .withColumn("clean", F.col("token").rlike(CLEAN))
    )
    return rows.select(*[F.when(~F.col("clean"), F.col(c)).alias(c) for c in ("doc_id", "field_name")], "token", "clean").distinct()


def clean_words(tokens: DataFrame) -> DataFrame:
    """``word``: the distinct clean words, and those in capitals whose small letters are a clean word."""
    clean = tokens.where("clean").select(F.col("token").alias("word"))
    capital = tokens.where(~F.col("clean") & F.col("token").rlike(CAPITAL)).select(F.col("token").alias("word")).distinct()
    small = capital.withColumn("_small", F.lower("word")).join(clean.select(F.col("word").alias("_small")).hint("merge"), "_small", "left_semi")
    return clean.unionByName(small.select("word"))


#: Words that one task garbles.
WORDS_A_TASK = 2_500


def garbled_tokens(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``doc_id, field_name, token, chain, word, n_words``: the tokens that are garbled words, with their original."""
    tokens = durable(corpus_tokens(df, id_col, fields))
    # the table is some thirty times its input, so its tasks are cut by the number of words and not by their bytes
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, tokens.where("clean").count() // WORDS_A_TASK + 1)
    table = clean_words(tokens).repartition(tasks, "word").mapInArrow(_table, "form string, word string, n_words long, chains array<int>")
    suspects = tokens.where("not clean").select("doc_id", "field_name", "token")
    distinct = suspects.select("token").distinct()
    known = (
        table.hint("merge").join(distinct.hint("merge"), F.col("form") == F.col("token"))
        .select("token", F.explode("chains").alias("chain"), "word", "n_words")
        .groupBy("token", "chain")
        .agg(F.min("word").alias("word"), F.sum("n_words").alias("n_words"))
    )
    return suspects.hint("merge").join(known.hint("merge"), "token")


def garbled_fields(matches: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """``doc_id, field_name, chain, letters`` of the fields with enough evidence under their best chain."""
    return (
        matches.groupBy("doc_id", "field_name", "chain")
        .agg(F.sum(F.length(F.regexp_replace("word", f"[{SIGNS}]", ""))).alias("letters"), F.count(F.lit(1)).alias("n_tokens"))
        .where(F.col("letters") >= evidence)
        .groupBy("doc_id", "field_name")
        .agg(F.max(F.struct("letters", F.negative("chain").alias("c"))).alias("top"))
        .select("doc_id", "field_name", F.negative("top.c").alias("chain"), F.col("top.letters").alias("letters"))
    )


def ungarbled(token: str, chain: int) -> str | None:
    """The word that a chain garbled to ``token``; None where that is no clean word or not the only way back."""
    written, read, undefined, times = CHAINS[chain]
    try:
        t = token
        for _ in range(times):
            t = t.encode(read, "millrace-back").decode(written)
        back = t
        for _ in range(times):
            back = back.encode(written).decode(read, undefined)
    except UnicodeError:
        return None
    return t if back == token and re.match(CLEAN, t) else None


def _substitute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cut, clean, foreign = re.compile(f"({CUT})"), re.compile(CLEAN), re.compile(FOREIGN)
    for b in batches:
        out = []
        for text, chain, forms, words in zip(b["text"], b["chain"], b["forms"], b["words"], strict=True):
            known = dict(zip(forms, words, strict=True))
            parts = cut.split(text)
            places = [i for i, t in enumerate(parts) if foreign.search(t)]
            hit = [False] * len(places)
            for last in (False, True):  # words that look clean are judged once their neighbours are known
                for n, i in enumerate(places):
                    t = parts[i]
                    if hit[n] or (clean.match(t) and not (last and any(hit[max(0, n - 2) : n]) and (n + 1 == len(places) or any(hit[n + 1 : n + 3])))):
                        continue
                    # a form with one original, a word that the corpus lacks, or one that looks clean among garbled ones
                    word = known[t] if t in known else ungarbled(t, chain)
                    if word is not None:
                        parts[i], hit[n] = word, True
            out.append("".join(parts))
        yield pd.DataFrame({"doc_id": b["doc_id"], "field_name": b["field_name"], "restored": out})


def restore(df: DataFrame, id_col: str, fields: list[str], evidence: int = EVIDENCE) -> DataFrame:
    """``doc_id, field_name, restored``: garbled fields with every token that has one original put right."""
    matches = garbled_tokens(df, id_col, fields)
    found = garbled_fields(matches, evidence).select("doc_id", "field_name", F.col("chain").alias("best"))
    words = (
        matches.hint("merge").join(found.hint("merge"), ["doc_id", "field_name"])
        .groupBy("doc_id", "field_name", "token")
        .agg(F.min("word").alias("low"), F.max("word").alias("high"), F.max("n_words").alias("n"), F.min(F.when(F.expr("chain = best and n_words = 1"), F.col("word"))).alias("own"))
        .select("doc_id", "field_name", "token", F.coalesce("own", F.when(F.expr("low = high and n = 1"), F.col("low"))).alias("word"))
        .where("word is not null")
        .groupBy("doc_id", "field_name")
        .agg(F.collect_list(F.struct("token", "word")).alias("w"))
    )
    parts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.*")
    rows = (
        texts.hint("merge").join(found.hint("merge"), ["doc_id", "field_name"])
        .join(words.hint("merge"), ["doc_id", "field_name"], "left")
        .select("doc_id", "field_name", "text", F.col("best").alias("chain"), F.coalesce(F.col("w.token"), F.array().cast("array<string>")).alias("forms"), F.coalesce(F.col("w.word"), F.array().cast("array<string>")).alias("words"))
    )
    return rows.mapInPandas(_substitute, "doc_id long, field_name string, restored string")
