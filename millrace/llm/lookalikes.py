"""One form for texts that look the same: a longest-match transducer over grapheme clusters.

A table from clusters to their one form is computed before any text is read, from the
Unicode data and a short list of letters of the same shape:

* compatibility forms (full width, ligatures, ...) become their plain characters,
* a letter and its accents become one cluster in canonical order, composed or not,
* every kind of space becomes a space, every kind of hyphen a hyphen,
* invisible characters go,
* letters of one shape in Latin, Cyrillic and Greek become one letter, under any accent.

The rules are checked for conflicts: no two may give one cluster two forms, and the form of a
form is itself. They are compiled into a transducer, a trie over code points whose accepting
states hold the form. It reads a text once and at each place takes the longest cluster that
the trie spells; a base with marks that no rule spells - several accents in any order - takes
the form of its base with the marks in canonical order. Stretches of characters beyond ASCII
that were read before in the task are answered from a bounded memory of the transducer's
output. Letter case, accents, digits, punctuation and other letters stay as they are.

A null text has a null form, an empty text the empty one. Texts are compared by a 128-bit
digest of the form; digests are taken once and written, and only ids and digests are shuffled.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import durable

#: Letters of the same shape, each group written as its first member.
SAME_SHAPE = (
    "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟ PРΡ SЅ TТΤ XХΧ YҮΥ ZΖ QԚ WԜ "
    "aа cсϲ dԁ eе hһ iі jјϳ lӏ oоο pрρ qԛ sѕ wԝ xх yуү vѵν гᴦ пᴨ"
)

#: Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑−﹣－˗⁃"

#: Characters without a shape that have no format category.
SHAPELESS = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍" + "".join(map(chr, range(0xFE00, 0xFE10)))


def _plain(c: str) -> str:
    """The form of one character, accents apart and in canonical order."""
    if c in SHAPELESS or (unicodedata.category(c) == "Cf"):
        return ""
    if c in HYPHENS:
        return "-"
    if c not in "\n\r" and (c == "\t" or unicodedata.category(c) == "Zs"):
        return " "
    return unicodedata.normalize("NFKD", c)


@lru_cache(maxsize=1)
def character_table() -> dict[int, str]:
    """Form of every character whose form differs from it, conflict-checked."""
    shape: dict[str, str] = {}
    for group in SAME_SHAPE.split():
        for c in group[1:]:
            if c in shape:
                raise ValueError(f"{c!r} has two shapes")
            shape[c] = group[0]
    if set(shape) & {g[0] for g in SAME_SHAPE.split()}:
        raise ValueError("a shape is itself mapped")
    table: dict[int, str] = {}
    for k in range(sys.maxunicode + 1):
        if 0xD800 <= k < 0xE000 or 0xAC00 <= k < 0xD7A4:  # syllables are composed by rule
            continue
        c = chr(k)
        form = "".join(shape.get(x, x) for y in _plain(c) for x in (_plain(y) if y != c else y))
        if form != c:
            table[k] = form
    for form in table.values():
        if any(ord(x) in table for x in form):
            raise ValueError(f"{form!r} is not a last form")
    return table


def _is_mark(c: str) -> bool:
    """Whether a character belongs to the cluster of the one before it: marks, and vowels and finals of Korean syllables."""
    return unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF or 0xD7B0 <= ord(c) <= 0xD7FB


def _composed(s: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s))


@lru_cache(maxsize=1)
def cluster_rules() -> dict[str, str]:
    """Form of every cluster that one character or its decompositions spell, where it differs from the cluster; conflict-checked."""
    table = character_table()
    rules: dict[str, str] = {}

    def rule(cluster: str, form: str) -> None:
        if rules.setdefault(cluster, form) != form:
            raise ValueError(f"{cluster!r} has two forms")

    for k in range(sys.maxunicode + 1):
        if 0xD800 <= k < 0xE000 or 0xAC00 <= k < 0xD7A4:
            continue
        c = chr(k)
        if not (unicodedata.decomposition(c) or k in table):
            continue
        form = _composed(c.translate(table))
        spelt = {c}
        if k not in table or not unicodedata.decomposition(c).startswith("<"):
            d = unicodedata.normalize("NFD", c)  # a base with its marks, some of them composed already
            spelt |= {unicodedata.normalize("NFC", d[:i]) + d[i:] for i in range(1, len(d) + 1)} if all(map(_is_mark, d[1:])) else {d}
        for cluster in spelt:
            rule(cluster, form)
    for form in set(rules.values()):
        if _composed(form.translate(table)) != form:
            raise ValueError(f"{form!r} is not a last form")
    return {cluster: form for cluster, form in rules.items() if cluster != form}


#: Stretches whose form a task remembers.
REMEMBERED = 200_000
#: ASCII never changes but for the tab; a letter before a stretch may carry its first mark.
STRETCH = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+|\t")


class Transducer:
    """The rules as a trie; a node is ``[form or None, {code point: node}]``."""

    def __init__(self, rules: dict[str, str], table: dict[int, str]):
        self.root: list = [None, {}]
        self.table, self.memory = table, {}
        for cluster, form in rules.items():
            node = self.root
            for c in cluster:
                node = node[1].setdefault(c, [None, {}])
            node[0] = form

    def read(self, s: str) -> str:
        """One pass over a stretch: the longest cluster at each place."""
        out, at, n = [], 0, len(s)
        while at < n:
            node, end, form = self.root, at + 1, s[at]
            i = at
            while i < n and (node := node[1].get(s[i])) is not None:
                i += 1
                if node[0] is not None:
                    end, form = i, node[0]
            far = end
            while far < n and (_is_mark(s[far]) or self.table.get(ord(s[far])) == ""):
                far += 1
            if far > end or ("\u1100" <= s[at] <= "\u115f"):  # marks beyond the rule, or a syllable in letters
                while far < n and "\u1100" <= s[at] <= "\u115f" and "\u1160" <= s[far] <= "\u11ff":
                    far += 1
                end, form = far, _composed(s[at:far].translate(self.table))
            out.append(form)
            at = end
        return "".join(out)

    def _stretch(self, m: re.Match) -> str:
        s = m.group()
        form = self.memory.get(s)
        if form is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            form = self.memory[s] = self.read(s)
        return form

    def __call__(self, text: str) -> str:
        return text if text.isascii() and "\t" not in text else STRETCH.sub(self._stretch, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(cluster_rules(), character_table())


def one_form(text: str) -> str:
    """The form of a text."""
    return transducer()(text)


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = transducer()
    kind = pa.binary()
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([_digest(read(t)) for t in texts], kind), pa.array([_digest(t) for t in texts], kind)], names=["doc_id", "form", "spelling"]
        )


def _forms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    read = transducer()
    for s in texts:
        yield s.map(read, na_action="ignore")


def normalise_texts(df: DataFrame, text_col: str = "text", out: str = "form") -> DataFrame:
    """``df`` with the one form of every text."""
    return df.withColumn(out, F.pandas_udf(_forms, "string", F.PandasUDFType.SCALAR_ITER)(F.col(text_col)))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, form, spelling``: digests of the one form and of the text as it is."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_digests, "doc_id long, form binary, spelling binary")


def varied_members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, form, spelling`` of the rows whose form has several spellings.

    Forms with one spelling leave after a map-side aggregation. All sides follow the data, so
    the joins are merge joins, which adaptive execution splits at a form that many rows have.
    """
    d = durable(digests(df, id_col, text_col))
    varied = d.groupBy("form").agg(F.min("spelling").alias("_a"), F.max("spelling").alias("_b")).where("_a <> _b").select("form")
    return d.hint("merge").join(varied.hint("merge"), "form", "left_semi")


def same_looking_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class, form, n_links``: rows that have a look-alike, the smallest id and the digest of their form, and the rows of other spelling."""
    m = varied_members(df, id_col, text_col)
    spellings = m.groupBy("form", "spelling").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"))
    forms = spellings.groupBy("form").agg(F.sum("_n").alias("_all"), F.min("_first").alias("class"))
    known = spellings.select("form", "spelling", "_n").hint("merge").join(forms.hint("merge"), "form").select("form", "spelling", "class", (F.col("_all") - F.col("_n")).alias("n_links"))
    return m.hint("merge").join(known.hint("merge"), ["form", "spelling"]).select("doc_id", "class", F.lower(F.hex("form")).alias("form"), "n_links")


def same_looking_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_a, doc_b``: pairs of rows with one form and different texts, smaller id first.

    A form's spellings are joined spelling by spelling, and exact copies come back through
    their spelling, so a large group of equal texts is never paired with itself.
    """
    members = varied_members(df, id_col, text_col)
    spellings = members.select("form", "spelling").distinct()
    pairs = (
        spellings.alias("x").hint("merge")
        .join(spellings.alias("y").hint("merge"), (F.col("x.form") == F.col("y.form")) & (F.col("x.spelling") < F.col("y.spelling")))
        .select(F.col("x.spelling").alias("sa"), F.col("y.spelling").alias("sb"))
    )
    m = members.select("doc_id", "spelling")
    joined = (
        pairs.hint("merge").join(m.select(F.col("spelling").alias("sa"), F.col("doc_id").alias("da")).hint("merge"), "sa")
        .hint("merge").join(m.select(F.col("spelling").alias("sb"), F.col("doc_id").alias("db")).hint("merge"), "sb")
    )
    return joined.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b")).where("doc_a <> doc_b").distinct()
