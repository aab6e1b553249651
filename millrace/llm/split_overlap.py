"""The same or nearly the same records across splits: an exact prefix-filter bipartite join.

Rows are first reduced to classes of equal canonical records, so copies are compared once.
Nearly equal records have the same numbers and negations in the question, as many options,
and the same numbers and negations in those: these make a block, and a class whose block holds
no class of the other side is compared with nothing.

Within a block, the verifier's own bound says how many words two questions must share: of n
words (the longer question's, repeats counted) at most ``allowed(n)`` may change, so at least
n - allowed(n) stay. Words are ordered by how few classes hold them; two records that share so
many have one in common among the rarest ``allowed(n) + 1`` of each, so only that prefix is
indexed. Evaluation classes are indexed by (block, rare word), training classes probe the
index, and pairs are dropped by their lengths and by the position of the shared word. A word
that very many classes of the block hold is indexed in pairs with another such word: records
that must share two words and share no rarer one have two of these in common in a prefix one
word longer. No pair that the verifier would accept is lost; the tests hold this against brute
force.

Candidates are verified word by word. Added and missing words are allowed but for negations
and numbers; replaced words must be misspellings of each other (two edits), or a paraphrase:
ordinary words, neither names nor opposites. A name is told in its own record, by a capital
within a sentence or by a second capital after the sentence's first word; where neither record
tells capitals (all capitals, all small), and for the first words of options, only known
synonyms stand for each other. No count over the table takes part, so a pair is judged alike
in a table of any size. Options must correspond one to one under the same rules.

Null texts count as empty; records without words in the question are compared by their
canonical key alone. A class in both splits gives its pairs without a join. Rows of other
splits take no part.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.exact_duplicates import PARTS, canonical_key, joined_texts, marked_text
from millrace.llm.value_mapping import edit_distance
from millrace.session import durable

#: Largest share of a text's words that may change, in questions and in options, and the words that may in any case.
DIFFERENT, DIFFERENT_OPTION, LEAST_CHANGED = 0.4, 0.5, 2
#: Words added or left out in one place.
ADDED = 6
#: Classes of a block that hold a word from which it is indexed in pairs; of no effect on the result.
COMMON = 500

TRAIN, EVALUATION = ("train",), ("dev", "test")

#: Words that change the sense wherever they are added or missing.
NEGATIONS = frozenset("not no never none neither nor without cannot isnt doesnt dont wont incorrect untrue false least".split())
#: Words of grammar that may come and go.
GRAMMAR = frozenset("the a an of to its it this that what which is are be in by with for and or on at".split())
#: Opposite words, each pair once.
OPPOSITES = frozenset(
    frozenset(p.split())
    for p in (
        "rises falls|rise fall|raise lower|raises lowers|increase decrease|increases decreases|increase decline|grow shrink|grows shrinks|higher lower|"
        "most least|best worst|before after|above below|up down|upwards downwards|correct incorrect|true false|buys sells|bought sold|more less|"
        "maximum minimum|gain loss|asset liability|assets liabilities|debit credit|all none|always never|long short|expand contract"
    ).split("|")
)

#: Everyday words for the same.
SYNONYMS = frozenset(
    frozenset(p)
    for g in (
        "must has have should shall", "likely probable", "correct true right", "what which", "compute calculate determine find work", "only just merely", "nearest closest",
        "begins starts begin start", "ends finishes end finish", "buys purchases acquires buy purchase acquire", "bought purchased acquired", "sells sold", "shows displays", "big large", "small little",
        "about approximately roughly around", "because since as", "if when", "so thus hence therefore", "but however yet", "stays remains stay remain", "gets receives get receive", "needs requires need require",
        "rises increases up", "falls drops declines decreases down", "assume suppose imagine take consider given say", "explains accounts",
    )
    for x in g.split()
    for y in g.split()
    if x < y
    for p in [(x, y)]
)


def _words(marked: Column, breaks: bool = False) -> Column:
    """Words of marked text, the parts of a record apart; with ``breaks``, a pilcrow before the first word of a sentence."""
    t = F.translate(F.regexp_replace(marked, r"['’]", ""), "\u0001\u0002", "-.")
    if breaks:
        t = F.regexp_replace(t, r"[.!?:;\n](?=\s)", " ¶ ")
    kept = r"\p{L}\p{M}\p{N}%$.\u001e\-" + ("¶" if breaks else "")
    t = F.regexp_replace(t, rf"[^{kept}]+|(?<![0-9])\.|\.(?![0-9])|-(?![0-9$.])|(?<=[\p{{L}}\p{{N}}])-", " ")
    return F.transform(F.split(t, PARTS), lambda x: F.filter(F.split(x, " +"), lambda w: w != ""))


def words_of(c: Column) -> Column:
    """Canonical words of a text, in order; signs of numbers stay on their numbers."""
    return F.get(_words(marked_text(F.translate(c, PARTS, " "))), F.lit(0))


def _close(a: str, b: str) -> bool:
    return min(len(a), len(b)) > 2 and abs(len(a) - len(b)) < 3 and edit_distance(a, b) <= (1 if min(len(a), len(b)) < 5 else 2)


class Words(NamedTuple):
    """Words in small letters, and for each whether it is a name; None where the text's capitals tell nothing."""

    words: list[str]
    names: list[bool | None]


def told(cased: Iterable[str], option: bool = False) -> Words:
    """Words and names of a text given as its words with a pilcrow before each sentence.

    Capitals tell nothing where most words within sentences have one, or none in the whole
    text has. The first word of an option is what the option is about and taken as unknown.
    """
    words: list[str] = []
    first: list[bool] = []
    start = True
    for w in cased:
        if w == "¶":
            start = True
        else:
            words.append(w)
            first.append(start)
            start = False
    capital = [w[0].isupper() for w in words]
    letters = [w[0].isalpha() for w in words]
    inside = [c for c, f, x in zip(capital, first, letters, strict=True) if x and not f]
    tells = any(capital) and 2 * sum(inside) <= max(1, len(inside))
    names: list[bool | None] = []
    for i, c in enumerate(capital):
        then = i + 1 < len(words) and not first[i + 1] and capital[i + 1]
        names.append(None if not tells or (option and i == 0) else c and (not first[i] or then))
    return Words([w.lower() for w in words], names)


def _paraphrase(a: list[str], b: list[str], names_a: list[bool | None], names_b: list[bool | None]) -> bool:
    """Whether the words ``a`` may stand for ``b``, or the other way round."""
    x, y = list(zip(a, names_a, strict=True)), list(zip(b, names_b, strict=True))
    for p in list(x):
        twin = next((q for q in y if q[0] == p[0] or _close(p[0], q[0])), None)
        if twin is not None:
            x.remove(p)
            y.remove(twin)
    x, y = [p for p in x if p[0] not in GRAMMAR], [p for p in y if p[0] not in GRAMMAR]
    if any(w in NEGATIONS or any(c.isdigit() for c in w) for w, _ in x + y):
        return False
    if not x or not y:
        return len(x) + len(y) <= ADDED
    if any(frozenset((v, w)) in OPPOSITES for v, _ in x for w, _ in y):
        return False
    for p in list(x):
        twin = next((q for q in y if frozenset((p[0], q[0])) in SYNONYMS), None)
        if twin is not None:
            x.remove(p)
            y.remove(twin)
    if not x or not y:
        return True
    flags = [n for _, n in x + y]
    return not any(flags) and (all(n is False for _, n in x) or all(n is False for _, n in y))


def allowed(n: int, different: float = DIFFERENT) -> int:
    """How many of n words may change; at least one stays."""
    return max(min(LEAST_CHANGED, n - 1), int(different * n), 0)


def same_sense(a: Words, b: Words, different: float = DIFFERENT) -> bool:
    """Whether two texts say the same in nearly the same words."""
    v, w = a.words, b.words
    if v == w:
        return True
    if _fixed(v) != _fixed(w):
        return False
    changed = 0
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, v, w, autojunk=False).get_opcodes():
        if op != "equal":
            changed += max(i2 - i1, j2 - j1)
            if not _paraphrase(v[i1:i2], w[j1:j2], a.names[i1:i2], b.names[j1:j2]):
                return False
    return changed <= allowed(max(len(v), len(w)), different)


def _fixed(words: list[str]) -> list[str]:
    return sorted(w for w in words if w in NEGATIONS or any(c.isdigit() for c in w))


def same_options(a: list[Words], b: list[Words]) -> bool:
    """Whether the options correspond one to one."""
    left, rest = ({tuple(x.words): x for x in v} for v in (a, b))
    for x in set(left) & set(rest):
        del left[x], rest[x]
    if len(left) != len(rest):
        return False
    # most alike first, so that near twins find each other
    pairs = sorted(((difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), x, y) for x in left for y in rest), reverse=True)
    for _, x, y in pairs:
        if x in left and y in rest and same_sense(left[x], rest[y], DIFFERENT_OPTION):
            del left[x], rest[y]
    return not left


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = []
        for x, y in zip(b["record_a"], b["record_b"], strict=True):
            ok.append(same_sense(told(x[0]), told(y[0])) and same_options([told(o, True) for o in x[1:]], [told(o, True) for o in y[1:]]))
        yield b.loc[ok, ["class_a", "class_b"]]


def classes_of(df: DataFrame, question: str, options: str, split: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Members ``(row_id, split, class)`` and one row ``(class, question, options, in_train, in_eval)`` for each class."""
    key = canonical_key(F.col(question), F.col(options))
    rows = df.where(F.col(split).isin(*TRAIN, *EVALUATION)).select(
        F.col(id_col).cast("long").alias("row_id"), F.col(split).alias("split"), F.col(question).cast("string").alias("question"), F.col(options).alias("options"), F.unhex(F.md5(key)).alias("class")
    )
    # written, as the filter and both results would derive every key once more
    keyed = durable(rows).where("class is not null")
    # of equal records, one whose capitals tell names from other words
    text = F.coalesce("question", F.lit(""))
    untold = (F.lower(text) == text) | (F.upper(text) == text) | (F.initcap(text) == text)
    classes = keyed.groupBy("class").agg(
        F.min_by(F.struct("question", "options"), F.struct(untold.alias("u"), F.col("row_id").alias("i"))).alias("r"),
        F.max(F.col("split").isin(*TRAIN)).alias("in_train"),
        F.max(F.col("split").isin(*EVALUATION)).alias("in_eval"),
    )
    return keyed.select("row_id", "split", "class"), classes.select("class", "r.question", "r.options", "in_train", "in_eval")


def _block(parts: Column) -> Column:
    """What nearly equal records have in common: numbers and negations of the question, number of options, numbers and negations of those."""
    negations = F.array(*[F.lit(w) for w in sorted(NEGATIONS)])

    def fixed(words: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(words, lambda w: w.rlike("[0-9]") | F.array_contains(negations, w))), " ")

    options = F.array_distinct(F.slice(parts, 2, F.size(parts)))
    # a digest that two blocks may share by chance: their classes then meet as candidates and are told apart word by word
    return F.xxhash64(fixed(F.get(parts, F.lit(0))), F.size(options), fixed(F.flatten(options)))


def near_classes(classes: DataFrame, common: int = COMMON) -> DataFrame:
    """``class_a, class_b``: evaluation and training classes that are nearly the same."""
    words = _words(marked_text(joined_texts(F.col("question"), F.col("options"))))
    parts = durable(classes.select("class", "question", "options", "in_train", "in_eval", words.alias("parts")).select(
        "class", "question", "options", "in_train", "in_eval", _block(F.col("parts")).alias("block"), F.get("parts", F.lit(0)).alias("words"),
    ))
    # blocks with both sides, and more than one class in both
    blocks = parts.where("size(words) > 0").groupBy("block").agg(F.sum(F.col("in_train").cast("int")).alias("t"), F.sum(F.col("in_eval").cast("int")).alias("e"), F.count(F.lit(1)).alias("n"))
    open_ = blocks.where("t > 0 and e > 0 and n > 1").select("block")
    left = parts.where("size(words) > 0").hint("merge").join(open_.hint("merge"), "block", "left_semi")
    # repeats of a word are words of their own, so that shared words are counted as the verifier counts them
    numbered = F.transform("words", lambda w, i: F.concat_ws("#", w, F.size(F.filter(F.slice(F.col("words"), 1, i + 1), lambda x: x == w)).cast("string")))
    known = durable(left.select("class", "block", "in_train", "in_eval", numbered.alias("words")))
    held = known.select("class", "block", F.explode("words").alias("word"))
    counts = held.groupBy("block", "word").agg(F.count(F.lit(1)).alias("n"))
    ordered = (
        held.hint("merge").join(counts.hint("merge"), ["block", "word"]).groupBy("class", "block")
        .agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ordered"))
    )
    sides = known.select("class", "in_train", "in_eval").hint("merge").join(ordered.hint("merge"), "class")
    size = F.size("ordered")
    change = F.greatest(F.least(F.lit(LEAST_CHANGED), size - 1), F.floor(F.lit(DIFFERENT) * size + 1e-9).cast("int"), F.lit(0))
    # a word alone from the prefix; two words that many classes hold from a prefix longer by one
    prefix, longer = F.slice("ordered", 1, change + 1), F.slice("ordered", 1, change + 2)
    must = size - change
    alone = F.filter(F.transform(prefix, lambda s, i: F.struct(s["word"].alias("key"), i.alias("pos"), s["n"].alias("n"))), lambda s: (s["n"] <= common) | (must < 2))
    often = F.filter(F.transform(longer, lambda s, i: F.struct(s["word"].alias("word"), i.alias("pos"), s["n"].alias("n"))), lambda s: s["n"] > common)
    pairs = F.flatten(F.transform(often, lambda s, i: F.transform(F.slice(often, i + 2, F.size(often)), lambda r: F.struct(F.concat_ws(" ", s["word"], r["word"]).alias("key"), s["pos"].alias("pos"), s["n"].alias("n")))))
    index = sides.select("class", "block", "in_train", "in_eval", size.alias("len"), F.explode(F.concat(alone, pairs)).alias("k")).select("class", "block", "in_train", "in_eval", "len", F.xxhash64("k.key").alias("key"), "k.pos")
    e = index.where("in_eval").select(F.col("class").alias("class_a"), "block", "key", F.col("len").alias("len_a"), F.col("pos").alias("pos_a"))
    t = index.where("in_train").select(F.col("class").alias("class_b"), "block", "key", F.col("len").alias("len_b"), F.col("pos").alias("pos_b"))
    most = F.greatest("len_a", "len_b")
    need = most - F.greatest(F.least(F.lit(LEAST_CHANGED), most - 1), F.floor(F.lit(DIFFERENT) * most + 1e-9).cast("int"), F.lit(0))
    # words shared before the places of this one are met at their own keys, or are none
    reachable = F.least(F.col("len_a") - F.col("pos_a"), F.col("len_b") - F.col("pos_b")) + F.least("pos_a", "pos_b")
    candidates = (
        e.hint("merge").join(t.hint("merge"), ["block", "key"])
        .where((F.col("class_a") != F.col("class_b")) & (F.least("len_a", "len_b") >= need) & (reachable >= need))
        .select("class_a", "class_b")
        .distinct()
    )
    texts, kind = parts.select("class", "question", "options"), parts.schema["class"].dataType.simpleString()
    a, b = (texts.select(F.col("class").alias(f"class_{x}"), F.col("question").alias(f"question_{x}"), F.col("options").alias(f"options_{x}")) for x in "ab")
    found = candidates.hint("merge").join(a.hint("merge"), "class_a").hint("merge").join(b.hint("merge"), "class_b")
    records = [_words(marked_text(joined_texts(F.col(f"question_{x}"), F.col(f"options_{x}")), lower=False), breaks=True).alias(f"record_{x}") for x in "ab"]
    return found.select("class_a", "class_b", *records).mapInPandas(_verify, f"class_a {kind}, class_b {kind}")


def overlapping_rows(df: DataFrame, question: str = "question", options: str = "option_texts", split: str = "split_name", id_col: str = "row_id") -> DataFrame:
    """``eval_id, train_id``: every evaluation row and training row that are the same or nearly so."""
    members, classes = classes_of(df, question, options, split, id_col)
    near = near_classes(classes).unionByName(classes.where("in_train and in_eval").select(F.col("class").alias("class_a"), F.col("class").alias("class_b")))
    e = members.where(F.col("split").isin(*EVALUATION)).select(F.col("class").alias("class_a"), F.col("row_id").alias("eval_id"))
    t = members.where(F.col("split").isin(*TRAIN)).select(F.col("class").alias("class_b"), F.col("row_id").alias("train_id"))
    return near.hint("merge").join(e.hint("merge"), "class_a").hint("merge").join(t.hint("merge"), "class_b").select("eval_id", "train_id")
