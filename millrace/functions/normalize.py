"""Row-level normalisers as Column functions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

STRINGS = "array<string>"

#: Fixed value: the format of a line that opens an option: a letter, a dot, bracket or colon, and its text.
OPTION_LINE = r"^\s*([A-Za-z])[.):]\s*(.*)$"


def strip(c: Column) -> Column:
    """All white space off both ends, tabs and line ends included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_label(c: Column) -> Column:
    return F.lower(strip(c))


def label_from_index(i: Column) -> Column:
    """0 is ``a``; beyond ``z`` it is ``option_{i+1}``."""
    return F.when(i.between(0, 25), F.chr(i + 97)).otherwise(F.concat(F.lit("option_"), (i + 1).cast("string")))


def _counted(digits: Column) -> Column:
    """Label of a number counted from 1, of any length; 0 stays 0."""
    n = F.regexp_replace(digits, "^0+", "")
    small = F.when(F.length(n) < 3, n.cast("int"))
    return F.when(n == "", F.lit("a")).when(small <= 26, F.chr(small + 96)).otherwise(F.concat(F.lit("option_"), n))


def candidate_to_label(candidate: Column, idx: Column) -> Column:
    """Label of an option's key. First that fits: blank, ``(A)``/``A.``/``A-``, a number counted from 1 (0 stays 0), a last letter, a last number, the index."""
    s = strip(F.coalesce(candidate, F.lit("")))
    letter = F.regexp_extract(s, r"^\(?([A-Za-z])[).:\-]?$", 1)
    number = F.regexp_extract(s, r"^([0-9]+)$", 1)
    last_letter = F.regexp_extract(F.lower(s), "([a-z])$", 1)
    last_number = F.regexp_extract(s, "([0-9]+)$", 1)
    return (
        F.when(s == "", label_from_index(idx))
        .when(letter != "", F.lower(letter))
        .when(number != "", _counted(number))
        .when(last_letter != "", last_letter)
        .when(last_number != "", _counted(last_number))
        .otherwise(label_from_index(idx))
    )


def parse_list(s: Column) -> Column:
    """A list written as JSON, as a literal with any brackets and quotes, or between commas; null and blank give an empty list."""
    parts = F.filter(F.transform(F.split(s, ","), strip), lambda x: x != "")
    listed = F.from_json(F.regexp_replace(s, r"(?s)^\s*\((.*?),?\s*\)\s*$", "[$1]"), STRINGS)
    return F.when(F.coalesce(strip(s), F.lit("")) == "", F.array().cast(STRINGS)).otherwise(F.coalesce(listed, parts))


def parse_choices(items: Column) -> Column:
    """Every item's only letter, or its first ASCII letter, in lower case; items without one go, repeats stay."""
    letter = lambda x: F.when(strip(x).rlike(r"^\p{L}$"), F.lower(strip(x))).otherwise(F.lower(F.regexp_extract(x, "[A-Za-z]", 0)))
    return F.filter(F.transform(items, letter), lambda x: x != "")


def answer_letters(s: Column) -> Column:
    """Every ASCII letter of the answer, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("[A-Za-z]"), F.lit(0)), F.lower))


def gold_indices(s: Column) -> Column:
    """The items of a list, as :func:`parse_list` reads it, that are whole numbers, each once, in order; signs count."""
    whole = F.filter(F.transform(parse_list(s), strip), lambda x: x.rlike(r"^[+-]?[0-9]{1,18}$"))
    return F.array_distinct(F.transform(whole, lambda x: x.cast("long")))


def parse_option_map(text: Column) -> Column:
    """Options of a block of lines: ``A. text`` opens one, later lines go on with it, the last of equal labels wins, empty ones go."""
    kind = "array<struct<k:string,v:string>>"
    header = OPTION_LINE

    def step(acc: Column, line: Column) -> Column:
        label, body = F.lower(F.regexp_extract(line, header, 1)), strip(F.regexp_extract(line, header, 2))
        last = F.element_at(acc, -1)
        more = F.struct(last["k"].alias("k"), strip(F.concat_ws(" ", last["v"], strip(line))).alias("v"))
        return (
            F.when(label != "", F.concat(acc, F.array(F.struct(label.alias("k"), body.alias("v")))))
            .when((strip(line) == "") | (F.size(acc) == 0), acc)
            .otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more)))
        )

    entries = F.aggregate(F.split(F.coalesce(text, F.lit("")), r"\R"), F.array().cast(kind), step)
    filled = F.filter(entries, lambda e: e["v"] != "")
    labels = F.array_distinct(F.transform(filled, lambda e: e["k"]))
    return F.map_from_arrays(labels, F.transform(labels, lambda k: F.element_at(F.filter(filled, lambda e: e["k"] == k), -1)["v"]))


def question_text(text: Column, query: Column) -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), strip(query))


def options_by_label(labels: Column, options: Column) -> Column:
    """Text of every label, ``Option X`` where there is none; without labels the options' own sorted ones."""
    known = F.coalesce(options, F.create_map().cast("map<string,string>"))
    names = F.when(F.size(labels) > 0, F.array_distinct(labels)).otherwise(F.array_sort(F.map_keys(known)))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.coalesce(F.nullif(strip(F.try_element_at(known, k)), F.lit("")), F.concat(F.lit("Option "), F.upper(k)))))


def indices_to_labels(idx: Column, labels: Column) -> Column:
    """All in range from 0: counted from 0; else all in range from 1: from 1; else each by itself."""
    n = F.size(labels)
    zero, one = F.forall(idx, lambda i: i.between(0, n - 1)), F.forall(idx, lambda i: i.between(1, n))
    each = F.transform(idx, lambda i: F.when(i.between(0, n - 1), F.get(labels, i)).when(i.between(1, n), F.get(labels, i - 1)))
    chosen = F.when(zero, F.transform(idx, lambda i: F.get(labels, i))).when(one, F.transform(idx, lambda i: F.get(labels, i - 1))).otherwise(each)
    return F.array_distinct(F.filter(chosen, lambda x: x.isNotNull()))


def gold_by_index(indices: Column, letters: Column, labels: Column) -> Column:
    """Labels at the valid indices; without one, the answer's letters that are labels."""
    at = F.array_distinct(F.filter(F.transform(indices, lambda i: F.get(labels, i)), lambda x: x.isNotNull()))
    return F.when(F.size(at) > 0, at).otherwise(F.array_intersect(letters, labels))


def gold_generic(gold: Column, answer: Column, labels: Column, options: Column) -> Column:
    """Right labels of a question from its ``gold`` and ``answer``, each a number, a letter, a text, or a list of them as text.

    The union of the gold's indices, the answer's indices, its letters and its items that are
    labels, in that order; only if there is none, the labels of options whose text is an item
    of the answer, the last of equal texts.
    """
    items = F.transform(parse_list(answer), normal_label)
    found = F.concat(indices_to_labels(gold_indices(gold), labels), indices_to_labels(gold_indices(answer), labels), answer_letters(answer), items)
    known = F.array_distinct(F.filter(found, lambda x: F.array_contains(labels, x)))
    entries = F.map_entries(F.coalesce(options, F.create_map().cast("map<string,string>")))
    by_text = F.transform(items, lambda t: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(entries, lambda e: normal_label(e["value"]) == t), lambda e: e["key"])), -1))
    named = F.array_distinct(F.filter(by_text, lambda x: x.isNotNull() & F.array_contains(labels, x)))
    return F.when(F.size(known) > 0, known).otherwise(named)


#: What the text and the label of an option may be called, the first that is there.
TEXT_NAMES = ("text", "value", "content", "option_text", "choice", "option")
LABEL_NAMES = ("label", "key", "id", "option", "choice")


def first_present(container: Column, names: tuple[str, ...], fields: list[str] | None = None) -> Column:
    """The value under the first of ``names`` that is there, letter case aside; of keys equal but for case the last.

    ``fields`` are the fields of a struct; without them the container is a map of strings, in
    which a key that is there with a null gives null, and later names are not looked at.
    """
    if fields is not None:
        known = {f.lower(): f for f in fields}
        hit = next((known[n] for n in names if n in known), None)
        return F.lit(None).cast("string") if hit is None else container[hit].cast("string")
    keys = F.transform(F.map_keys(container), F.lower)
    at = lambda n: F.get(F.map_values(container), F.size(keys) - F.array_position(F.reverse(keys), n).cast("int"))
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.array_contains(keys, n), at(n)).otherwise(out)
    return out


def mixed_options(options: Column, kind: DataType, query: Column | None = None) -> Column:
    """``labels, texts`` of options that come as a map, a list of maps or structs, a list of texts, or a text of any of these, by their type ``kind``.

    Options of the query's block come first, in order of their labels, if ``query`` is given.
    A list's item is an option of the label it names, of the letter its text begins with
    (``A. text``), or of its place. The last text that is not blank stands; a label without
    one has ``Option X`` by its place among the labels.
    """
    pair = "array<struct<k:string,v:string>>"
    made = lambda k, v: F.struct(k.alias("k"), strip(F.coalesce(v.cast("string"), F.lit(""))).alias("v"))

    def text_item(x: Column, i: Column) -> Column:
        line = f"(?d){OPTION_LINE}"  # a text of several lines is no such line
        head = F.regexp_extract(x, line, 1)
        inline = made(F.lower(head), F.regexp_extract(x, line, 2))
        return F.when(head != "", inline).otherwise(made(label_from_index(i), x))

    if isinstance(kind, MapType):
        inner = kind.valueType
        names = TEXT_NAMES[:4] + ("option", "choice")
        value = lambda v: first_present(v, names, inner.names) if isinstance(inner, StructType) else first_present(v, names) if isinstance(inner, MapType) else v
        entries = F.transform(F.map_entries(options), lambda e, i: made(candidate_to_label(e["key"], i), value(e["value"])))
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, MapType)):
        fields = kind.elementType.names if isinstance(kind.elementType, StructType) else None
        label = lambda x, i: candidate_to_label(F.coalesce(first_present(x, LABEL_NAMES, fields), (i + 1).cast("string")), i)
        entries = F.transform(options, lambda x, i: made(label(x, i), first_present(x, TEXT_NAMES, fields)))
    else:
        items = options if isinstance(kind, ArrayType) else parse_list(options)
        entries = F.filter(F.transform(F.transform(items, strip), lambda x, i: F.when(x != "", text_item(x, i))), lambda e: e.isNotNull())
    entries = F.coalesce(entries.cast(pair), F.array().cast(pair))
    if query is not None:
        block = parse_option_map(query)
        entries = F.concat(F.transform(F.array_sort(F.map_keys(block)), lambda k: F.struct(k.alias("k"), F.try_element_at(block, k).alias("v"))).cast(pair), entries)

    def told(e: Column) -> Column:
        labels = F.array_distinct(F.transform(e, lambda x: x["k"]))
        texts = F.transform(labels, lambda k, i: F.coalesce(F.try_element_at(F.transform(F.filter(e, lambda x: (x["k"] == k) & (x["v"] != "")), lambda x: x["v"]), F.lit(-1)), F.concat(F.lit("Option "), F.upper(label_from_index(i)))))
        return F.struct(labels.alias("labels"), F.map_from_arrays(labels, texts).alias("texts"))

    return F.get(F.transform(F.array(entries), told), F.lit(0))


def english_only(sheet: Column, key: Column) -> Column:
    """Whether a row is of the English part: by its sheet where it has one, else by an id that does not begin with ``zh_``."""
    name = normal_label(F.coalesce(sheet, F.lit("")))
    return F.when(name != "", name == "english").otherwise(~F.startswith(strip(F.coalesce(key, F.lit(""))), F.lit("zh_")))


#: Fixed value: how the prompt begins.
PROMPT = "You are answering a financial multiple-choice question.\nExactly one option is correct. Return only one option letter."


def answer_prompt(question: Column, labels: Column, options: Column) -> Column:
    """The text that asks a language model for one letter: question, one line for each option, and the word before the answer."""
    lines = F.transform(labels, lambda k: F.concat(F.upper(k), F.lit(". "), F.coalesce(strip(F.try_element_at(options, k)), F.lit(""))))
    return F.concat(F.lit(f"{PROMPT}\n\nQuestion:\n"), question, F.lit("\n\nOptions:\n"), F.array_join(lines, "\n"), F.lit("\n\nAnswer:"))


def title_and_text(title: Column, text: Column) -> Column:
    """Title and text as one document, nulls as nothing."""
    return strip(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def matches_question_type(kind: Column, required: str) -> Column:
    k = normal_label(F.coalesce(kind, F.lit("")))
    wanted = required.strip().lower()
    hit = (k.contains("mcq") | k.contains("multiple choice")) if wanted == "mcq" else k.contains(wanted)
    return (k != "") & hit


def option_columns(columns: dict[str, Column]) -> Column:
    """Wide option columns as a map; blank ones go."""
    both = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*columns.values()))
    return F.map_filter(both, lambda _, v: v.isNotNull() & (strip(v) != ""))


def labels_to_answer(labels: Column) -> Column:
    """No label: empty; one: the label; more: a JSON list with a space after each comma."""
    low = F.array_distinct(F.transform(labels, normal_label))
    listed = F.concat(F.lit('["'), F.array_join(low, '", "'), F.lit('"]'))
    return F.when(F.size(low) > 1, listed).otherwise(F.coalesce(F.get(low, F.lit(0)), F.lit("")))


def words(t: Column) -> Column:
    """The set of ASCII words of at least two letters, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower))


def first_sentences(q: Column, k: int = 2) -> Column:
    return F.array_join(F.slice(F.split(F.regexp_replace(strip(q), r"\s+", " "), r"(?<=[.?!])\s+"), 1, k), " ")


def pair_text(question: Column, label: Column, option: Column) -> Column:
    return F.format_string("Question: %s\nOption %s: %s", question, F.upper(label), option)


def predicted_letter(generated: Column, allowed: Column) -> Column:
    """First letter that stands alone and is allowed."""
    found = F.transform(F.regexp_extract_all(F.coalesce(generated, F.lit("")), F.lit(r"(?i)\b([A-Z])\b"), F.lit(1)), F.lower)
    return F.slice(F.filter(found, lambda x: F.array_contains(allowed, x)), 1, 1)


def masked_labels(ids: Column, prompt_length: Column) -> Column:
    """Token ids with the prompt's masked out by -100."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(-100)).otherwise(x))


def clean_text(c: Column) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("Unknown"))


def in_range(c: Column, low: float, high: float) -> Column:
    """Whether a value is present and in range; null is not."""
    return F.coalesce(c.between(low, high), F.lit(False))


def binned(c: Column, width: int) -> Column:
    return (F.floor(c / width) * width).cast("int")


def clip_rating(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(10.0)), F.lit(0.0)))


def round_rating(c: Column) -> Column:
    """Clipped to 0..10 and rounded, halves to even."""
    return F.rint(clip_rating(c)).cast("int")


def title_and_body(text: Column, stem: Column) -> tuple[Column, Column]:
    """First line that is not blank, and the stripped text; an empty text has its file's stem for a title."""
    first = F.get(F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != ""), F.lit(0))
    return F.coalesce(first, stem), F.coalesce(strip(text), F.lit(""))


def resolve_column(columns: list[str], *names: str) -> str | None:
    """The first column that equals a name but for case, else but for all except letters and digits."""
    for key in (str.lower, lambda s: re.sub(r"[^a-z0-9]", "", s.lower())):
        known = {key(c): c for c in columns}
        for n in names:
            if key(n) in known:
                return known[key(n)]
    return None
