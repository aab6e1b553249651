"""Language analysers: words in lower case, without stop words, reduced to stems.

The stems are those of two published algorithms: Porter's for English and the Snowball rules
for Russian. They run over whole word lists in Arrow batches, and every task remembers the
stems of the words it has met, so a stem is derived once for each distinct word of a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the English analyser leaves out.
ENGLISH_STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Words that the Russian analyser leaves out.
RUSSIAN_STOP = frozenset(
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас "
    "нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой "
    "совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три "
    "эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между".split()
)

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


# English: Porter's algorithm


def _shape(w: str) -> str:
    """``v`` and ``c`` for each letter; y is a vowel after a consonant."""
    out = ""
    for k, x in enumerate(w):
        out += "v" if x in "aeiou" or (x == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant at the end, the last no w, x or y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


#: Endings of the second and third step and what replaces them, where the stem has a measure.
SECOND = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al",
    iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
THIRD = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
#: Endings that go in the fourth step, where the stem has two measures.
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, endings: Iterable[str]) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def english_stem(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    elif (e := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for step in (SECOND, THIRD):
        e = _longest(w, step)
        if e and _measure(w[: -len(e)]):
            w = w[: -len(e)] + step[e]
    e = _longest(w, FOURTH)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# Russian: the Snowball rules

_V = "аеиоуыэюя"
#: Endings of each class of words; those of a first group stand after а or я.
GERUND = ("вшись вши в", "ившись ывшись ивши ывши ив ыв")
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею"
PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
VERB = ("ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н", "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю")
NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я"


def _any(endings: str) -> str:
    return "|".join(endings.split())


def _grouped(groups: tuple[str, str]) -> str:
    return rf"(?:(?:(?<=[ая])(?:{_any(groups[0])}))|(?:{_any(groups[1])}))"


_GERUND = re.compile(_grouped(GERUND) + "$")
_REFLEXIVE = re.compile("(?:ся|сь)$")
_ADJECTIVE = re.compile(rf"(?:{_any(ADJECTIVE)})$")
_PARTICIPLE = re.compile(_grouped(PARTICIPLE) + "$")
_VERB = re.compile(_grouped(VERB) + "$")
_NOUN = re.compile(rf"(?:{_any(NOUN)})$")


def _region(w: str) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.search(f"[{_V}][^{_V}]", w)
    return m.end() if m else len(w)


def russian_stem(w: str) -> str:
    w = w.replace("ё", "е")
    first = re.search(f"[{_V}]", w)
    if first is None:
        return w
    head, rv = w[: first.end()], w[first.end() :]
    r1 = _region(w)
    r2 = r1 + _region(w[r1:])
    cut = _GERUND.sub("", rv)
    if cut == rv:
        rv = _REFLEXIVE.sub("", rv)
        cut = _ADJECTIVE.sub("", rv)
        if cut != rv:
            cut = _PARTICIPLE.sub("", cut)
        elif (cut := _VERB.sub("", rv)) == rv:
            cut = _NOUN.sub("", rv)
    rv = cut.removesuffix("и")
    m = re.search("(?:ость|ост)$", rv)
    if m and len(head) + m.start() >= r2:
        rv = rv[: m.start()]
    if rv.endswith("нн"):
        rv = rv[:-1]
    elif m := re.search("(?:ейше|ейш)$", rv):
        rv = rv[: m.start()]
        rv = rv[:-1] if rv.endswith("нн") else rv
    else:
        rv = rv.removesuffix("ь")
    return head + rv


def _plain(text: str) -> list[str]:
    return re.findall("[a-z0-9а-яёіїєґ]{2,}", text.lower())


def _english(text: str) -> list[str]:
    words = (w.replace("’", "'").removesuffix("'s") for w in WORD.findall(text.lower()))
    return [_english_stem(w) for w in words if w not in ENGLISH_STOP]


def _russian(text: str) -> list[str]:
    return [_russian_stem(w) for w in WORD.findall(text.lower()) if w not in RUSSIAN_STOP]


_english_stem = lru_cache(maxsize=200_000)(english_stem)
_russian_stem = lru_cache(maxsize=200_000)(russian_stem)

#: Analysers by name: from a text to its terms in order. ``plain`` has whole words of two letters and more.
ANALYSERS: dict[str, Callable[[str], list[str]]] = {"plain": _plain, "english": _english, "russian": _russian}


def analysed(text: Column, analyser: str) -> Column:
    """Terms of a text; an empty list for null."""
    of = ANALYSERS[analyser]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: of(t) if isinstance(t, str) else [])

    return F.pandas_udf(run, "array<string>", F.PandasUDFType.SCALAR_ITER)(text)
