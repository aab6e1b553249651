"""Language of every document and passage by cross-parsing entropy against suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled text. A
passage is parsed against each automaton into the longest pieces that occur in the sample;
the language that needs the fewest pieces, normalised to bits by the sample's length and the
passage's, wins, and the confidence is the share of the second best language, or of that bound
where it is nearer, in the bits of both.

The automata are dense transition tables, so that a task parses all passages of a batch in
step with each other in NumPy: one table look-up for each language and character. Languages
of the other script need a piece for every letter, so only those of the passage's own script
are parsed.

Samples come from labelled rows: ``SAMPLE_DOCS`` documents of each label, the first by a hash
of their id, cut to the same length for all languages of a script. Labels may be wrong, so
the automata are built twice, the second time from the sentences that the first ones give to
their label. The sample is the only thing fitted; every document is then parsed whole.

A passage that costs clearly more bits a letter than the language's letters taken one by one
is told nothing by its pieces: it is of a language that is not known
(``UNKNOWN``), and so is a document most of whose words are. Unknown passages are no cases.

Passages are sentences of at least ``LEAST_WORDS`` words; names and shorter quotations belong
to the passage around them. Garbled text is decoded first and counts as what it was. Null and
empty texts, and texts without words of the known scripts, have no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import mojibake

#: Documents sampled for each label, and letters of a language's automaton at most.
SAMPLE_DOCS = 60
SAMPLE_LETTERS = 45_000
#: Words of a passage that counts.
LEAST_WORDS = 6
#: How many more pieces the document's language must need before a passage is of another one.
MARGIN, MARGIN_PIECES = 1.25, 3

#: What passages in none of the languages are called, and how many times the entropy of a language's single letters it may cost a letter.
UNKNOWN, UNLIKE = "und", 1.15

#: The languages, by script.
SCRIPTS = {"latin": ("en", "de", "fr"), "cyrillic": ("ru", "bg", "uk")}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyzäöüßàâæçéèêëîïôœùûÿ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ"}
#: Names and codes of languages on labels.
LABELS = {
    "en": "en eng english английский английски англійська anglais englisch", "ru": "ru rus russian русский руски російська russe russisch",
    "bg": "bg bul bulgarian български болгарский болгарська bulgare bulgarisch", "uk": "uk ukr ua ukrainian українська украинский украински ukrainien ukrainisch",
    "de": "de deu ger german deutsch немецкий немски німецька allemand", "fr": "fr fra fre french français francais французский френски французька französisch",
    "es": "es spa spanish español", "it": "it ita italian italiano", "pl": "pl pol polish polski", "pt": "pt por portuguese", "nl": "nl nld dut dutch", "sr": "sr srp serbian", "cs": "cs ces cze czech", "be": "be bel belarusian",
}


@lru_cache(maxsize=1)
def _labels() -> dict[str, str]:
    return {n: k for k, v in LABELS.items() for n in v.split()}


def label_language(label: str | None) -> str | None:
    """The language a label names, in any spelling; None where it names none."""
    s = (label or "").strip().lower()
    return _labels().get(s) or _labels().get(re.split(r"[-_ (/]", s)[0]) if s else None


def suffix_automaton(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions ``[state * alphabet + letter]`` of the suffix automaton of ``text``; -1 is none, state 0 the start."""
    goes: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in goes[p]:
            goes[p][c] = cur
            p = link[p]
        if p != -1:
            q = goes[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and goes[p].get(c) == q:
                    goes[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full(len(goes) * alphabet, -1, dtype=np.int32)
    for s, g in enumerate(goes):
        for c, t in g.items():
            table[s * alphabet + c] = t
    return table


@lru_cache(maxsize=4)
def _code_table(script: str) -> np.ndarray:
    """Code of every character of the basic plane: 1 and up for letters of the script in either case, 0 for all else."""
    out = np.zeros(0x10000, dtype=np.int8)
    for k, c in enumerate(LETTERS[script]):
        out[ord(c)] = k + 1
        if len(c.upper()) == 1:
            out[ord(c.upper())] = k + 1
    for k in range(26 if script == "latin" else 0):  # full-width letters
        out[0xFF21 + k] = out[0xFF41 + k] = k + 1
    return out


class Text:
    """Texts laid end to end as code points, with what is counted along them."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
        points = np.where(self.points < 0x10000, self.points, 0)
        self.codes = {k: _code_table(k)[points] for k in SCRIPTS}
        kind = _kinds()[points]
        letter = (kind & LETTER) > 0
        word = letter & ~np.concatenate([[False], letter[:-1]])
        flags = [kind & b for b in (CYRILLIC, LATIN, ODD, CAPITAL, ACCENT, LETTER)] + [word]
        self.counts = [np.concatenate([np.zeros(1, np.int32), np.cumsum(f > 0, dtype=np.int32)]) for f in flags]

    def stats(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Cyrillic and Latin letters, odd characters, Cyrillic capitals, accented letters, letters and words of each span."""
        return [c[ends] - c[starts] for c in self.counts]

    def coded(self, script: str, start: int, end: int) -> np.ndarray:
        """Letter codes of a span, with every run of other characters as one 0."""
        codes = self.codes[script][start:end]
        keep = codes > 0
        keep[1:] |= keep[:-1] & ~keep[1:]
        return codes[keep]


CYRILLIC, LATIN, ODD, CAPITAL, ACCENT, LETTER = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kinds of every character of the basic plane, as bits."""
    out = np.zeros(0x10000, dtype=np.uint8)
    plain = set(map(chr, range(0x80))) | set("ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜßàâäçèéêëîïôöùûüÿœŒ«»„“”‘’…—–№€\xa0")
    plain |= set("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ") | set("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ".upper())
    for k in range(0x10000):
        c = chr(k)
        if 0x400 <= k < 0x530:
            out[k] |= CYRILLIC
        if (k < 0x250 and c.isalpha()) or 0x1E00 <= k < 0x1F00 or 0xFF21 <= k < 0xFF5B:
            out[k] |= LATIN
        if c not in plain and not 0x2000 <= k < 0x2070 and not 0xFF00 <= k < 0xFF60 and not 0x300 <= k < 0x370 and not 0xD800 <= k < 0xE000:
            out[k] |= ODD
        if 0x410 <= k < 0x430:
            out[k] |= CAPITAL
        if 0xC0 <= k < 0x100:
            out[k] |= ACCENT
        if c.isalpha():
            out[k] |= LETTER
    out[0] = 0
    return out


class Model:
    """Automata of all languages in one table for each script."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages: dict[str, tuple[str, ...]] = {}
        self.limits: dict[str, float] = {}
        self.tables: dict[str, tuple[np.ndarray, np.ndarray, float]] = {}
        for script, languages in SCRIPTS.items():
            coded = {}
            for x in languages:
                if texts.get(x):
                    laid = Text(texts[x])
                    coded[x] = laid.coded(script, 0, len(laid.points))[:SAMPLE_LETTERS]
            coded = {x: v for x, v in coded.items() if len(v)}
            self.languages[script] = tuple(coded)
            n = min(map(len, coded.values()), default=0)
            alphabet = len(LETTERS[script]) + 1
            parts, offsets, at = [], [], 0
            for x, v in coded.items():
                t = suffix_automaton(v[:n], alphabet)
                share = np.bincount(v[:n]) / n
                self.limits[x] = -UNLIKE * float(np.sum(share * np.log2(np.maximum(share, 1e-12))))
                t[t >= 0] += at
                parts.append(t)
                offsets.append(at)
                at += len(t) // alphabet
            self.tables[script] = (np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(offsets, dtype=np.int64), float(np.log2(max(n, 2))))

    def bits(self, script: str, passages: list[np.ndarray], lanes: int = 2048) -> np.ndarray:
        """Bits of each coded passage (rows) under each language of the script (columns)."""
        table, starts, size = self.tables[script]
        alphabet, k = len(LETTERS[script]) + 1, len(starts)
        out = np.zeros((len(passages), k))
        if not k or not passages:
            return out
        lengths = np.array([len(p) for p in passages], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), lanes):
            group = order[at : at + lanes]
            ends = lengths[group]
            width = int(ends[0])
            text = np.zeros((len(group), max(1, width)), dtype=np.uint8)
            text[np.arange(text.shape[1]) < ends[:, None]] = np.concatenate([passages[i] for i in group]).view(np.uint8)
            text = np.ascontiguousarray(text.T).astype(np.int32)
            alive = np.searchsorted(-ends, -np.arange(width), side="left")
            state = np.repeat(starts[:, None], len(group), axis=1).astype(np.int32) * alphabet
            count = np.zeros((k, len(group)), dtype=np.int32)
            again = (starts * alphabet)[:, None].astype(np.int32)
            for t in range(width):
                n = alive[t]
                c = text[t, :n]
                nxt = table[state[:, :n] + c]
                failed = nxt < 0
                count[:, :n] += failed
                nxt = np.where(failed, table[again + c], nxt)
                # a letter that the sample lacks is a piece of its own
                state[:, :n] = np.where(nxt < 0, again, nxt * alphabet)
            out[group] = (count.T + 1) * size
        return out


_END = re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+|\s*\n\s*")
_WORDS = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"\S+://\S+|\S+@\S+|www\.\S+|\S+\.example\S*")
_GOOD = re.compile("[А-ЯЁІЇЄҐ]?[а-яёіїєґ]+")


def _decoded(s: str, written: str, read: str, times: int) -> str | None:
    """``s`` as it was before it was read wrongly so many times; None where it was not, or was no plain Cyrillic."""
    t = s
    try:
        for _ in range(times):
            t = t.encode(read, "millrace-back").decode(written, "strict" if written != "utf-8" else "ignore")
    except UnicodeError:
        return None
    words = _WORDS.findall(t)
    n = sum(map(len, words))
    return t if n and t != s and sum(len(w) for w in words if _GOOD.fullmatch(w)) >= 0.8 * n else None


@lru_cache(maxsize=1)
def _chains() -> list[tuple[str, str, int]]:
    return [(w, r, n) for w, r, undefined, n in mojibake.chains() if undefined == "millrace-keep" and r != "utf-8"]


def ungarble(s: str) -> list[str]:
    """The texts that a passage may have been before a wrong decoding, each of plain Cyrillic.

    A chain is ruled out at the first character that its encoding lacks or where its bytes
    are no text; the share of good words is taken over the whole passage.
    """
    out = []
    for written, read, times in _chains():
        t = _decoded(s, written, read, times)
        if t is not None and t not in out:
            out.append(t)
    return out


def passages_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text."""
    out: list[tuple[int, int]] = []
    at = 0
    for m in _END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if len(text) > at:
        out.append((at, len(text)))
    return out


def _without_links(text: str) -> str:
    """The text with links blanked out, at the same places."""
    if "://" in text or "www." in text or ".example" in text or "@" in text:
        return _LINK.sub(lambda m: " " * len(m[0]), text)
    return text


def _sure(best: float, second: float, limit: float) -> float:
    """Confidence in a language of ``best`` bits, against the next one or, where that is nearer, the bits at which none of them is meant."""
    rival = min(second, max(limit, best))
    return rival / (rival + best) if best > 0 else 0.5


def decide(
    spans: list[tuple[int, int]], words: list[int], scripts: list[str], bits: list[dict[str, float]], letters: list[int], limits: dict[str, float]
) -> tuple[str | None, float, list[tuple[int, int, str, float]]]:
    """Language and confidence of a document, and its passages in runs of one language.

    A passage of enough words that needs more bits a letter than ``limits`` allow is of none
    of the languages (``UNKNOWN``). The confidence of a run is the mean of its passages',
    weighted by their words; that of a document is held against the words of its other
    scripts as well.

    Each script's own main language is the one with the fewest bits over all its passages; a
    passage is of another language of that script only if that needs clearly fewer pieces.
    """
    total: dict[str, dict[str, float]] = {}
    sizes: dict[str, int] = {}
    for n, k, b in zip(words, scripts, bits, strict=True):
        if b:
            sizes[k] = sizes.get(k, 0) + n
            for x, v in b.items():
                total.setdefault(k, {})[x] = total.get(k, {}).get(x, 0.0) + v
    if not total:
        return None, 0.0, []
    script = max(sizes, key=lambda k: (sizes[k], k))
    ranked = {k: sorted((v, x) for x, v in t.items()) for k, t in total.items()}
    main = ranked[script][0][1]
    runs: list[list] = []
    unknown = 0
    for (a, z), n, k, b, m in zip(spans, words, scripts, bits, letters, strict=True):
        if not b:
            continue
        own = ranked[k][0][1]
        best = min((v, x) for x, v in b.items())[1]
        limit = limits.get(best, np.inf) * m
        if n < LEAST_WORDS:
            best = runs[-1][2] if runs else main
        elif b[best] > limit:
            best = UNKNOWN
        elif best != own and b[own] < MARGIN * b[best] + MARGIN_PIECES * 15:
            best = own
        if best in b:
            sure = _sure(b[best], min((v for x, v in b.items() if x != best), default=np.inf), limit)
        else:
            sure = 0.5
        unknown += n * (best == UNKNOWN)
        if runs and runs[-1][2] == best:
            runs[-1][1:] = [z, best, runs[-1][3] + sure * n, runs[-1][4] + n]
        else:
            runs.append([a, z, best, sure * n, n])
    out = [(a, z, x, c / n if n else 0.5) for a, z, x, c, n in runs]
    if 2 * unknown > sum(sizes.values()):
        return UNKNOWN, unknown / sum(sizes.values()), out
    inside = sum(m for m, k, b in zip(letters, scripts, bits, strict=True) if k == script and b)
    first, second = ranked[script][0][0], ranked[script][1][0] if len(ranked[script]) > 1 else np.inf
    return main, _sure(first, second, limits.get(main, np.inf) * inside) * max(sizes[script], 1) / max(sum(sizes.values()), 1), out


def passage_bits(texts: list[str], model: Model) -> tuple[list[list[tuple[int, int]]], np.ndarray, list[str], list[dict[str, float]], list[int]]:
    """Passages of every text with their words, scripts, bits and coded letters; garbled ones by their likeliest reading."""
    blank = [_without_links(t) for t in texts]
    spans = [passages_of(t) for t in blank]
    laid = Text(blank)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in blank])])
    starts = np.array([o + a for o, ps in zip(offsets, spans, strict=False) for a, _ in ps], dtype=np.int64)
    ends = np.array([o + z for o, ps in zip(offsets, spans, strict=False) for _, z in ps], dtype=np.int64)
    cyr, lat, odd, cap, acc, let, words = laid.stats(starts, ends)
    upset = ((odd >= 3) & (odd * 6 > let)) | ((acc > 5) & (acc * 3 > let)) | ((let > 10) & (cap * 2 > let))
    scripts = np.where(cyr > lat, "cyrillic", "latin").tolist()
    # of a passage that quotes the other script, the words of its own count
    words = np.maximum(words * np.maximum(cyr, lat) // np.maximum(cyr + lat, 1), words > 0)
    bits: list[dict[str, float]] = [{} for _ in scripts]
    letters = [0] * len(scripts)
    flat = [t[a:z] for t, ps in zip(blank, spans, strict=True) for a, z in ps] if upset.any() else []
    readings = {int(i): r for i in np.flatnonzero(upset) if (r := ungarble(flat[i]))}
    for k, names in model.languages.items():
        mine = [i for i, x in enumerate(scripts) if x == k and i not in readings and let[i]]
        coded = [laid.coded(k, int(starts[i]), int(ends[i])) for i in mine]
        rows = model.bits(k, coded)
        for i, r, c in zip(mine, rows.tolist(), coded, strict=True):
            bits[i], letters[i] = dict(zip(names, r, strict=True)), len(c)
    if readings:
        keys = [(i, t) for i, ts in readings.items() for t in ts]
        plain = Text([t for _, t in keys])
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in keys])])
        coded = [plain.coded("cyrillic", int(at[j]), int(at[j + 1])) for j in range(len(keys))]
        rows = model.bits("cyrillic", coded)
        best: dict[int, float] = {}
        for (i, t), r, c in zip(keys, rows.tolist(), coded, strict=True):
            if r and min(r) < best.get(i, np.inf):
                best[i] = min(r)
                letters[i] = len(c)
                bits[i] = dict(zip(model.languages["cyrillic"], r, strict=True))
                scripts[i] = "cyrillic"
                words[i] = len(_WORDS.findall(t))
    return spans, words, scripts, bits, letters


def identify(texts: list[str | None], model: Model) -> list[tuple[str | None, float, list[tuple[int, int, str, float]]]]:
    """Language, confidence and passages of every text."""
    spans, words, scripts, bits, letters = passage_bits([t or "" for t in texts], model)
    out, k = [], 0
    words = words.tolist()
    for ps in spans:
        n = k + len(ps)
        out.append(decide(ps, words[k:n], scripts[k:n], bits[k:n], letters[k:n], model.limits))
        k = n
    return out


def fit(df: DataFrame, text_col: str, label_col: str, id_col: str, docs: int = SAMPLE_DOCS) -> Model:
    """Automata from at most ``docs`` labelled documents of each language, those of the smallest hashed ids.

    The sample is bounded by ``docs`` and the number of languages, whatever the table holds.
    """
    names = {n: k for n, k in _labels().items() if k in {x for v in SCRIPTS.values() for x in v}}
    code = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    label = F.try_element_at(code, F.lower(F.trim(F.regexp_extract(F.col(label_col), r"^\s*(\p{L}+)", 1))))
    rows = df.select(label.alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("t")).where("lang is not null and length(t) > 200")
    ranked = rows.withColumn("r", F.expr("row_number() over (partition by lang order by h, t)")).where(F.col("r") <= docs)
    texts: dict[str, list[str]] = {}
    for r in ranked.select("lang", "t").orderBy("lang", "r").collect():
        texts.setdefault(r[0], []).append(r[1])
    # a sentence is judged by the half of the sample that it does not come from
    halves = [Model({x: t[h::2] for x, t in texts.items()}) for h in (0, 1)]
    kept: dict[str, list[str]] = {}
    for h, other in ((0, halves[1]), (1, halves[0])):
        for x, mine in texts.items():
            part = mine[h::2]
            spans, words, _, bits, _ = passage_bits(part, other)
            flat = [t[a:z] for t, ps in zip(part, spans, strict=True) for a, z in ps]
            kept.setdefault(x, []).extend(s for s, n, b in zip(flat, words, bits, strict=True) if n >= LEAST_WORDS and b and min(b, key=lambda k: b[k]) == x)
    return Model(kept)


def _documents(batches: Iterator[pd.DataFrame], model, what: str) -> Iterator[pd.DataFrame]:
    m = model.value
    for b in batches:
        for k in range(0, len(b), 1000):
            part = b.iloc[k : k + 1000]
            found = identify(part["text"].tolist(), m)
            rows: list[tuple] = []
            for doc, label, (main, sure, runs) in zip(part["doc_id"], part["label"], found, strict=True):
                if what == "segments":
                    rows += [(doc, a, z, x, c) for a, z, x, c in runs]
                elif what == "documents":
                    rows.append((doc, main, sure))
                elif main is not None:
                    languages = ({x for _, _, x, _ in runs} | ({main} if not runs else set())) - {UNKNOWN}
                    if languages and (len(languages) > 1 or label_language(label) != next(iter(languages))):
                        rows += [(doc, x) for x in sorted(languages)]
            columns = {"segments": ["doc_id", "start", "end", "language", "confidence"], "documents": ["doc_id", "language", "confidence"], "cases": ["doc_id", "found_lang"]}
            yield pd.DataFrame(rows, columns=columns[what])


def label_languages(df: DataFrame, what: str, text_col: str = "text", label_col: str = "language", id_col: str = "doc_id", docs: int = SAMPLE_DOCS) -> DataFrame:
    """``what``: ``documents`` (language, confidence), ``segments`` (spans with theirs) or ``cases`` (documents whose label is missing, wrong or not all)."""
    schemas = {
        "documents": "doc_id long, language string, confidence double",
        "segments": "doc_id long, start int, end int, language string, confidence double",
        "cases": "doc_id long, found_lang string",
    }
    model = df.sparkSession.sparkContext.broadcast(fit(df, text_col, label_col, id_col, docs))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    return rows.mapInPandas(partial(_documents, model=model, what=what), schemas[what])
