"""Held-out texts inside a corpus: an FM-index for each shard of the corpus, searched backwards.

Held-out items are few and do not grow with the corpus; their words form a small alphabet
that is sent to every task. A task turns its documents into words, keeps the stretches made
of alphabet words (no other word can be part of a match), and builds an FM-index over a
block of them: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix
for ranks, and suffix positions sampled along each stretch. Every run of eight words of every
item is then searched backwards at once, occurrences are located through the samples, and
the runs of a document and an item are chained in the item's order. A document and an item
are reported if the chained runs hold at least half of the item's words; the chained spans
are what is to be removed.

The corpus is read once and not shuffled; only reports leave a task, so repeated documents
and long ones cost what their words cost.

Letter case, accents' composition, punctuation, spacing, words broken at a line end, signs
between digits and the labels of options do not matter: labels are left out of an item, and
words of one letter are skipped on both sides but counted in the item's runs. Null and empty
texts hold nothing; an item without words is found nowhere. Repeated items are reported each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.lookalikes import one_form

RUN = 8
SHARE = 0.5
#: Words that one index holds; a longer document gets an index of its own.
BLOCK_WORDS = 1_000_000
#: Every so many positions of a stretch are sampled.
SAMPLE = 4

_WORD = re.compile(r"[^\W_]+")
_JOIN_DIGITS = re.compile(r"(?<=\d)[.,'’](?=\d)")
_JOIN_GROUPS = re.compile(r"(?<![\d.,])(\d{1,3})((?:\s{1,4}\d{3})+)(?!\d)")
_SPACES = re.compile(r"\s+")
_BROKEN = re.compile(r"([^\W\d_]+)-[ ]*\n\s*([^\W\d_]+)")
_LABEL = re.compile(r"(?m)^\s*\(?[A-Za-z1-9][.):]\s+")


def _prepared(text: str) -> str:
    t = _JOIN_DIGITS.sub("", one_form(text).lower())
    return _JOIN_GROUPS.sub(lambda m: m[1] + _SPACES.sub("", m[2]), t)


def _apart(text: str) -> str:
    """Words as written with apostrophes dropped."""
    return text.replace("'", "").replace("’", "")


def item_words(text: str) -> list[str]:
    """Words of an item without its option labels."""
    return _WORD.findall(_apart(_prepared(_LABEL.sub(" ", text))))


@dataclass
class Phrases:
    """All runs of the items as rows of word ids, right-aligned in ``codes`` with -1 before them."""

    vocabulary: dict[str, int]
    codes: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    kept_before: np.ndarray
    words_of: dict[int, int]
    shortest: int


def phrases_of(items: list[tuple[int, str]]) -> Phrases:
    vocabulary: dict[str, int] = {}
    rows, item_ids, starts, before, words_of = [], [], [], [], {}
    for item, text in items:
        words = item_words(text or "")
        words_of[item] = len(words)
        kept = [len(w) > 1 for w in words]
        index = np.concatenate([[0], np.cumsum(kept)]).astype(int)
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) if k else 0 for w, k in zip(words, kept, strict=True)]
        for i in range(len(words) - RUN + 1):
            if row := [x for x in ids[i : i + RUN] if x]:
                rows.append(row)
                item_ids.append(item)
                starts.append(i)
                before.append(index[i])
    codes = np.full((len(rows), RUN), -1, dtype=np.int64)
    for k, row in enumerate(rows):
        codes[k, RUN - len(row) :] = row
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    return Phrases(vocabulary, codes, lengths, np.array(item_ids, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(before, dtype=np.int64), words_of, int(lengths.min()) if rows else 1)


class FMIndex:
    """FM-index of stretches of word ids (1 and up), with samples so that no walk crosses a stretch's start."""

    def __init__(self, stretches: list[np.ndarray], alphabet: int):
        lengths = np.array([len(s) for s in stretches], dtype=np.int64)
        n = int(lengths.sum()) + len(stretches)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text = np.zeros(n, dtype=np.int64)
        for s, v in zip(self.starts, stretches, strict=True):
            text[s : s + len(v)] = v
        ends = self.starts + lengths
        # suffix array by prefix doubling; every end is a symbol of its own, below all words
        rank = text + len(stretches)
        rank[ends] = np.arange(len(stretches))
        width = 1
        order = np.argsort(rank, kind="stable")
        while True:
            sorted_rank = rank[order]
            first = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = first
            if first[-1] == n - 1:
                break
            second = np.zeros(n, dtype=np.int64)
            second[: n - width] = rank[width:] + 1
            # only the places that still share a rank are sorted again
            shared = np.zeros(n, dtype=bool)
            same = first[1:] == first[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            places = order[shared]
            rank *= n + 1
            rank[places] += second[places]
            order[shared] = places[np.argsort(rank[places], kind="stable")]
            width *= 2
        bwt = text[order - 1]
        bwt[order == 0] = 0
        # walks stop at samples: every SAMPLE-th place of a stretch, its start and its end
        offset = np.arange(n) - np.repeat(self.starts, lengths + 1)
        sampled_place = (offset % SAMPLE == 0) | (text == 0)
        self.sampled = sampled_place[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.levels = max(1, int(alphabet).bit_length())
        self.zeros, self.ranks, self.bits = [], [], []
        column = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (column >> level) & 1
            self.bits.append(bit.astype(bool))
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.n = n

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``end`` symbols of the transform."""
        start = np.zeros_like(end)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            r, z = self.ranks[k], self.zeros[k]
            ones_s, ones_e = r[start], r[end]
            start = np.where(bit == 1, z + ones_s, start - ones_s)
            end = np.where(bit == 1, z + ones_e, end - ones_e)
        return (end - start).astype(np.int64)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open intervals of suffixes that begin with each row of ``codes`` (-1 is no symbol)."""
        lo = np.zeros(len(codes), dtype=np.int64)
        hi = np.full(len(codes), self.n, dtype=np.int64)
        for j in range(codes.shape[1] - 1, -1, -1):
            live = np.flatnonzero((codes[:, j] > 0) & (hi > lo))
            if len(live):
                c = codes[live, j]
                lo[live] = self.counts[c] + self.rank(c, lo[live])
                hi[live] = self.counts[c] + self.rank(c, hi[live])
        return lo, hi

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The transform's symbol at each row, read down the wavelet matrix."""
        out = np.zeros(len(row), dtype=np.int64)
        for k in range(self.levels):
            bit = self.bits[k][row]
            ones = self.ranks[k][row]
            out = (out << 1) | bit
            row = np.where(bit, self.zeros[k] + ones, row - ones)
        return out

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes, by walking back to a sampled one."""
        rows = rows.astype(np.int64)
        place = np.full(len(rows), -1, dtype=np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            done = self.sampled[at]
            place[live[done]] = self.samples[self.sample_rank[at[done]]] + steps
            live, at = live[~done], at[~done]
            if len(live):
                c = self.symbol(at)
                at = self.counts[c] + self.rank(c, at)
                steps += 1
        return place


def chain(matches: list[tuple[int, int]], kept_before: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Words in the best chain of runs in the item's order, and the runs' (first word of document, windows).

    ``matches`` are (window of the item, word of the document). Neighbouring windows on one
    diagonal form a run of ``windows + RUN - 1`` words.
    """
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for i, p in sorted(set(matches)):
        diagonal = p - kept_before[i]
        r = open_.get(diagonal)
        if r is not None and i == r[1] + 1:
            r[1] = i
        else:
            r = [i, i, p, diagonal]
            open_[diagonal] = r
            runs.append(r)
    runs.sort(key=lambda r: (r[2], r[0], r[1]))
    # of the chains that end at each window so far, the best; a run takes its part after such a window in one step over the item
    windows = max(r[1] for r in runs) + 1
    best = np.full(windows, -1, dtype=np.int64)
    last = np.full(windows, -1, dtype=np.int64)
    at = np.arange(windows)
    links: list[int] = []
    gains: list[int] = []
    for k, (a, b, _, _) in enumerate(runs):
        gain, link = b + RUN - a, -1
        if b:
            joined = np.where(best[:b] < 0, -1, best[:b] + b + RUN - np.maximum(a, at[:b] + RUN))
            top = int(joined.argmax())
            if joined[top] > gain:
                gain, link = int(joined[top]), int(last[top])
        links.append(link)
        gains.append(gain)
        if gain > best[b]:
            best[b], last[b] = gain, k
    top = max(range(len(runs)), key=lambda k: gains[k])
    spans, k = [], top
    while k >= 0:
        spans.append((runs[k][2], runs[k][1] - runs[k][0] + 1))
        k = links[k]
    return gains[top], spans[::-1]


def _stretches(text: str, vocabulary: dict[str, int], shortest: int) -> list[tuple[int, list[int]]]:
    """(first word's place, word ids) of the stretches of alphabet words in a document."""
    t = _apart(_prepared(text))
    if "-" in t and "\n" in t:
        t = _BROKEN.sub(lambda m: m[1] + m[2] if m[1] + m[2] in vocabulary else m[0], t)
    get = vocabulary.get
    ids = [get(w, 0) for w in _WORD.findall(t) if len(w) > 1]
    out: list[tuple[int, list[int]]] = []
    a = np.array([0, *ids, 0], dtype=np.int64)
    edges = np.flatnonzero((a[1:] > 0) != (a[:-1] > 0))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - s >= shortest:
            out.append((s, ids[s:e]))
    return out


def _reports(block: list[tuple[int, int, list[int]]], ph: Phrases) -> pd.DataFrame:
    """Items found in one block of (document, first place, word ids)."""
    rows = []
    if block and len(ph.codes):
        fm = FMIndex([np.array(v, dtype=np.int64) for _, _, v in block], len(ph.vocabulary))
        lo, hi = fm.search(ph.codes)
        hit = np.flatnonzero(hi > lo)
        counts = (hi - lo)[hit]
        phrase = np.repeat(hit, counts)
        suffix = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        place = fm.locate(suffix)
        stretch = np.searchsorted(fm.starts, place, side="right") - 1
        docs = np.array([d for d, _, _ in block], dtype=np.int64)[stretch]
        word = place - fm.starts[stretch] + np.array([p for _, p, _ in block], dtype=np.int64)[stretch]
        frame = pd.DataFrame({"doc": docs, "item": ph.items[phrase], "window": ph.starts[phrase], "before": ph.kept_before[phrase], "word": word})
        # no chain has more words than RUN for every window matched
        windows = frame.groupby(["doc", "item"])["window"].transform("nunique")
        need = frame["item"].map(ph.words_of) * SHARE
        frame = frame[windows * RUN >= need]
        for (doc, item), g in frame.groupby(["doc", "item"]):
            words, spans = chain(list(zip(g["window"], g["word"], strict=True)), dict(zip(g["window"], g["before"], strict=True)))
            if words >= SHARE * ph.words_of[item]:
                rows.append((doc, item, words, ph.words_of[item], [f"{p}+{k + RUN - 1}" for p, k in spans]))
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "item_words", "spans"])


def _search(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    ph = shared.value
    block: list[tuple[int, int, list[int]]] = []
    size = 0
    for b in batches:
        for doc, text in zip(b["doc_id"], b["text"], strict=True):
            if not text:
                continue
            new = [(doc, p, v) for p, v in _stretches(text, ph.vocabulary, ph.shortest)]
            grown = sum(len(v) + 1 for _, _, v in new)
            if block and size + grown > BLOCK_WORDS:
                yield _reports(block, ph)
                block, size = [], 0
            block += new
            size += grown
    yield _reports(block, ph)


#: Items whose phrases one broadcast may hold.
SHARD_ITEMS = 20_000


def leaked_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "item_text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id, item_id, n_words, item_words, spans``: every document and item it repeats; spans are ``first word+words``.

    The items are counted before any is collected; beyond ``shard_items`` they are cut into
    shards by a hash of the item, each of which is searched in a pass of its own.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null")
    shards = wanted.count() // shard_items + 1
    parts = []
    for k in range(shards):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k).orderBy("item", "text").collect()
        shared = df.sparkSession.sparkContext.broadcast(phrases_of([(r[0], r[1]) for r in own]))
        parts.append(rows.mapInPandas(partial(_search, shared=shared), "doc_id long, item_id long, n_words long, item_words long, spans array<string>"))
    return reduce(DataFrame.unionByName, parts)
