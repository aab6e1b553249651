"""Byte-level BPE over a whole corpus, exact and in linear time.

Ids are found without replaying merges. Bytes are mapped to Latin-1, an Aho-Corasick
automaton over the whole vocabulary gives every token that lies at every place of a piece,
and the encoder goes from left to right with the longest token there. A token may follow
another only if merging the two byte strings would give exactly these two tokens; that test
is memoised by token pair. Where no token fits, the place is marked as a dead end and the
encoder steps back. A place is left dead at most once, so the time is linear in the length.

Pieces are cut by the tokenizer's own pattern and encoded once for each worker and spelling.
The vocabulary is a public file of bounded size: it is read once on the driver and broadcast.
An empty and a null text both give an empty list; a text that holds the spelling of a special
token is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the public pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Spellings that a worker remembers; beyond it the memory is emptied, which changes no id.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class PieceEncoder:
    """Ids of single pieces under the vocabulary ``ranks`` (token bytes to id, ids in merge order)."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.length = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.spelling = {i: t for t, i in ranks.items()}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one that no merge makes."""
        if token not in self.parts:
            t = self.spelling[token]
            found = None
            for cut in range(1, len(t)):
                a, b = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if a is not None and b is not None and a < token and b < token and self.adjacent(a, b, token):
                    found = (a, b)
                    break
            self.parts[token] = found
        return self.parts[token]

    def adjacent(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two, by merges below ``below``.

        Taken apart merge by merge from the last one backwards, no merge across the border
        may come earlier than the merge that closed one of its sides.
        """
        key = (left, right)
        if below is None and (known := self.fits.get(key)) is not None:
            return known
        limit, a, b, ok = (1 << 40) if below is None else below, left, right, True
        ranks, spelling = self.ranks, self.spelling
        while True:
            joined = ranks.get(spelling[a] + spelling[b])
            if joined is not None and joined < limit:
                ok = False
                break
            pa_, pb = self.halves(a), self.halves(b)
            if pa_ is None and pb is None:
                break
            # undo the later of the two closing merges; on equal ids the right one is later
            if pb is None or (pa_ is not None and a > b):
                limit, a = min(limit, a), pa_[1]
            else:
                limit, b = min(limit, b + 1), pb[0]
        if below is None:
            self.fits[key] = ok
        return ok

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece, longest token first, stepping back from dead ends."""
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        at: list[list[int]] = [[] for _ in range(n)]
        length = self.length
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            at[end + 1 - length[token]].append(token)  # at one start, later matches are longer
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        starts: list[int] = []
        choice: list[int] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while k >= 0:
                token = options[k]
                if open_[pos + length[token]] and (not out or self.adjacent(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                starts.append(pos)
                choice.append(k)
                pos += length[token]
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                open_[pos] = 0
                out.pop()
                pos = starts.pop()
                k = choice.pop() - 1
        return out


def _encode(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    import regex

    encoder, cut, memo = PieceEncoder(ranks.value), regex.compile(pattern).findall, {}
    encode = encoder.encode

    for batch in batches:
        ids: list[int] = []
        ends = [0]
        for text in batch.column(1).to_pylist():
            if text:
                for piece in cut(text):
                    known = memo.get(piece)
                    if known is None:
                        if len(memo) > REMEMBERED:
                            memo.clear()
                        known = memo[piece] = encode(piece)
                    ids += known
            ends.append(len(ids))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids`` for every row: one narrow pass, no shuffle."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, ranks=ranks, pattern=pattern), "doc_id long, ids array<int>")
