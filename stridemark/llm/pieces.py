"""Token counts by a linear longest-match automaton (greedy word pieces, no pieces built)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, table

#: Word counts that a task remembers; the memo starts anew beyond this.
MEMO = 400_000
#: Longer words are counted each time, so that the memo's bytes are bounded too.
MEMO_WORD = 64


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class LongestMatch:
    """Greedy longest-match-first lengths in one pass over a word, however long.

    A trie of the vocabulary, with pieces that may start a word under one root and the others
    (``continuation`` stripped) under a second. Each node has a failure link, to where the scan
    goes on after the pieces that are certain by then have been popped, and the number of those
    pieces. ``inner`` says whether the same pieces may stand anywhere (no continuation mark).
    """

    def __init__(self, pieces: Iterable[str], continuation: str = ""):
        self.kids: list[dict[str, int]] = [{}, {}]
        self.final = [False, False]
        self.start, self.inner = (0, 1) if continuation else (1, 1)
        for p in pieces:
            if not continuation:
                self._add(1, p)
            elif p.startswith(continuation) and len(p) > len(continuation):
                self._add(1, p[len(continuation) :])
            else:
                self._add(0, p)
        self._link()

    def _add(self, node: int, piece: str) -> None:
        for c in piece:
            node = self.kids[node].setdefault(c, len(self.kids))
            if node == len(self.kids):
                self.kids.append({})
                self.final.append(False)
        self.final[node] = True

    def _link(self) -> None:
        self.fail = [-1] * len(self.kids)
        self.pops = [0] * len(self.kids)
        level = [self.start, self.inner] if self.start != self.inner else [self.inner]
        while level:
            below = []
            for node in level:
                for c, kid in self.kids[node].items():
                    below.append(kid)
                    if self.final[kid]:  # the whole path is a piece: one pop, then on from the inner root
                        self.fail[kid], self.pops[kid] = self.inner, 1
                        continue
                    at, n = self.fail[node], self.pops[node]
                    while at >= 0 and c not in self.kids[at]:
                        n += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[kid], self.pops[kid] = self.kids[at][c], n
            level = below

    def count(self, word: str) -> int:
        """Number of pieces of a word; 1 (one unknown piece) where greedy matching gets stuck; 0 for ''."""
        kids, fail, pops = self.kids, self.fail, self.pops
        at, n = self.start, 0
        for c in word:
            while (to := kids[at].get(c)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at != self.inner and at != self.start:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


@lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> LongestMatch:
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    special = {t["content"] for t in read.get("added_tokens", ())}
    return LongestMatch(p for p in read["model"]["vocab"] if p not in special)


class Counts(dict):
    """Remembered piece counts of words given as bytes."""

    def __init__(self, automaton: LongestMatch, mark: str):
        super().__init__()
        self.automaton, self.mark, self.letters = automaton, mark, byte_letters()

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + "".join([self.letters[b] for b in word]))
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def token_counts(df: DataFrame, path: str, mark: str = "Ġ") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens of the whole text, for a byte-level vocabulary file.

    A word is a run without ASCII white space; it is matched as ``mark`` (how the vocabulary
    writes a word start) followed by its UTF-8 bytes. Every byte is a piece of such a
    vocabulary, so no word is unknown. A null or empty text has 0 words; rows that repeat are
    counted each; other columns are dropped; an empty table gives an empty table. One narrow
    pass, no shuffle; a task's memory is the automaton and a bounded memo.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counts = Counts(byte_vocabulary(path), mark)
        get = counts.__getitem__

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                w = text.split() if text else ()
                words.append(len(w))
                tokens.append(sum(map(get, w)))
            return pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

        return step

    return map_rows(df.selectExpr("doc_id", "cast(text as binary) as text"), make, "doc_id long, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
