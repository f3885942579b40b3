"""Token counts by byte-pair merging on a heap and a linked list, without emitting identifiers.

A word's count is its number of initial symbols (bytes) minus the merges made. The lowest-rank
adjacent pair is popped again and again; neighbours are kept as links, so a word of n bytes costs
n log n however long it is.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings of the file's
added tokens inside a text are one token each, as the library does by default; no truncation.
Repeated rows are counted one by one; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import json
from pathlib import Path

import regex
from pyspark.sql import DataFrame

from .common import map_lists, pick

# The pattern byte-level BPE splits words with.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Words whose count is remembered, per Python worker, and the longest such word.
REMEMBERED, REMEMBERED_CHARS = 300_000, 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return [letters[b] for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        after[i], after[j] = after[j], -1
        if after[i] >= 0:
            before[after[i]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (rank := ranks.get((symbols[x], symbols[y]))) is not None:
                heapq.heappush(heap, (rank, x, symbols[x], symbols[y]))
    return left


class Counts(dict):
    """Word -> number of tokens, filled as words are met."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.letters = ranks, byte_letters()

    def __missing__(self, word: str) -> int:
        n = merge_count([self.letters[b] for b in word.encode()], self.ranks)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts tokens of texts from the merges and added tokens of a vocabulary file."""

    def __init__(self, merges: list[str], special: list[str]):
        ranks = {tuple(m.split(" ")): i for i, m in enumerate(merges)}
        self.counts = Counts(ranks)
        self.words = regex.compile(WORDS)
        longest_first = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if special else None

    def __call__(self, text: str) -> int:
        if not self.special:
            return self.ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.ordinary, parts))

    def ordinary(self, text: str) -> int:
        count = self.counts.__getitem__
        if len(text) < 1 << 20:
            return sum(map(count, self.words.findall(text)))
        return sum(count(m[0]) for m in self.words.finditer(text))  # without a list of all words


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Merges in rank order ("left right") and special strings of a tokenizers file."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    merges = [m if isinstance(m, str) else " ".join(m) for m in data["model"]["merges"]]
    return merges, [t["content"] for t in data["added_tokens"]]


def count_tokens(
    docs: DataFrame, vocabulary_file: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row; one narrow pass, no shuffle.

    The driver reads the vocabulary file; its merges (tens of thousands, fixed by the file) are
    broadcast, so executors need no local copy.
    """
    merges, special = vocabulary(vocabulary_file)
    shipped = docs.sparkSession.sparkContext.broadcast(("\n".join(merges), special))
    ready: list[Counter] = []

    def work(ids, texts):
        if not ready:
            merged, marks = shipped.value
            ready.append(Counter(merged.split("\n"), marks))
        n_bytes = [len(t.encode()) if t else 0 for t in texts]
        n_tokens = [ready[0](t) if t else 0 for t in texts]
        return ids, n_bytes, n_tokens, [n > limit for n in n_tokens]

    kind = dict(docs.dtypes)[id]
    return map_lists(
        pick(docs, id, text), f"{id} {kind}, n_bytes long, n_tokens long, over_limit boolean", work
    )
