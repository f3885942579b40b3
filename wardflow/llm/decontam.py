"""Benchmark decontamination: short test items inside long documents.

Items of one to four five-word shingles are contained whole or not at all, so the least shingle of
each is looked up among all shingles of a document: nothing is missed.

Larger items: containment search with MinHash over size partitions. Items are partitioned by their
number of shingles (classes 5..8, 9..16, 17..32, ...). For a class of up to L shingles a document is
cut into overlapping blocks of 2 L shingles, one every L, so that wherever an item of that class
stands, one block holds it whole and is at most a few times its size; their MinHash signatures then
agree often. An item that shares a signature value with a block is a candidate. A candidate is
verified exactly: the share of its shingles found anywhere in the whole document.

A signature value agrees with a probability of intersection / union of an item and a block. In one
block that is at least 1/4 for an item that stands there whole, and at least 0.8 / 4.2 for one with 0.8
of its shingles there (just over L / 2 shingles against 2 L). The chance to share none of HASHES values
is thus below 0.75 ** 64, one in 99 million, and below (1 - 0.8 / 4.2) ** 64, 1.4 in a million.

Items are a query set. They reach the tasks in blocks of at most `block_items` items and
`block_words` words; each block is one pass over all documents, so a broadcast never outgrows that
bound however many items there are.

Defined results: null texts count as empty; an item of fewer than five words has no shingle and is
in no document; equal items are reported each under its own item_id, and
repeated rows of either table as often as they stand; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame

from .common import map_lists, pick
from .shingles import mix, shingles

HASHES, CONTAINED = 64, 0.8
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 4_000_000
SMALLEST = 8
#: Shingles handled at a time, so that a very long text needs little memory.
CHUNK = 1 << 13
#: Each odd factor permutes the 64-bit numbers, which are mixed already.
_ODD = mix(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)


def size_class(n: int) -> int:
    """Largest number of shingles in the partition of an item with n."""
    return max(SMALLEST, 1 << (n - 1).bit_length())


def known_bits(values: np.ndarray) -> np.ndarray:
    """True at the low bits of the values: most other numbers need no search."""
    out = np.zeros(1 << max(16, (16 * len(values)).bit_length()), bool)
    out[values & np.uint64(len(out) - 1)] = True
    return out


class ItemIndex:
    """Lookup shingles of small items, signature values of others by size partition, and the shingles
    of all for the exact check."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.sets = [], []
        by_class: dict[int, list[int]] = {}
        small: list[int] = []
        for item_id, text in items:
            found = np.unique(shingles(text))
            if len(found):
                whole = len(found) * (1 - CONTAINED) < 1 - 1e-9  # one shingle less is not contained
                (small if whole else by_class.setdefault(size_class(len(found)), [])).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(found)
        keys = np.array([self.sets[r][0] for r in small], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.small = keys[order], np.array(small, int)[order], known_bits(keys)
        self.partitions = []
        for size, rows in sorted(by_class.items()):
            values = np.array([(self.sets[r] * _ODD[:, None]).min(axis=1) for r in rows])
            flat = values.ravel()
            order = np.argsort(flat, kind="stable")
            self.partitions.append((size, flat[order], np.repeat(rows, HASHES)[order], known_bits(flat)))

    def signatures(self, found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(partition, signature values of all its blocks), some thousands of shingles at a time.

        Least values of the smallest stretches are computed once; those of the larger ones follow,
        as sizes are powers of two.
        """
        if not self.partitions:
            return
        smallest, overlap = self.partitions[0][0], self.partitions[-1][0]
        step = max(CHUNK, overlap)  # so that every block starts at a multiple of its size
        for start in range(0, max(len(found) - overlap, 1), step):
            part = found[start : start + step + overlap]
            grid = np.append(part, np.repeat(part[-1:], -len(part) % smallest)).reshape(-1, smallest)
            least = grid[:, 0] * _ODD[:, None]
            other = np.empty_like(least)
            for j in range(1, smallest):
                np.minimum(least, np.multiply(grid[:, j], _ODD[:, None], out=other), out=least)
            reached = smallest
            for number, (size, *_) in enumerate(self.partitions):
                while reached < size:
                    if least.shape[1] % 2:
                        least = np.hstack([least, least[:, -1:]])
                    least, reached = np.minimum(least[:, ::2], least[:, 1::2]), 2 * reached
                yield number, (np.minimum(least[:, :-1], least[:, 1:]) if least.shape[1] > 1 else least).ravel()

    def search(self, text: str | None) -> list[tuple[int, float]]:
        """(item_id, containment) of the items that the text contains."""
        found = shingles(text)
        if not len(found):
            return []
        candidates: set[int] = set()

        def look_up(mine, values, rows, known):
            mine = np.unique(mine[known[mine & np.uint64(len(known) - 1)]])
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                candidates.update(rows[a:b].tolist())

        if len(self.small[0]):
            look_up(found, *self.small)
        for number, mine in self.signatures(found):
            look_up(mine, *self.partitions[number][1:])
        if not candidates:
            return []
        whole = np.unique(found)
        out = []
        for row in sorted(candidates):
            mine = self.sets[row]
            at = np.searchsorted(whole, mine)
            inside = np.count_nonzero(whole[np.minimum(at, len(whole) - 1)] == mine)
            if inside >= CONTAINED * len(mine) - 1e-9:
                out.append((self.ids[row], inside / len(mine)))
        return out


def item_blocks(items: DataFrame, block_items: int, block_words: int) -> Iterator[list[tuple]]:
    """Items in bounded blocks, fetched one partition at a time; the whole set never is in memory."""
    block, words = [], 0
    for row in pick(items, "item_id", "text").toLocalIterator():
        n = len(row["text"].split()) if row["text"] else 0
        if block and (len(block) >= block_items or words + n > block_words):
            yield block
            block, words = [], 0
        block.append((row["item_id"], row["text"]))
        words += n
    yield block


def leaks(
    docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, containment) for each item found in a document; no shuffle."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]

    def passed(block: list[tuple]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(block)
        ready: list[ItemIndex] = []

        def work(ids, texts):
            if not ready:
                ready.append(ItemIndex(shipped.value))
            out = [(i, *hit) for i, t in zip(ids, texts) for hit in ready[0].search(t)]
            return [*map(list, zip(*out))] if out else [[]] * 3

        schema = f"doc_id {kind}, item_id {item_kind}, containment double"
        return map_lists(pick(docs, "doc_id", "text"), schema, work)

    blocks = item_blocks(items, block_items, block_words)
    return reduce(DataFrame.unionAll, map(passed, blocks))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that contain no item, with all their columns; judged row by row, no shuffle."""
    spark, columns = docs.sparkSession, docs.columns
    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    at = columns.index("text")

    def passed(rest: DataFrame, block: list[tuple]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(block)
        ready: list[ItemIndex] = []

        def work(*lists):
            if not ready:
                ready.append(ItemIndex(shipped.value))
            keep = [not ready[0].search(t) for t in lists[at]]
            return [[v for v, k in zip(values, keep) if k] for values in lists]

        return map_lists(rest, schema, work)

    return reduce(passed, item_blocks(items, BLOCK_ITEMS, BLOCK_WORDS), docs)
