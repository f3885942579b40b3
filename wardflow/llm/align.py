"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes; A is a byte-level BPE file of `tokenizers`
(its vocabulary is run by `tiktoken`, which gives the same ids faster), B a `sentencepiece` model.
Every token points to its farthest-right overlapping token of the other kind, or to itself if none ends
farther on. Successors are doubled (`to = to[to]`) over all tokens of many texts at once until nothing
changes; then every token points to the last token of its component, which labels its group. Components
end where a token of A and one of B both end.

Corpus counts without a row per document and pair: a task packs texts into chunks of at most `CHARS`
characters (one text at least). A chunk row holds its distinct pairs with the number of its documents that
have them, its distinct groups as places in these pairs, and per document the groups it has. Pair counts are
summed over chunks, each chunk gets the totals of its own pairs back, and sums them up per document. What is
shuffled grows with the distinct pairs of chunks, not with the tokens.

Defined results: texts that are null, empty, or whose joined token bytes are not a space and the text, have
no tokens: zeros and an empty digest. Rows count as one document each, repeated ones and null ids too.
Special strings inside texts are ordinary text. Groups of any size count in full. Empty tables give no rows.
Groups are told apart within a chunk by a 64-bit hash of their tokens and places.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardflow.sources.layers import store

from .common import map_lists, pick
from .shingles import mix
from .tokens import WORDS, byte_letters

#: Characters of text in a chunk, rows handled at a time.
CHARS, ROWS = 1 << 21, 1024
#: Longer texts are encoded by the file's own library, whose splitter stands runs of spaces of any length.
LONG = 900_000
#: Groups of more pairs than this are summed up by their distinct tokens, one by one.
LARGE = 4096


class Tokenizers:
    """Both tokenizers, from the contents of their files, with the bytes of every token."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        data = json.loads(byte_level)
        kind = (data["normalizer"], data["pre_tokenizer"]["type"], data["pre_tokenizer"]["add_prefix_space"])
        if kind != (None, "ByteLevel", False) or data["model"]["type"] != "BPE":
            raise ValueError(f"not a plain byte-level BPE file: {kind}")
        of = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["content"] for t in data["added_tokens"]}
        vocabulary = {
            bytes(of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special
        }
        self.a = tiktoken.Encoding(
            "byte level", pat_str=WORDS, mergeable_ranks=vocabulary, special_tokens={}
        )
        self.patient = tokenizers.Tokenizer.from_buffer(byte_level)
        self.patient.encode_special_tokens = True
        self.a_bytes = table(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = np.array([self.piece(i) for i in range(self.b.get_piece_size())], object)
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)

    def piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def first(self, text: str) -> list[int]:
        if len(text) > LONG:
            return self.patient.encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both kinds per text, empty where a text has no tokens by definition."""
        given = [t or "" for t in texts]
        none = np.empty(0, np.int64)
        first, second = [], []
        for text, b in zip(given, self.b.encode(given, num_threads=1)):
            if text:
                wanted = b" " + text.encode()
                b = np.array(b, np.int64)
                if b"".join(self.b_bytes[b].tolist()) == wanted:
                    a = np.array(self.first(" " + text), np.int64)
                    if b"".join(self.a_bytes[a].tolist()) == wanted:
                        first.append(a)
                        second.append(b)
                        continue
            first.append(none)
            second.append(none)
        return first, second


def table(vocabulary: dict[bytes, int]) -> np.ndarray:
    out = np.full(max(vocabulary.values(), default=-1) + 1, b"", object)
    for token, i in vocabulary.items():
        out[i] = token
    return out


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token (first those of A, then those of B) the last token of its component.

    Both kinds cover the same bytes; ends ascend. A token points to the farthest-right token that overlaps
    it, itself included, of equal ends to that of B, and pointers are doubled until they stay.
    """
    n = len(a_ends)
    a_starts = np.concatenate([[0], a_ends[:-1]]) if n else a_ends
    b_starts = np.concatenate([[0], b_ends[:-1]]) if len(b_ends) else b_ends
    over_a = np.searchsorted(b_starts, a_ends) - 1
    over_b = np.searchsorted(a_starts, b_ends) - 1
    own = np.arange(n + len(b_ends))
    to = own.copy()
    to[:n] = np.where(b_ends[over_a] >= a_ends, over_a + n, own[:n])
    to[n:] = np.where(a_ends[over_b] > b_ends, over_b, own[n:])
    while True:
        farther = to[to]
        if (farther == to).all():
            return to
        to = farther


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - first, sizes)


class Chunk:
    """The alignment of the texts of one chunk."""

    def __init__(self, kinds: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]):
        self.kinds = kinds
        self.n_a = np.array([len(x) for x in a], np.int64)
        self.n_b = np.array([len(x) for x in b], np.int64)
        self.a = np.concatenate(a) if a else np.empty(0, np.int64)
        self.b = np.concatenate(b) if b else np.empty(0, np.int64)
        n = len(self.a)
        to = terminals(np.cumsum(kinds.a_lengths[self.a]), np.cumsum(kinds.b_lengths[self.b]))
        last = np.zeros(len(self.b), np.int64)
        last[to[n:] - n] = 1
        number = np.cumsum(last) - 1  # of the group whose last token of B stands here
        self.a_group, self.b_group = number[to[:n] - n], number[to[n:] - n]
        self.groups = int(last.sum())
        self.a_size = np.bincount(self.a_group, minlength=self.groups)
        self.b_size = np.bincount(self.b_group, minlength=self.groups)
        self.a_first = np.cumsum(self.a_size) - self.a_size
        self.b_first = np.cumsum(self.b_size) - self.b_size
        doc_of_b = np.repeat(np.arange(len(self.n_b)), self.n_b)
        self.doc = doc_of_b[self.b_first] if self.groups else np.empty(0, np.int64)
        self.n_groups = np.bincount(self.doc, minlength=len(self.n_b))
        links = np.zeros(len(self.n_b), np.int64)
        np.add.at(links, self.doc, self.a_size * self.b_size)
        self.n_links = links

    def texts(self, letters: dict[str, np.ndarray]) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` per document."""
        a_mark, b_mark = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_mark[self.a_first + self.a_size - 1] = 1
        b_mark[self.b_first + self.b_size - 1] = 2
        # groups follow each other, each with its tokens of A before those of B
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + self.b_first[self.a_group]] = letters["a"][self.a * 3 + a_mark]
        out[np.arange(len(self.b)) + (self.a_first + self.a_size)[self.b_group]] = letters["b"][self.b * 3 + b_mark]
        ends = np.cumsum(self.n_a + self.n_b)
        return [b"".join(out[e - k : e].tolist())[:-1] for e, k in zip(ends.tolist(), (self.n_a + self.n_b).tolist())]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct groups by their tokens, and one group of each."""
        code = np.zeros(self.groups, np.uint64)
        place_a = (np.arange(len(self.a)) - self.a_first[self.a_group]).astype(np.uint64)
        place_b = (np.arange(len(self.b)) - self.b_first[self.b_group]).astype(np.uint64)
        if self.groups:
            a = mix((self.a.astype(np.uint64) << np.uint64(33)) + (place_a << np.uint64(1)))
            b = mix((self.b.astype(np.uint64) << np.uint64(33)) + (place_b << np.uint64(1)) + np.uint64(1))
            code = mix(np.add.reduceat(a, self.a_first)) + np.add.reduceat(b, self.b_first)
        _, example, number = np.unique(code, return_index=True, return_inverse=True)
        return number, example

    def pairs(self, chosen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, times, number of pairs per group) of the chosen groups; a pair is a * size + b."""
        p, q = self.a_size[chosen], self.b_size[chosen]
        small = p * q <= LARGE
        of = chosen[small]
        tokens = ranges(self.a_first[of], self.a_size[of])
        each = np.repeat(self.b_size[of], self.a_size[of])
        partner = ranges(np.repeat(self.b_first[of], self.a_size[of]), each)
        codes = [np.repeat(self.a[tokens], each) * size + self.b[partner]]
        times, groups = [np.ones(len(partner), np.int64)], [np.repeat(np.flatnonzero(small), (p * q)[small])]
        for k in np.flatnonzero(~small).tolist():
            g = chosen[k]
            a, n_a = np.unique(self.a[self.a_first[g] :][: self.a_size[g]], return_counts=True)
            b, n_b = np.unique(self.b[self.b_first[g] :][: self.b_size[g]], return_counts=True)
            codes.append((a[:, None] * size + b).ravel())
            times.append((n_a[:, None] * n_b).ravel())
            groups.append(np.full(len(a) * len(b), k))
        code, n, group = map(np.concatenate, (codes, times, groups))
        order = np.argsort(group, kind="stable")
        return code[order], n[order], np.bincount(group, minlength=len(chosen))

    def packed(self, size: int) -> tuple[list, ...]:
        """Distinct pairs with their documents, distinct groups as places in them, documents as groups."""
        number, example = self.distinct()
        code, times, sizes = self.pairs(example, size)
        pairs, place = np.unique(code, return_inverse=True)
        first = np.cumsum(sizes) - sizes
        # distinct groups of each document, then its distinct pairs
        had, n = np.unique(self.doc * max(len(example), 1) + number, return_counts=True)
        doc, group = np.divmod(had, max(len(example), 1))
        held = np.repeat(doc, sizes[group]) * max(len(pairs), 1) + place[ranges(first[group], sizes[group])]
        freq = np.bincount(np.unique(held) % max(len(pairs), 1), minlength=len(pairs))
        per_doc = np.bincount(doc, minlength=len(self.n_a))
        return pairs, freq, sizes, place, times, per_doc, group, n


CHUNKED = (
    "chunk long, pairs array<long>, freq array<int>, group_sizes array<int>, group_pairs array<int>, "
    "group_times array<int>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "digests array<string>, doc_sizes array<int>, doc_groups array<int>, doc_times array<int>"
)


def _shipped(docs: DataFrame, byte_level: str, pieces: str):
    files = Path(byte_level).read_bytes(), Path(pieces).read_bytes()
    return docs.sparkSession.sparkContext.broadcast(files)


def _letters(kinds: Tokenizers) -> dict[str, np.ndarray]:
    def of(n):
        return np.array([f"{i}{mark}".encode() for i in range(n) for mark in (",", "|", ";")], object)

    return {"a": of(len(kinds.a_bytes)), "b": of(len(kinds.b_bytes))}


def chunks(docs: DataFrame, byte_level: str, pieces: str, chars: int = CHARS) -> DataFrame:
    """Packed chunks of documents (see the module), with the ids of their documents."""
    shipped = _shipped(docs, byte_level, pieces)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"{CHUNKED}, doc_ids array<{kind}>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, letters = Tokenizers(*shipped.value), None
        letters = _letters(kinds)
        number = TaskContext.get().partitionId() << 33
        ids, a, b, held = [], [], [], 0

        def row(number):
            chunk = Chunk(kinds, a, b)
            texts = chunk.texts(letters)
            digests = [hashlib.sha256(t).hexdigest() if n else "" for t, n in zip(texts, chunk.n_a)]
            del texts
            packed = chunk.packed(len(kinds.b_bytes))
            values = [
                number, *packed[:5], chunk.n_a, chunk.n_b, chunk.n_groups, chunk.n_links, digests, *packed[5:], ids
            ]
            columns = [pa.array([number], arrow[0].type)]
            columns += [
                pa.ListArray.from_arrays([0, len(v)], pa.array(v, f.type.value_type)) for v, f in zip(values[1:], list(arrow)[1:])
            ]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                doc_ids, texts = (c.to_pylist() for c in piece.columns)
                at = 0
                while at < len(texts):  # texts of at most 1 MB at a time, one at least
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end] or "") <= 1 << 20):
                        size += len(texts[end] or "")
                        end += 1
                    if ids and held + size > chars:
                        yield row(number)
                        number += 1
                        ids, a, b, held = [], [], [], 0
                    first, second = kinds.encode(texts[at:end])
                    ids += doc_ids[at:end]
                    a += first
                    b += second
                    held += size
                    at = end
        if ids:
            yield row(number)

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def pair_counts(packed: DataFrame, size: int) -> DataFrame:
    """(pair, count, is_best): documents that have the pair linked, and whether no pair of its A id has more."""
    each = packed.select(F.explode(F.arrays_zip("pairs", "freq")).alias("p")).select("p.pairs", "p.freq")
    counts = store(
        each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("freq").alias("count")), "pair_counts"
    )
    # at most one pair per id of B shares an id of A
    first = F.expr(f"pair div {size}")
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", first).join(most, "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("is_best")
    )


def align_statistics(docs: DataFrame, byte_level: str, pieces: str, chars: int = CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of documents."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    packed = store(chunks(docs, byte_level, pieces, chars), "aligned_chunks")
    kind = dict(docs.dtypes)["doc_id"]
    wanted = packed.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    totals = (
        wanted.join(pair_counts(packed, size), "pair")
        .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "count", "is_best"))).alias("t"))
        .select("chunk", F.col("t.count").alias("counts"), F.col("t.is_best").alias("bests"))
    )
    # a chunk without any pair has no totals
    joined = packed.drop("pairs", "freq").join(totals, "chunk", "left").select(
        "counts", "bests", "group_sizes", "group_pairs", "group_times", "doc_sizes", "doc_groups", "doc_times",
        "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests",
    )
    schema = (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string"
    )
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cells = [c[i].values for c in batch.columns]
                (counts, bests, sizes, places, times, per_doc, groups, n) = (
                    np.empty(0, np.int64) if c is None else c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cells[:8]
                )
                of = np.repeat(np.arange(len(sizes)), sizes)
                rated = []
                for value in (bests, counts):
                    by_group = np.zeros(len(sizes), np.int64)
                    np.add.at(by_group, of, times * value[places] if len(places) else times)
                    by_doc = np.zeros(len(per_doc), np.int64)
                    np.add.at(by_doc, np.repeat(np.arange(len(per_doc)), per_doc), n * by_group[groups] if len(groups) else n)
                    rated.append(pa.array(by_doc))
                ids, n_a, n_b, n_groups, n_links, digests = cells[8:]
                columns = [ids, n_a, n_b, n_groups, n_links, *rated, digests]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return joined.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, groups): per row the groups as `a1,a2|b1;a3|b2,b3`, empty without tokens."""
    shipped = _shipped(docs, byte_level, pieces)
    ready: list = []

    def work(ids, texts):
        if not ready:
            kinds = Tokenizers(*shipped.value)
            ready.extend([kinds, _letters(kinds)])
        chunk = Chunk(ready[0], *ready[0].encode(texts))
        return ids, [t.decode() for t in chunk.texts(ready[1])]

    kind = dict(docs.dtypes)["doc_id"]
    return map_lists(pick(docs, "doc_id", "text"), f"doc_id {kind}, groups string", work)
