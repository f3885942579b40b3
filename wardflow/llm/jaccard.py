"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct five-word shingles, as 64-bit hashes. Two documents link when their sets
have a Jaccard similarity of at least 0.8. The global order of the shingles is cut into fragments; a document
has a segment in each. What fragments count is summed up per document or pair:

1. Fragments count in how many texts each shingle stands. Shingles of one text only are common to no pair.
   A linked text shares all but a fifth of its shingles, so of its first n // 5 + 1 shingles in the order
   (texts that have it, hash) one at least is common to both: its prefix. A text whose prefix holds only
   shingles of its own is linked with nothing. This is done twice: first with the shingles whose hash lies in
   the lowest `LOW` (they come first in the order; a text with too few of them adds its next ones), over
   all texts, then with all shingles, over the few texts that are left. Both steps lose no link.
2. Texts that share a prefix shingle form a bucket. Each member is compared with the head of its bucket and
   components are taken. Pairs are compared by fragments: partial overlaps are counted where the segments
   of a head and its partners meet, and summed per pair.
3. Buckets that hold several components are settled exactly: members outside the largest one, in blocks of
   bounded size, against all members, by 16-bit values of their shingles, which never make an overlap
   smaller. Pairs of different components that may link are then compared by fragments as well. While
   buckets have many members outside, step 2 is repeated with other heads first, so that the rest is short.

No bucket puts out all its pairs, hot heads are salted, copies of a text are one node (128-bit key of the
text), and a task drops copies it has met.

Defined results: words are what lies between ASCII white space, A-Z in lower case. A text of fewer than five
words has one shingle, all of it; a text without words, or null, has none and is linked with nothing, copies
included. component_id is the least doc_id of the component, null ids aside; without shingles it is the
document's own id. Rows count as documents, repeated ones too. Empty tables give no rows. Two different
shingles of one comparison share a hash about once in 10^13 comparisons of texts of 1000 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardflow.sources.layers import store

from .common import pick
from .near import components, text_key
from .shingles import mix

K = 5
#: Share of the hashes that the first step reads.
LOW = 0.3
#: Shingles a fragment has about, and the least number of fragments, of step 1; fragments of a comparison.
SEGMENT, LEAST_FRAGMENTS, FRAGMENTS = 2_000_000, 64, 8
#: Shingles a task cuts at a time, partners of a head in one task, shingles of a block of outsiders.
PIECE, FAN, BLOCK = 500_000, 1024, 200_000
#: Further heads are tried while buckets have more members outside than this, by weight.
OUTSIDERS, ROUNDS = 256, 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Word -> 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_numbers = Numbers()


def grams(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; one of the whole sequence below five words."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    numbers = np.fromiter(map(_numbers.__getitem__, words), np.uint64, n)
    k = min(K, n)
    out = numbers[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        out *= _STEP
        out += numbers[i : n - k + 1 + i]
    return np.unique(mix(out))


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(text_key().alias("node"), "text")


SEGMENTS = "fragment int, nodes binary, owners binary, values binary"


def segments(texts: DataFrame, low: float, fragments: int) -> DataFrame:
    """Texts (node, text) cut into segments, packed: per piece and fragment the nodes and (owner, shingle).

    Rows of negative fragments hold the nodes' set sizes and numbers of shingles read instead. A text a
    task has met before is left out.
    """
    arrow = _schema(SEGMENTS)
    bound = np.uint64(min(int(low * 2**64), 2**64 - 1))
    edges = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)

    def cut(piece: int, nodes: list[bytes], sizes: list[int], kept: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.array(nodes, "S16")
        read = np.array([len(v) for v in kept], np.int64)
        rows = [(-1 - piece % fragments, b"".join(nodes), np.array(sizes, np.int64).tobytes(), read.tobytes())]
        flat, owner = np.concatenate(kept), np.repeat(np.arange(len(kept)), read)
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        cuts = [0, *np.searchsorted(flat, edges).tolist(), len(flat)]
        for f, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                there, place = np.unique(owner[a:b], return_inverse=True)
                rows.append((f, keys[there].tobytes(), place.astype(np.int32).tobytes(), flat[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        piece, held, nodes, sizes, kept = 0, 0, [], [], []
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                node = node.as_py()
                if node in seen:
                    continue
                seen.add(node)
                values = grams(text.as_py())
                nodes.append(node)
                sizes.append(len(values))
                if low < 1:
                    values = values[: max(int(np.searchsorted(values, bound)), len(values) // 5 + 1)]
                kept.append(values)
                held += len(values) + 16
                if held >= PIECE:
                    yield cut(piece, nodes, sizes, kept)
                    piece, held, nodes, sizes, kept = piece + 1, 0, [], [], []
        if nodes:
            yield cut(piece, nodes, sizes, kept)

    return texts.mapInArrow(run, SEGMENTS)


SHARED = "node binary, n long, n_read long, entries array<struct<texts:int,value:long>>"


def shared_shingles(packed: DataFrame) -> DataFrame:
    """Per fragment and node the shingles several nodes have, with their number of nodes; and node sizes."""
    arrow = _schema(SHARED)

    def keys_of(nodes: np.ndarray) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(nodes), [None, pa.py_buffer(nodes.tobytes())]).cast(pa.binary())

    def work(table: pa.Table) -> pa.Table:
        rows = list(zip(*[c.to_pylist() for c in table.columns]))
        nodes = np.concatenate([np.frombuffer(r[1], "S16") for r in rows])
        if rows[0][0] < 0:
            sizes, read = (np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in (2, 3))
            nothing = pa.nulls(len(nodes), arrow[3].type)
            return pa.table([keys_of(nodes), pa.array(sizes), pa.array(read), nothing], schema=arrow)
        keys, number = np.unique(nodes, return_inverse=True)
        first = np.cumsum([0, *[len(r[1]) // 16 for r in rows]])
        owner = number[np.concatenate([np.frombuffer(r[2], np.int32) + a for r, a in zip(rows, first)])]
        value = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows])
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[fresh], owner[fresh]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        runs = np.diff(np.append(starts, len(value)))
        texts = np.repeat(runs, runs)
        several = texts > 1
        value, owner, texts = value[several], owner[several], texts[several]
        order = np.argsort(owner, kind="stable")
        value, owner, texts = value[order], owner[order], texts[order]
        there, begin = np.unique(owner, return_index=True)
        entry = pa.StructArray.from_arrays(
            [pa.array(texts.astype(np.int32)), pa.array(value.view(np.int64))], fields=list(arrow[3].type.value_type)
        )
        offsets = pa.array(np.append(begin, len(owner)).astype(np.int32))
        entries = pa.ListArray.from_arrays(offsets, entry)
        none = pa.nulls(len(there), pa.int64())
        return pa.table([keys_of(keys[there]), none, none, entries.cast(arrow[3].type)], schema=arrow)

    return packed.groupBy("fragment").applyInArrow(work, SHARED)


def prefixes(texts: DataFrame, chars: int, low: float) -> DataFrame:
    """(node, n, buckets): the shared shingles of each text's prefix; none if it can't be linked."""
    fragments = max(LEAST_FRAGMENTS, chars // 6 // SEGMENT)
    found = store(shared_shingles(segments(texts, low, fragments)), "shared")
    # the nodes of a fragment put out their entries once, so that a node has as many as fragments
    whole = found.groupBy("node").agg(
        F.max("n").alias("n"), F.max("n_read").alias("n_read"), F.flatten(F.collect_list("entries")).alias("entries")
    )
    own = F.col("n_read") - F.size("entries")
    left = F.expr("n div 5") + 1 - own
    first = F.slice(F.sort_array("entries"), F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
    return store(whole.select("node", "n", first["value"].alias("buckets")), "prefixes")


def gram_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, values): the sorted hashes of the wanted nodes, packed."""
    arrow = _schema("node binary, n long, values binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                nodes, texts = (c.to_pylist() for c in batch.slice(start, 128).columns)
                sets = [grams(t) for t in texts]
                rows = [nodes, [len(s) for s in sets], [s.tobytes() for s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

    texts = _keyed(docs).join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "node binary, n long, values binary")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, union_size) of distinct pairs: overlaps counted by fragment and summed per pair."""
    fans = pairs.groupBy("b").agg((F.count(F.lit(1)) / FAN + 1).cast("long").alias("salts"))
    fans = store(fans, "fans")
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("size"), "values")
    partners = pairs.join(fans, "b").join(left, "a").select(
        F.col("b").alias("head"), F.pmod(F.xxhash64("a"), "salts").alias("salt"), F.lit(True).alias("partner"),
        F.col("a").alias("node"), "size", "values",
    )
    heads = fans.join(sets.withColumnRenamed("node", "b"), "b").select(
        F.col("b").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(False).alias("partner"), F.col("b").alias("node"), F.col("n").alias("size"), "values",
    )
    cut_ddl = "head binary, salt long, fragment int, partner boolean, node binary, size long, segment binary"
    cut_arrow = _schema(cut_ddl)
    edges = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for head, salt, partner, node, size, values in zip(*[c.to_pylist() for c in batch.slice(start, 64).columns]):
                    whole = np.frombuffer(values, np.uint64)
                    cuts = [0, *np.searchsorted(whole, edges).tolist(), len(whole)]
                    out += [
                        (head, salt, f, partner, node, size, values[8 * x : 8 * y])
                        for f, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y
                    ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), cut_arrow)], schema=cut_arrow)

    met_ddl = "a binary, b binary, size long, head_size long, common long"
    met_arrow = _schema(met_ddl)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, mine_size = None, None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                out = []
                for head, salt, fragment, partner, node, size, segment in zip(*[c.to_pylist() for c in batch.slice(start, 1024).columns]):
                    values = np.frombuffer(segment, np.uint64)
                    if not partner:
                        at, mine, mine_size = (head, salt, fragment), values, size
                    elif at == (head, salt, fragment):
                        place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                        common = int(np.count_nonzero(mine[place] == values))
                        if common:
                            out.append((node, head, size, mine_size, common))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), met_arrow)], schema=met_arrow)

    met = (
        partners.unionByName(heads).mapInArrow(cut, cut_ddl)
        .repartition("head", "salt", "fragment").sortWithinPartitions("head", "salt", "fragment", "partner")
        .mapInArrow(meet, met_ddl)
    )
    total = met.groupBy("a", "b").agg(
        F.sum("common").alias("common"), F.first("size").alias("size"), F.first("head_size").alias("head_size")
    )
    return total.select("a", "b", "common", (F.col("size") + F.col("head_size") - F.col("common")).alias("union_size"))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    similar = F.col("common") * 5 >= F.col("union_size") * 4
    return store(compare(pairs, sets).filter(similar).select("a", "b"), "links")


def star_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Members (bucket, node, n, label) against the head of their bucket in another component, once each.

    The first heads are the nodes of most buckets, so that similar buckets have the same one; later ones are
    drawn by hash.
    """
    if seed:
        ranked = members.withColumn("rank", F.struct(F.xxhash64("node", F.lit(seed)).alias("drawn")))
    else:
        weights = members.groupBy("node").agg((-F.count(F.lit(1))).alias("weight"))
        ranked = members.join(weights, "node").withColumn("rank", F.struct("weight", F.xxhash64("node").alias("drawn")))
    head = F.struct(F.col("node").alias("b"), F.col("n").alias("head_n"), F.col("label").alias("head_label"))
    heads = ranked.groupBy("bucket").agg(F.min_by(head, "rank").alias("h")).select("bucket", "h.*")
    near = F.least("n", "head_n") * 5 >= F.greatest("n", "head_n") * 4
    met = members.join(heads, "bucket").filter((F.col("label") != F.col("head_label")) & near)
    return met.select(F.col("node").alias("a"), "b").distinct()


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    named = members.join(labels, "node", "left")
    return named.select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))


def open_buckets(members: DataFrame) -> DataFrame:
    """(bucket, main, total, outside, weight) of buckets with several components, one of those with equal members."""
    parts = members.groupBy("bucket", "label").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit("again"), "node")).alias("y"),
    )
    whole = parts.groupBy("bucket").agg(
        F.max_by(F.struct("label", "c", "w"), "c").alias("m"), F.sum("c").alias("total"), F.sum("w").alias("weight"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
    ).filter("m.c < total")
    once = whole.groupBy("x", "y", "total").agg(F.min_by(F.struct("bucket", "m", "weight"), "bucket").alias("s"))
    return once.select(
        "s.bucket", F.col("s.m.label").alias("main"), "total", (F.col("total") - F.col("s.m.c")).alias("outside"),
        (F.col("s.weight") - F.col("s.m.w")).alias("weight"),
    )


def left_pairs(members: DataFrame, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components in open buckets whose 16-bit values allow a link.

    Outsiders of a bucket are dealt to blocks of about BLOCK shingles; each block meets all members.
    """
    arrow = _schema("node binary, bits binary")

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, values = (c.to_pylist() for c in batch.columns)
            bits = [np.sort(np.frombuffer(v, np.uint64).astype(np.uint16)).tobytes() for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(bits, pa.binary())], schema=arrow)

    rows = members.join(open_, "bucket").withColumn("outsider", F.col("label") != F.col("main"))
    bits = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "values")
    rows = rows.withColumn("blocks", (F.col("weight") / BLOCK + 1).cast("long"))
    common = ["bucket", "node", "n", "label", "outsider"]
    block = rows.filter("outsider").select(
        *common, F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.lit(False).alias("asks")
    )
    against = rows.select(
        *common, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks")
    )
    ready = block.unionByName(against).join(bits.mapInArrow(fingerprints, "node binary, bits binary"), "node")
    ready = ready.select("bucket", "block", "asks", "node", "n", "label", "outsider", "bits")
    out_arrow = _schema("a binary, b binary")

    def codes(bits: bytes) -> np.ndarray:
        """Values with the number of their earlier occurrences, so that equal ones count as often as they stand."""
        values = np.frombuffer(bits, np.uint16).astype(np.int64)
        first = np.searchsorted(values, values)
        return np.sort(values + ((np.arange(len(values)) - first) << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                out = []
                for bucket, block, asks, node, n, label, outsider, bits in zip(*[c.to_pylist() for c in batch.slice(start, 1024).columns]):
                    if at != (bucket, block):
                        at, held, index = (bucket, block), [], None
                    if not asks:
                        held.append((node, n, label, codes(bits)))
                        continue
                    if not held:
                        continue
                    if index is None:
                        flat = np.concatenate([h[3] for h in held])
                        owner = np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], owner[order], np.array([h[1] for h in held])
                    flat, owner, sizes = index
                    mine = codes(bits)
                    a, b = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
                    k = b - a
                    place = np.arange(int(k.sum())) + np.repeat(a - (np.cumsum(k) - k), k)
                    both = np.bincount(owner[place], minlength=len(held))
                    for i in np.flatnonzero(5 * both >= 4 * (sizes + n - both)).tolist():
                        other, _, other_label, _ = held[i]
                        if other_label != label and not (outsider and other >= node):
                            out.append((other, node))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_arrow)], schema=out_arrow)

    return (
        ready.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")
        .mapInArrow(run, "a binary, b binary").distinct()
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of documents."""
    docs = pick(docs, "doc_id", "text")
    rows = store(
        docs.select("doc_id", text_key().alias("node"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")), "rows"
    )
    chars = rows.agg(F.sum("chars")).first()[0] or 0
    nodes = prefixes(_keyed(docs), chars, LOW)
    linked = component_labels(docs, nodes, chars)

    first = rows.groupBy("node").agg(F.min("doc_id").alias("first_doc"))
    named = nodes.select("node", "n").join(first, "node").join(linked, "node", "left")
    named = store(named.withColumn("label", F.coalesce("label", "node")), "named")
    least = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_node = named.join(least, "label").select("node", F.col("n").alias("n_shingles"), "component_id")
    return rows.join(by_node, "node").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def component_labels(docs: DataFrame, nodes: DataFrame, chars: int) -> DataFrame:
    """(node, label) of the nodes with links."""
    left = nodes.filter(F.size("buckets") > 0).select("node")
    again = prefixes(_keyed(docs).join(left, "node", "left_semi"), chars, 1.0)
    each = again.select(F.explode("buckets").alias("bucket"), "node", "n")
    several = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    members = store(each.join(several, "bucket", "left_semi"), "members")
    sets = store(gram_sets(docs, members.select("node").distinct()), "sets")

    found = links(star_pairs(labelled(members, None), 0), sets)
    labels = components(found)
    for seed in range(1, ROUNDS):
        named = store(labelled(members, labels), "labelled")
        open_ = store(open_buckets(named), "open")
        work, total = open_.agg(F.sum(F.col("outside") * F.col("total")), F.sum("total")).first()
        if not work:
            return labels
        if work <= OUTSIDERS * total or seed == ROUNDS - 1:
            break
        held = named.join(open_.select("bucket"), "bucket", "left_semi")
        found = found.unionByName(links(star_pairs(held, seed), sets))
        labels = components(found)
    late = links(left_pairs(named, open_, sets), sets)
    return components(found.unionByName(late))
