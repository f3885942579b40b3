"""Near-duplicates by Order MinHash: sketches that keep the text order of sampled k-mers.

A text is its sequence of five-word shingles, each labelled with its occurrence number. One sketch
value is the `LEAST` smallest labelled shingles under a hash function, in text order; texts that
share one of `SKETCHES` values are candidates. A candidate pair is verified by an alignment in a
band: a = longest common subsequence of the two labelled sequences, similarity = a / (A + B - a).
Two values agree with a probability of about similarity ** LEAST, so a pair at 0.8 is missed about
once in a million; the bound is that of long texts, of 4 against 5 shingles 4 pairs in 100,000 are. Texts of one to three shingles, which are similar only to equal sequences, have one
value, hashed from the whole sequence.

No bucket emits all of its pairs. Each member is compared with the bucket's head, the member that
shares most buckets with others, which joins a group of near copies in one step. Members that stay
outside the head's class are held against the rest of the bucket with short values of all their
shingles: 16 bits of each for texts of up to SHORT shingles, 32 bits for longer ones. Shingles of one
text that share a value are counted as possible matches, so a pair never seems less alike than it is.
Only pairs whose values allow the threshold are emitted, each in the first bucket they share, and
verified. Classes are the connected components of the verified pairs.

Defined results: texts are equal copies when their characters are equal (null counts as empty), and
copies always share a class; texts of fewer than five words are alike only as copies. class_id is
the least doc_id of the class, null if its rows have none. Of rows repeated whole, one stays. Empty
tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.sources.layers import store

from .common import map_lists, pick
from .shingles import labelled, mix, shingles

SKETCHES, LEAST, SIMILAR = 20, 3, 0.8
#: Texts of up to so many shingles are held against each other by 16 bits of each, longer ones by 32.
SHORT = 1024
#: Shingles handled at a time, so that a very long text needs little memory.
CHUNK = 1 << 15
#: Each odd factor permutes the 64-bit numbers, which are mixed already.
_ODD = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketch(values: np.ndarray) -> list[int]:
    """Sketch values of a labelled sequence; none if it is empty."""
    if not len(values):
        return []
    if len(values) * (1 - SIMILAR) < SIMILAR - 1e-9:
        # one shingle more or less already takes the pair below the threshold: only equal sequences
        # are similar, of texts that differ in case, punctuation or spaces
        code = np.array([len(values)], np.uint64)
        for value in values:
            code = code * _STEP + value
        return mix(code).view(np.int64).tolist()
    best = np.empty((SKETCHES, 0), np.int64)
    for start in range(0, len(values), CHUNK):
        ranks = values[start : start + CHUNK] * _ODD[:, None]
        least = min(LEAST, ranks.shape[1])
        best = np.hstack([best, np.argpartition(ranks, least - 1, axis=1)[:, :least] + start])
    if best.shape[1] > LEAST:
        places = np.argpartition(values[best] * _ODD[:, None], LEAST - 1, axis=1)[:, :LEAST]
        best = np.take_along_axis(best, places, axis=1)
    code = _ODD.copy()
    for found in values[np.sort(best, axis=1)].T:  # in text order
        code = code * _STEP + found
    return mix(code).view(np.int64).tolist()


def distance(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Lower and upper bound of one minus the similarity; equal (exact) up to the threshold."""
    total, short, long = len(a) + len(b), min(len(a), len(b)), max(len(a), len(b))
    if short < SIMILAR * long or not short:
        return 1 - short / max(long, 1), 1.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    lower = 1 - len(i) / (total - len(i))
    if lower > 1 - SIMILAR + 1e-12:
        return lower, 1.0
    band = total - 2 * SIMILAR * total / (1 + SIMILAR) + 1  # farther off a match can't be used
    near = np.abs(i - j) <= band
    j = j[near][np.argsort(i[near])]
    if len(j) and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        common = len(tails)
    else:
        common = len(j)
    exact = 1 - common / (total - common)
    if exact > 1 - SIMILAR + 1e-12:
        return max(lower, 1 - SIMILAR + 1e-9), 1.0
    return exact, exact


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, values) per row: the text's key, number of shingles and sketch."""
    def work(ids, nodes, texts):
        n, values = [], []
        for t in texts:
            found = shingles(t)
            n.append(len(found))
            values.append(sketch(labelled(found)))
        return ids, nodes, n, values

    keyed = docs.select("doc_id", text_key().alias("node"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return map_lists(keyed, f"doc_id {kind}, node binary, n int, values array<bigint>", work)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, low, high) for pairs (a node, b its head's number) over texts (node, number, text)."""
    def work(a, b, left, right):
        out, last, known = [], None, None
        for x, y, s, t in zip(a, b, left, right):
            if t is not last and t != last:
                last, known = t, labelled(shingles(t))
            out.append((x, y, *distance(labelled(shingles(s)), known)))
        return [*map(list, zip(*out))] if out else [[]] * 4

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(
        F.col("number").alias("b_number"), F.col("node").alias("b"), F.col("text").alias("right")
    )
    joined = pairs.join(left, "a").join(right, "b_number").select("a", "b", "left", "right")
    return map_lists(joined, "a binary, b binary, low double, high double", work, rows=32)


def components(links: DataFrame, start: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes with a link.

    Every round takes the least label among neighbours and then the label of one's label, so long
    chains shrink quickly. Each round is a written table; only a count comes to the driver.

    `rounds` ends early, with labels that may still differ within a component; `start` goes on from
    such labels.
    """
    both = store(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "links",
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = labels.select("node", F.least("node", "least").alias("label"))
    if start is not None:
        known = start.select("node", F.col("label").alias("known"))
        labels = labels.join(known, "node", "left").select("node", F.least("label", "known").alias("label"))
    labels = store(labels, "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        seen = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("least"))
        lower = store(
            labels.join(seen, "node").select(
                "node", F.col("label").alias("before"), F.least("label", "least").alias("label")
            ),
            "labels",
        )
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = store(
            lower.join(jump, "label").select("node", "before", F.col("root").alias("label")), "labels"
        )
        labels = after.select("node", "label")
        rounds = rounds and rounds - 1
        if rounds == 0 or not after.filter("label != before").limit(1).count():
            return labels


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) and, per node, (node, class_id, label) of its class."""
    docs = pick(docs, "doc_id", "text")
    rows = store(sketched(docs), "sketches")
    nodes = store(
        rows.groupBy("node").agg(
            F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("values").alias("values")
        ).withColumn("number", F.xxhash64("node")),
        "nodes",
    )
    members = nodes.select("node", "number", "n", F.explode("values").alias("bucket"))
    shared = store(
        members.groupBy("bucket").agg(
            F.min("number").alias("least"), F.max("number").alias("most"), F.count(F.lit(1)).alias("size")
        ).filter("least != most").select("bucket", "size"),
        "buckets",
    )
    members = store(members.join(shared, "bucket"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = store(members.drop("size").join(weights, "node"), "weighed")
    heads = members.groupBy("bucket").agg(F.max(F.struct("weight", "number"))["number"].alias("head"))
    members = store(members.drop("weight").join(heads, "bucket"), "headed")
    pairs = store(
        members.filter("number != head").select(F.col("node").alias("a"), F.col("head").alias("b_number"))
        .distinct(),
        "pairs",
    )
    # one text for each node that shares a bucket with another
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", "first_doc", "number")
    keyed = docs.select(F.col("doc_id").alias("id"), text_key().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    texts = keyed.join(wanted, (keyed["node"] == wanted["node"]) & keyed["id"].eqNullSafe(wanted["first_doc"]))
    texts = store(once(texts.select(wanted["node"], "number", "text"), rows), "texts")
    compared = store(verify(pairs, texts), "compared")
    close = compared.filter(F.col("high") <= 1 - SIMILAR + 1e-12)
    # labels of two rounds spare most comparisons within a class; the rest do no harm
    labels = components(close, rounds=2)
    more = store(verify(left_pairs(members, nodes, texts, labels), texts), "compared_later")
    late = more.filter(F.col("high") <= 1 - SIMILAR + 1e-12)
    labels = components(close.unionByName(late), labels)

    grouped = (
        labels.join(nodes.select("node", "first_doc"), "node")
        .groupBy("label").agg(F.min("first_doc").alias("class_id"))
    )
    by_node = nodes.select("node", "first_doc").join(labels.join(grouped, "label"), "node", "left")
    by_node = by_node.select(
        "node", F.when(F.col("label").isNull(), F.col("first_doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("label", "node").alias("label"),
    )
    return rows.select("doc_id", "node"), by_node


def once(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """One text per node. Only nodes of rows that are there several times need looking at."""
    again = rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = store(again.select("node").distinct(), "again")
    if not again.limit(1).count():
        return texts
    single = texts.join(again, "node", "left_anti")
    several = texts.join(again, "node", "left_semi").groupBy("node").agg(F.first("number").alias("number"), F.first("text").alias("text"))
    return single.unionByName(several)


def values_of(texts: DataFrame) -> DataFrame:
    """(node, level, own_level, small, large): distinct short values of the labelled shingles.

    Level 0 holds 16 bits of each in `small`, level 1 32 bits in `large`. A pair is compared at the level of
    its longer text; a short text that may be alike to a long one has both.
    """
    def work(nodes, found):
        out = []
        for node, text in zip(nodes, found):
            numbers = labelled(shingles(text))
            own, last = int(len(numbers) > SHORT), int(len(numbers) / SIMILAR > SHORT)
            for level in range(own, last + 1):
                kind = (np.uint32, np.int32) if level else (np.uint16, np.int16)
                short = np.unique((numbers >> np.uint64(24)).astype(kind[0])).view(kind[1]).tolist()
                out.append((node, level, own, None if level else short, short if level else None))
        return [*map(list, zip(*out))] if out else [[]] * 5

    schema = "node binary, level int, own_level int, small array<smallint>, large array<int>"
    return map_lists(texts.select("node", "text"), schema, work, rows=32)


def left_pairs(members: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a bucket that the comparisons with its head leave open: members outside the head's
    class, against all members of other classes."""
    named = labels.select("node", "label")
    of_head = named.select(F.xxhash64("node").alias("head"), F.col("label").alias("head_label"))
    rows = members.join(named, "node", "left").join(of_head, "head", "left").select(
        "bucket", "node", "number", "n", F.coalesce("label", "node").alias("label"),
        F.coalesce(F.col("label") == F.col("head_label"), F.col("number") == F.col("head")).alias("inside"),
        (F.col("number") == F.col("head")).alias("is_head"),
    )
    rows = store(rows, "by_class")
    open_ = rows.filter("not inside").select("bucket").distinct()
    rows = store(rows.filter("not is_head").join(open_, "bucket", "left_semi"), "open")
    wanted = rows.select("node").distinct()
    short = store(values_of(texts.join(wanted, "node", "left_semi")), "short_values")
    short = short.join(nodes.select("node", "values"), "node")
    rows = store(rows.drop("is_head").join(short, "node"), "open_values")

    x = rows.filter("not inside").select("bucket", "level", *[
        F.col(c).alias(f"x_{c}") for c in ("node", "number", "n", "label", "own_level", "values", "small", "large")
    ])

    def size(prefix: str) -> Column:
        return F.when(F.col("level") == 0, F.size(f"{prefix}small")).otherwise(F.size(f"{prefix}large"))

    met = F.when(F.col("level") == 0, F.size(F.array_intersect("x_small", "small"))).otherwise(
        F.size(F.array_intersect("x_large", "large"))
    )
    # no common shingle is missed: at most so many have a value another shingle of the text has, too
    both = met + F.least(F.col("n") - size(""), F.col("x_n") - size("x_"))
    pairs = x.join(rows, ["bucket", "level"]).filter(
        (F.col("x_label") != F.col("label"))
        & (F.col("inside") | (F.col("x_number") < F.col("number")))
        & (F.greatest("own_level", "x_own_level") == F.col("level"))
        & (F.least("n", "x_n") >= F.greatest("n", "x_n") * SIMILAR - 1e-9)
        & (F.array_min(F.array_intersect("x_values", "values")) == F.col("bucket"))
        & (both >= SIMILAR * (F.col("n") + F.col("x_n") - both) - 1e-9)
    )
    return pairs.select(F.col("x_node").alias("a"), F.col("number").alias("b_number"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, is_first) per row of documents; is_first marks rows of the class's id."""
    rows, by_node = classes(docs)
    return rows.join(by_node, "node").select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class stays, with all its columns: that of the least doc_id and text key."""
    rows, by_node = classes(docs)
    named = rows.join(by_node, "node")
    keepers = store(
        named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k"))
        .select("k.doc_id", "k.node"),
        "keepers",
    )
    same = lambda a, b: (a["_node"] == b["node"]) & a["_id"].eqNullSafe(b["doc_id"])
    repeated = store(
        rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
        .select("doc_id", "node"),
        "repeated",
    )
    columns = docs.columns
    keyed = docs.withColumns({"_node": text_key(), "_id": F.col("doc_id")})
    kept = keyed.join(keepers, same(keyed, keepers), "left_semi")
    if not repeated.limit(1).count():
        return kept.select(*columns)
    once = kept.join(repeated, same(kept, repeated), "left_anti").select(*columns)
    twice = kept.join(repeated, same(kept, repeated), "left_semi")
    return once.unionByName(twice.dropDuplicates(["_node", "_id"]).select(*columns))
