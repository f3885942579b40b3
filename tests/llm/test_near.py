import random
from itertools import combinations

import numpy as np

from wardflow.llm import near
from wardflow.llm.shingles import labelled, shingles

from .util import EMPTY, SMALL, docs, rows, table


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a, b):
    a, b = (labelled(shingles(t)).tolist() for t in (a, b))
    n = len(set(a) & set(b))
    if not n or n / (len(a) + len(b) - n) < near.SIMILAR:
        return 0.0  # a bound from the sets alone spares the table
    c = lcs(a, b)
    return c / (len(a) + len(b) - c)


def brute(made):
    """Least doc_id of each class: all pairs of texts, then components."""
    texts = sorted({t or "" for _, t in made})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in combinations(texts, 2):
        if similarity(a, b) >= near.SIMILAR - 1e-12:
            parent[root(a)] = root(b)
    least = {}
    for d, t in made:
        r = root(t or "")
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(map(str, ((d, least.get(root(t or ""))) for d, t in made)))


def found(df):
    return sorted(map(str, rows(near.near_duplicates(df), "doc_id", "class_id")))


def test_table(spark):
    made = [(r["doc_id"], r["text"]) for r in table(SMALL, "documents")]
    assert found(spark.read.parquet(f"{SMALL}/documents.parquet")) == brute(made)


def planted(seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    made, shared = [], text(60)
    for n in (4, 5, 8, 9, 20, 50, 90, 200, 600):
        base = text(n)
        made += [base, list(base)]
        for edits in (1, 1, 2, 3, 6, 12):
            copy = list(base)
            for _ in range(edits):
                at = draw.randrange(len(copy))
                copy[at : at + draw.choice((0, 1, 1))] = draw.choice(([], ["new"], ["new", "er"]))
                copy = copy or ["x"]
            made.append(copy)
    for _ in range(40):  # a shared passage alone makes no near copies
        made.append(text(30) + shared + text(30))
    chain = text(300)
    for i in range(12):  # every link is close, the ends are not
        chain = list(chain)
        chain[20 * i + 5] = f"step{i}"
        made.append(chain)
    line = "the same line again".split()
    made += [line * 30, line * 31, line * 60, line * 30 + text(5)]
    draw.shuffle(made)
    return [(i, " ".join(t)) for i, t in enumerate(made)]


def test_planted_classes(spark):
    made = planted()
    assert found(docs(spark, made)) == brute(made)


def test_short_texts_that_differ_in_case_and_punctuation(spark):
    draw = random.Random(4)
    made = []
    for n in (4, 5, 6, 7, 8):
        base = [f"w{draw.randrange(2000)}" for _ in range(n)]
        made += [" ".join(base), " ".join(base).upper(), ", ".join(base) + "!", "\n".join(base), " ".join(base[1:] + ["new"])]
    made += ["again and " * 3, "Again and " * 3 + "!", "again and " * 3 + "again", "", " \n"]
    made = [(i, t) for i, t in enumerate(made)]
    assert found(docs(spark, made)) == brute(made)
    kept = rows(near.keep_one(docs(spark, made)), "doc_id")
    assert len(kept) == len({r.class_id for r in near.near_duplicates(docs(spark, made)).collect()}) < len(made)


def test_leftover_pairs_of_a_bucket(spark, monkeypatch):
    """With one coarse sketch value most texts share a bucket, and the head settles few pairs."""
    made = planted(8)
    monkeypatch.setattr(near, "sketch", lambda values: [1, 2] if len(values) >= 4 else [])
    assert found(docs(spark, made)) == brute(made)


def test_distance_is_exact():
    draw = random.Random(2)
    for _ in range(300):
        a = np.array(draw.sample(range(400), draw.randrange(1, 60)), np.uint64)
        b = a.copy()
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(b))
            b = np.concatenate([b[:at], [np.uint64(1000 + draw.randrange(9))], b[at + draw.randrange(2) :]]).astype(np.uint64)
        b = np.unique(b)[np.argsort(np.unique(b, return_index=True)[1])]
        c = lcs(a.tolist(), b.tolist())
        true = 1 - c / (len(a) + len(b) - c)
        low, high = near.distance(a, b)
        assert low - 1e-9 <= true <= high + 1e-9
        assert (high <= 0.2 + 1e-9) == (true <= 0.2 + 1e-9) and (high == 1.0 or low == high)


def test_long_texts_sketch_in_chunks(monkeypatch):
    values = labelled(shingles(" ".join(f"w{i * 7919 % 5000}" for i in range(9000))))
    whole = near.sketch(values)
    monkeypatch.setattr(near, "CHUNK", 100)
    assert near.sketch(values) == whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r.node[0]: r.label[0] for r in near.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 203)}


def test_stage_keeps_one_of_each(spark):
    made = planted()
    kept = near.keep_one(docs(spark, made))
    classes = dict(rows(near.near_duplicates(docs(spark, made)), "doc_id", "class_id"))
    assert [r[0] for r in rows(kept, "doc_id")] == sorted(set(classes.values()))
    assert kept.columns == docs(spark, []).columns


def test_hard_cases(spark):
    made = EMPTY + [(None, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "other text of seven words it is"), (8, "é"), (9, "###"), (10, "###")]
    assert found(docs(spark, made, clash=True)) == brute(made)
    kept = rows(near.keep_one(docs(spark, made)), "doc_id", "text")
    assert kept == sorted(
        [(1, ""), (2, " \n\t "), (None, "only this"), (3, "é"), (7, "a b c d e f g"), (7, "other text of seven words it is"), (9, "###")],
        key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
    )
    alone = [(None, "same row twice"), (None, "same row twice"), (5, "five"), (5, "five")]
    assert rows(near.keep_one(docs(spark, alone)), "doc_id", "text") == [(None, "same row twice"), (5, "five")]
    assert near.near_duplicates(docs(spark, [])).count() == 0 == near.keep_one(docs(spark, [])).count()


def test_leftover_values_lose_no_pair(spark, monkeypatch):
    """50,000 pairs of nine shingles each, eight of them common: exactly at the threshold."""
    draw = random.Random(11)
    monkeypatch.setattr(near, "distance", lambda a, b: (0.0, 0.0))
    made, pairs = [], 50_000
    for i in range(pairs):
        base = [f"{draw.randrange(10**7)}" for _ in range(13)]
        made += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:12], "other"]))]
    frame = docs(spark, made).select("doc_id", near.text_key().alias("node"), "text")
    texts = near.store(frame.select("node", "text").withColumn("number", near.F.xxhash64("node")), "texts")
    nodes = near.store(frame.select("node", near.F.lit(9).alias("n"), near.F.array((near.F.col("doc_id") / 2).cast("long")).alias("values")), "nodes")
    members = nodes.select("node", near.F.xxhash64("node").alias("number"), "n", near.F.explode("values").alias("bucket"), near.F.lit(0).cast("long").alias("head"))
    labels = frame.select("node", near.F.col("node").alias("label"))
    # no member is the head or of its class, so every pair is decided by the short values
    found = near.left_pairs(near.store(members, "members"), nodes, texts, labels)
    assert found.distinct().count() == pairs


def test_long_texts_about_the_threshold(spark, monkeypatch):
    """Texts above SHORT shingles that only the leftover path can settle."""
    monkeypatch.setattr(near, "SHORT", 60)
    monkeypatch.setattr(near, "sketch", lambda values: [1, 2] if len(values) >= 4 else [])
    draw = random.Random(12)
    made = []
    for n in (60, 70, 78, 200):
        base = [f"w{draw.randrange(5000)}" for _ in range(n)]
        for edits in (0, 1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(n)] = f"x{draw.randrange(10**6)}"
            made.append(" ".join(copy))
    made = [(i, t) for i, t in enumerate(made)]
    assert found(docs(spark, made)) == brute(made)


def test_repeated_rows_are_one_text_per_node(spark):
    base = " ".join(f"w{i}" for i in range(40))
    made = [(1, base)] * 50 + [(2, base + " more")] * 30 + [(3, base)]
    frame = docs(spark, made).select("doc_id", "text")
    rows_ = frame.select("doc_id", near.text_key().alias("node"))
    texts = frame.select(near.text_key().alias("node"), near.F.lit(1).cast("long").alias("number"), "text")
    assert near.once(texts, rows_).count() == 2
    assert found(docs(spark, made)) == brute(made)
