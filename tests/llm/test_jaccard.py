import random
import re

import pytest

from wardflow.llm import jaccard

from .util import EMPTY, SMALL, docs, rows, table


def gram_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(data):
    """(doc_id, n_shingles, component_id), by comparing all pairs that share a shingle."""
    sets = [gram_set(t) for _, t in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = {}
    for i, s in enumerate(sets):
        for g in s:
            having.setdefault(g, []).append(i)
    tried = set()
    for found in having.values():
        for k, i in enumerate(found):
            for j in found[:k]:
                if (j, i) not in tried:
                    tried.add((j, i))
                    if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(data):
        r = root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    out = [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets))]
    return sorted(out, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def text(draw, n, words=20_000):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def edited(draw, source, share):
    words = source.split(" ")
    for i in range(len(words)):
        if draw.random() < share:
            words[i] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def planted(seed):
    """Copies, near copies about the threshold, shared passages, short and nested texts."""
    draw = random.Random(seed)
    out = list(EMPTY)
    for _ in range(12):
        source = text(draw, draw.choice([5, 6, 9, 13, 30, 80, 300]))
        out += [(len(out) + 100, edited(draw, source, share)) for share in (0, 0, 0.004, 0.01, 0.02, 0.03, 0.05)]
        out.append((len(out) + 100, source.upper().replace(" ", "\n\t")))
    passage = text(draw, 60)
    out += [(len(out) + 100 + i, text(draw, 40) + " " + passage + " " + text(draw, draw.randrange(20))) for i in range(40)]
    out += [(900 + i, passage + " " + text(draw, draw.randrange(16))) for i in range(30)]
    out += [(1000, "One two"), (1001, "one  TWO"), (1002, "one two three"), (1003, "É é"), (1004, "é É"), (1005, "a b c d e"), (1006, "A b\x0bc d E")]
    out += [(None, out[10][1]), out[12], out[12], (2000, "same " * 500), (1999, "same " * 9), (2001, text(draw, 30_000))]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("clash", [False, True])
def test_planted(spark, seed, clash):
    data = planted(seed)
    assert rows(jaccard.jaccard_components(docs(spark, data, clash))) == expected(data)


def test_variants_about_the_threshold(spark, monkeypatch):
    """Hundreds of variants of one text, most pairs of which lie just below or above the threshold."""
    monkeypatch.setattr(jaccard, "OUTSIDERS", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    monkeypatch.setattr(jaccard, "FAN", 16)
    monkeypatch.setattr(jaccard, "PIECE", 2000)
    draw = random.Random(3)
    source = text(draw, 150)
    data = [(i, edited(draw, source, 0.02)) for i in range(220)] + [(500 + i, text(draw, 100)) for i in range(50)]
    got = expected(data)
    assert 20 < len({r[2] for r in got}) < 250
    assert rows(jaccard.jaccard_components(docs(spark, data))) == got


def test_last_step_alone_finds_all_links(spark, monkeypatch):
    """Without any star comparison the blocks of outsiders still give every link."""
    draw = random.Random(5)
    source = text(draw, 60)
    data = [(i, edited(draw, source, 0.03)) for i in range(80)]
    monkeypatch.setattr(jaccard, "star_pairs", lambda members, seed: members.select(
        members["node"].alias("a"), members["node"].alias("b")).distinct())
    assert rows(jaccard.jaccard_components(docs(spark, data))) == expected(data)


def test_overlaps_are_exact(spark):
    draw = random.Random(8)
    source = text(draw, 700)
    data = [(i, edited(draw, source, 0.01 * i)) for i in range(9)]
    frame = docs(spark, data)
    nodes = jaccard._keyed(frame).distinct()
    sets = jaccard.gram_sets(frame, nodes)
    keys = {bytes(r["node"]): gram_set(r["text"]) for r in nodes.collect()}
    head = min(keys)
    pairs = nodes.select("node").filter(nodes["node"] != head).selectExpr("node AS a").crossJoin(
        spark.createDataFrame([(head,)], "b binary"))
    for r in jaccard.compare(pairs, sets).collect():
        a, b = keys[bytes(r["a"])], keys[bytes(r["b"])]
        assert (r["common"], r["union_size"]) == (len(a & b), len(a | b))


def test_documents_by_brute_force(spark):
    data = [(r["doc_id"], r["text"]) for r in table(SMALL, "documents")]
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows(jaccard.jaccard_components(frame)) == expected(data)


def test_grams():
    assert len(jaccard.grams("a b c d e f")) == 2 and len(jaccard.grams("A b")) == 1 and not len(jaccard.grams(None))
    assert (jaccard.grams("a b") != jaccard.grams("a b c")[: 1]).all()
    assert jaccard.grams("\u212a")[0] != jaccard.grams("k")[0] == jaccard.grams("K")[0]  # only A-Z are lower-cased


def test_empty(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    assert rows(jaccard.jaccard_components(docs(spark, [(4, None), (4, " ")]))) == [(4, 0, 4), (4, 0, 4)]
