import random

import pytest

from wardflow.llm import decontam
from wardflow.llm.shingles import shingles

from .util import EMPTY, SMALL, docs, rows, table

ITEMS = "item_id long, text string"


def brute(documents, items):
    out = set()
    for d, text in documents:
        mine = set(shingles(text).tolist())
        for i, item in items:
            s = set(shingles(item).tolist())
            if s and len(s & mine) >= 0.8 * len(s) - 1e-9:
                out.add((d, i, len(s & mine) / len(s)))
    return out


def test_table(spark):
    d = [(r["doc_id"], r["text"]) for r in table(SMALL, "documents")]
    b = [(r["item_id"], r["text"]) for r in table(SMALL, "benchmark")]
    got = decontam.leaks(*(spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark")))
    assert set(rows(got)) == brute(d, b) != set()


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 6, 9, 12, 13, 20, 33, 60, 100, 300, 700])]
    made = []
    for i, (_, item) in enumerate(items):
        for lead in (0, 3, 40, 3000):
            body = item.split()
            if lead == 40 and len(body) > 30:
                body[len(body) // 2] = "changed"
            made.append((1000 + 10 * i + lead % 7, text(lead) + " " + " ".join(body).upper() + "! " + text(lead * 2)))
    made += [(9000 + i, text(2000)) for i in range(20)] + [(9500, items[8][1][: len(items[8][1]) // 2])]
    return made, items


def test_planted_items(spark, planted):
    made, items = planted
    got = decontam.leaks(docs(spark, made), spark.createDataFrame(items, ITEMS))
    want = brute(made, items)
    assert set(rows(got)) == want and len({i for _, i, _ in want}) == len(items)


def test_small_items_in_any_context():
    """An item of 5 to 8 words at the edge of a long document, or inside it, in many contexts."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(n, text(n)) for n in (5, 6, 7, 8, 9)] + [(50, "w1 w2 w3 w4 w5"), (51, "w1 w2 w3 w4 w5")]
    index = decontam.ItemIndex(items)
    for n, item in items[:6]:
        equal = {i for i, t in items if t == item}
        for lead in (0, 37):
            for _ in range(400):
                got = index.search(f"{text(lead)} {item} {text(60)}")
                assert {i for i, share in got if share == 1.0} >= equal, (n, lead)
    assert index.search(items[3][1].rsplit(" ", 1)[0]) == []  # three of four shingles
    assert decontam.ItemIndex([(1, "a b c d")]).search(text(50)) == []


def test_item_blocks_change_nothing(spark, planted):
    made, items = planted
    df, b = docs(spark, made), spark.createDataFrame(items, ITEMS)
    assert rows(decontam.leaks(df, b, block_items=2)) == rows(decontam.leaks(df, b, block_words=50)) == rows(decontam.leaks(df, b))


def test_stage_keeps_clean_documents(spark, planted):
    made, items = planted
    kept = decontam.without_leaks(docs(spark, made), spark.createDataFrame(items, ITEMS))
    dirty = {d for d, _, _ in brute(made, items)}
    assert {r[0] for r in rows(kept, "doc_id")} == {d for d, _ in made} - dirty
    assert kept.columns == docs(spark, []).columns


def test_hard_cases(spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "a b"), (4, None), (None, "q r s t u")], ITEMS)
    df = docs(spark, EMPTY + [(8, "x A, b c d\ne f"), (8, "x A, b c d\ne f"), (9, "q r s t u " * 100_000)], clash=True)
    got = sorted(map(str, rows(decontam.leaks(df, items), "doc_id", "item_id")))
    assert got == sorted(map(str, [(8, 1)] * 4 + [(8, 2)] * 2 + [(9, None)]))
    assert decontam.leaks(docs(spark, []), items).count() == 0
    assert decontam.leaks(df, items.limit(0)).count() == 0
    assert decontam.without_leaks(docs(spark, EMPTY), items.limit(0)).count() == len(EMPTY)
