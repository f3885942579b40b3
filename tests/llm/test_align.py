import hashlib
from collections import Counter

import numpy as np
import pytest

from wardflow.llm import align
from wardflow.llm.queries import vocabulary_file

from .util import EMPTY, SMALL, docs, rows, table

FILES = (vocabulary_file(), vocabulary_file("piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def grouped(libraries, text):
    """Groups of one text, by the libraries and a plain walk over the offsets both kinds end at."""
    first, second = libraries
    if not text:
        return []
    letters = align.byte_letters()
    of = {c: b for b, c in enumerate(letters)}
    a = [(i, len([of[c] for c in first.id_to_token(i)])) for i in first.encode(" " + text, add_special_tokens=False).ids]
    joined = b"".join(bytes(of[c] for c in first.id_to_token(i)) for i, _ in a)
    b, other = [], b""
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()
        b.append((i, len(raw)))
        other += raw
    wanted = (" " + text).encode()
    if joined != wanted or other != wanted:
        return []
    ends = [set(np.cumsum([n for _, n in x]).tolist()) for x in (a, b)]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for side, tokens in enumerate((a, b)):
        at = group = 0
        for i, n in tokens:
            at += n
            while at > cuts[group]:
                group += 1
            out[group][side].append(i)
    return out


def expected(libraries, data):
    found = [(doc_id, grouped(libraries, text)) for doc_id, text in data]
    count = Counter()
    for _, groups in found:
        count.update({(a, b) for x, y in groups for a in x for b in y})
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc_id, groups in found:
        links = [(a, b) for x, y in groups for a in x for b in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


HARD = EMPTY + [
    (10, "The cat sat."), (11, "  two  spaces and\ttabs\n\n"), (12, "<|endoftext|> is <s> text </s>"), (13, "日本語のテキスト 🙂🙂"),
    (14, "x" * 3000), (15, "=" * 700 + " " + "-" * 333), (16, "naïve façade — déjà vu"), (17, "́́ a‍b"), (18, "ﬁ ligature"),
    (19, " lead"), (20, "a\x00b"), (21, "The cat sat."), (22, "ab " * 5000), (23, "١٢٣ 123"), (24, "﻿bom"), (25, "▁"), (25, "The dog"),
]


@pytest.mark.parametrize("clash", [False, True])
def test_hard_cases(spark, libraries, clash):
    got = align.align_statistics(docs(spark, HARD, clash), *FILES, chars=6000)
    assert got.columns == list(COLUMNS)
    assert rows(got) == expected(libraries, [(r[0], r[1]) for r in HARD])


def test_documents_by_definition(spark, libraries):
    data = [(r["doc_id"], r["text"]) for r in table(SMALL, "documents")]
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    assert rows(align.align_statistics(frame, *FILES, chars=100_000)) == expected(libraries, data)


def test_groups_themselves(spark, libraries):
    wanted = {
        (i, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped(libraries, t))) for i, t in HARD
    }
    assert {tuple(r) for r in align.align_tokens(docs(spark, HARD), *FILES).collect()} == wanted


def test_large_groups_count_by_distinct_tokens(monkeypatch, spark, libraries):
    monkeypatch.setattr(align, "LARGE", 1)
    kinds = align.Tokenizers(*(open(f, "rb").read() for f in FILES))
    texts = [t for _, t in HARD if t] + ["日本語" * 40]
    size = len(kinds.b_bytes)
    chunk = align.Chunk(kinds, *kinds.encode(texts))
    code, times, sizes = chunk.pairs(np.arange(chunk.groups), size)
    want = Counter(
        (a * size + b) for t in texts for x, y in grouped(libraries, t) for a in x for b in y
    )
    got = Counter()
    for c, n in zip(code.tolist(), times.tolist()):
        got[c] += n
    assert got == want and sizes.sum() == len(code)


def test_pointers_end_at_shared_ends():
    a, b = np.array([2, 3, 7, 9, 12]), np.array([1, 3, 5, 8, 9, 10, 12])
    assert align.terminals(a, b).tolist() == [6, 6, 9, 9, 11, 6, 6, 9, 9, 9, 11, 11]


def test_very_long_runs(libraries):
    kinds = align.Tokenizers(*(open(f, "rb").read() for f in FILES))
    texts = [" " * 1_200_000 + "x", "a" * 1_000_000, "word\n" * 200_000]
    for text, a in zip(texts, kinds.encode(texts)[0]):
        assert a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids or not len(a)


def test_empty(spark):
    assert align.align_statistics(docs(spark, []), *FILES).count() == 0
    assert rows(align.align_statistics(docs(spark, [(1, None)]), *FILES)) == [(1, 0, 0, 0, 0, 0, 0, "")]
