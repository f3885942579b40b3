"""The pipeline against its stages' own brute force, and the registered queries against their SQL."""

import warnings
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import check
from wardflow.llm import mixing, oracle, quality, queries, secrets

from . import test_decontam, test_near, test_secrets
from .util import SMALL, docs, rows, table


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_and_sql(spark, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = check(spark, SMALL, name, oracle.SQL[name], queries.QUERIES)
    assert result.startswith("ok"), result


def test_registered():
    names = contract.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def brute(documents, items):
    """(doc_id, text) of the mix, by loops."""
    kept = [(d, quality.judge(t)[-1], s) for d, t, s in documents if quality.judge(t)[-2]]
    by_text = test_near.brute([(d, t) for d, t, _ in kept])
    stay = {d for d, c in map(eval, by_text) if d == c}
    kept = [r for r in kept if r[0] in stay]
    leaked = {d for d, _, _ in test_decontam.brute([(d, t) for d, t, _ in kept], items)}
    kept = [r for r in kept if r[0] not in leaked]
    out = []
    for d, text, s in kept:
        pieces, at = [], 0
        for a, _, b in test_secrets.base_spans(text):
            if a >= at:
                pieces += [text[at:a], "[secret]"]
            at = max(at, b)
        out.append((d, "".join(pieces) + text[at:], s))
    return out


def test_pipeline(spark):
    documents = [(r["doc_id"], r["text"], r["source"]) for r in table(SMALL, "documents")]
    items = [(r["item_id"], r["text"]) for r in table(SMALL, "benchmark")]
    want = brute(documents, items)
    got = corpus_pipeline.run(spark, SMALL).collect()
    copies = Counter(r.doc_id for r in got)
    taken = {r.doc_id: (r.copies) for r in mixing.mix(
        docs(spark, want).withColumn("size", mixing.words()).select("doc_id", "source", "size")).collect()}
    assert copies == Counter({d: n for d, n in taken.items() if n})
    texts = {d: t for d, t, _ in want}
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got)


def test_stages_return_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SMALL)
        assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_stages_on_hard_tables(spark):
    for made in ([], [(None, None), (1, ""), (2, "x"), (2, "x")]):
        for clash in (False, True):
            for _, stage in corpus_pipeline.STAGES:
                stage(spark, docs(spark, made, clash), SMALL).collect()
    assert secrets.KINDS[:3] == ("assign", "access", "hex") and rows(docs(spark, [])) == []
