import math
import re

from wardflow.llm import licenses

from .util import EMPTY, SMALL, docs, rows, table

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def base(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += hits
        labels |= {label} if hits else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def brute(texts):
    """Labels and scores: every template at every offset; no index, no choice of rare words."""
    vocabulary = {w for _, t, _ in licenses.TEMPLATES for w in t.split()}
    n = {w: sum(w in set(words(t)) for t in texts) for w in vocabulary}
    weight = {w: math.log((len(texts) + 1) / (n[w] + 1)) + 1 for w in vocabulary}
    out = []
    for text in texts:
        w = words(text)
        *_, labels = base(text)
        found, best = set(filter(None, labels.split(","))), 1.0 if labels else 0.0
        for label, template, must in licenses.TEMPLATES:
            t = template.split()
            total = sum(weight[x] for x in t)
            for at in range(-len(t), len(w)):
                piece = w[max(at, 0) : max(at + len(t), 0)]
                if all(any(piece[i : i + len(p.split())] == p.split() for i in range(len(piece))) for p in must):
                    share = sum(weight[x] for q, x in enumerate(t) if 0 <= at + q < len(w) and w[at + q] == x) / total
                    if share >= licenses.ENOUGH:
                        found.add(label)
                        best = max(best, share)
        out.append((",".join(sorted(found)), round(min(best, 1.0), 9)))
    return out


def test_table(spark):
    made = [(r["doc_id"], r["text"]) for r in table(SMALL, "documents")]
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    labels = brute([t for _, t in made])
    for (doc_id, text), (all_labels, score) in zip(made, labels):
        r = out[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert (r.labels, round(r.score, 9)) == (all_labels, score)


def test_templates_and_edits(spark):
    made = [(i, f"intro words {t.upper()} and more") for i, (_, t, _) in enumerate(licenses.TEMPLATES)]
    made += [
        (100, "Apache-License; CC BY, cc by\nMIT\tLicense gnu GENERAL public license"), (101, "mitlicense apache 2 license"),
        (102, "é mit license ü"), (103, "Permission is hereby granted, free of charge, to any fellow"), (104, "all rights reserved"),
        (105, " ".join(licenses.TEMPLATES[2][1].split()[:9]) + " x " + "y " * 30_000 + licenses.TEMPLATES[7][1]),
        (106, "charge of free granted hereby is permission"),
    ]
    out = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, made)).collect()}
    for (doc_id, text), (labels, score) in zip(made, brute([t for _, t in made])):
        r = out[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), doc_id
        assert (r.labels, round(r.score, 9)) == (labels, score), doc_id
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in out[i].labels.split(",")


def test_partial_license_in_a_long_text_with_rare_words_elsewhere(spark):
    """Rare template words in other prose take no place from a passage that stands with its phrase."""
    passage = "permission is hereby granted free of charge to any person obtaining a copy of this thing"
    moved = "permission to use copy modify and perhaps to distribute it for any purpose with or without fee is hereby granted"
    decoys = "associated of documentation a files with restriction and software or deal "
    common = [(i, f"{passage} {moved} {i}") for i in range(30)]  # makes the words of the passages common
    made = common + [
        (100, decoys + "y " * 200 + passage + " z" * 200 + " " + decoys), (101, decoys + "y " * 50 + moved), (102, decoys * 3),
        (103, passage), (104, "permission is hereby granted free of charge " * 40 + decoys),
    ]
    out = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan_licenses(docs(spark, made)).collect()}
    want = dict(zip([i for i, _ in made], brute([t for _, t in made])))
    assert out == want and "mit" in want[100][0].split(",")


def test_hard_cases(spark):
    got = rows(licenses.scan_licenses(docs(spark, EMPTY, clash=True)), "doc_id", "n_words", "n_base", "labels", "score")
    assert got == [(None, 0, 0, "", 0.0), (None, 2, 0, "", 0.0), (1, 0, 0, "", 0.0), (2, 0, 0, "", 0.0), (3, 1, 0, "", 0.0), (3, 1, 0, "", 0.0)]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
