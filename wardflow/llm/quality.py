"""Line-first cleaning: judge each line, remove the failures, reject texts that lose too much.

Line rules, in order (the first that fails a line names the reason):
- navigation: separators such as `|` stand between its words (three or more, a quarter of words);
- punctuation: marks such as `###` or `!!` hang on three words in ten or more;
- boilerplate: it holds a stock phrase of web pages and little else.
A document is rejected when it fails the base checks (under 50 words, or more than half of its words
in repeated three-word windows) or when lines with more than `max_loss` of its words fail.

Defined results: a null text counts as empty (0 words, base failed, rejected); lines without a word
are never duplicates and never fail; repeated rows are judged one by one, alike; empty tables give
no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT, map_lists, pick

MIN_WORDS, MAX_REPEATED, MAX_LOSS = 50, 0.5, 0.3
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "||", "»", "›", ">", ">>", "/", "•", "·", "::")
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
HUNG = re.compile(rb"(?:[#*$%&<>~^=_]{2,}|!{2,})(?=\s|$)")
SPACES = " \t\n\v\f\r"
STOCK = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|"
    r"(?:accept|use) (?:all )?cookies|enable javascript|javascript is (?:disabled|required)|"
    r"click here|read more|sign in|log in|sign up|subscribe to our|share (?:this|on)|"
    r"skip to (?:main )?content|powered by|back to top|lorem ipsum",
    re.IGNORECASE,
)
STOCK_WORDS = 12


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    window = pair[:-1] * len(known) + ids[2:]
    _, place, times = np.unique(window, return_inverse=True, return_counts=True)
    hit = times[place] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def line_fault(line: str, raw: bytes, words: list[bytes]) -> str | None:
    """Why a line with words fails, or None."""
    n = len(words)
    seps = sum(map(_SEPARATORS.__contains__, words))
    if seps >= 3 and 4 * seps >= n - seps:
        return "navigation"
    if 10 * len(HUNG.findall(raw)) >= 3 * n:
        return "punctuation"
    if n <= STOCK_WORDS and STOCK.search(line):
        return "boilerplate"
    return None


def judge(text: str | None, max_loss: float = MAX_LOSS) -> tuple:
    """Counts, verdicts and the cleaned text of one document."""
    text = text or ""
    words = text.encode().split()  # bytes split on exactly the six ASCII white-space characters
    n = len(words)
    seen, with_word, lost, kept_lines = set(), 0, 0, []
    for line in text.split("\n"):
        raw = line.encode()
        own = raw.split()
        if not own:
            kept_lines.append(line)
            continue
        with_word += 1
        seen.add(line)
        if line_fault(line, raw, own):
            lost += len(own)
        else:
            kept_lines.append(line)
    n_repeat = repeated_words(words)
    failed = n < MIN_WORDS or n_repeat > MAX_REPEATED * n
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        with_word - len(seen), n_repeat, lost, failed, not failed and lost <= max_loss * n,
        "\n".join(kept_lines),
    )


COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lost_words long, base_failed boolean, kept boolean"
)


def judge_quality(
    docs: DataFrame, id: str = "doc_id", text: str = "text", max_loss: float = MAX_LOSS
) -> DataFrame:
    """Counts and verdict per row; one narrow pass, no shuffle."""
    def work(ids, texts):
        rows = [judge(t, max_loss)[:-1] for t in texts]
        return ids, *([*map(list, zip(*rows))] if rows else [[]] * 8)

    return map_lists(pick(docs, id, text), f"{id} {dict(docs.dtypes)[id]}, {COUNTS}", work)


def clean_documents(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """Documents that pass, without their failed lines; n_chars follows the text."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in DOCUMENT)

    def work(*columns):
        out = []
        for row in zip(*columns):
            *_, kept, cleaned = judge(row[1], max_loss)
            if kept:
                out.append((row[0], cleaned, *row[2:]))
        return [*map(list, zip(*out))] if out else [[]] * len(DOCUMENT)

    cleaned = map_lists(pick(docs, *DOCUMENT), schema, work)
    return cleaned.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
