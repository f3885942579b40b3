"""One registered query per text operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontam, jaccard, licenses, mixing, near, quality, repair, secrets, tokens, urls, warc
from .common import pick, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_secret_scans(spark, folder):
    return secrets.find_secrets(read(spark, folder, "documents"))


@query
def op2_url_filters(spark, folder):
    return urls.judge_urls(read(spark, folder, "pages"))


@query
def op3_chat_formatting(spark, folder):
    """Conversations and one more whose texts hold control strings, formatted and read back."""
    rows = pick(read(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    planted = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') "
        "AS t(conv_id, turn, role, text)"
    )
    return chat.formatted_conversations(rows.unionByName(planted))


@query
def op4_benchmark_decontamination(spark, folder):
    return decontam.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op5_license_scans(spark, folder):
    return licenses.scan_licenses(read(spark, folder, "documents"))


@query
def op6_warc(spark, folder):
    return warc.archive_and_read(read(spark, folder, "pages"))


@query
def op7_token_counts(spark, folder):
    return tokens.count_tokens(read(spark, folder, "documents"), vocabulary_file())


@query
def op8_minhash_near_dedup(spark, folder):
    return near.near_duplicates(read(spark, folder, "documents"))


@query
def op9_mixing(spark, folder):
    return mixing.mix_report(read(spark, folder, "documents"), draws=mixing.DRAWS)


@query
def op10_quality_rules(spark, folder):
    return quality.judge_quality(read(spark, folder, "documents"))


@query
def op11_structure_repair(spark, folder):
    return repair.repair_reports(repair.damaged(read(spark, folder, "conversations")))


@query
def op12_tokenizer_alignment(spark, folder):
    return align.align_statistics(
        read(spark, folder, "documents"), vocabulary_file(), vocabulary_file("piece_bpe_32k.model")
    )


@query
def op13_ngram_jaccard_join(spark, folder):
    return jaccard.jaccard_components(read(spark, folder, "documents"))
