"""URL filters: prefix rules first, boosted trees on lexical features for the rest.

URLs that a rule fits are the labelled ones. The trees learn from a bounded sample of them (at most
about TRAIN_ROWS, chosen by a hash of the url, so that reruns agree) and judge the URLs without a
rule. The suffix statistics are counted over all labelled URLs.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule. With
no labelled URL, or labels of one class only, no trees are grown: the verdict is that class, or
allow. Repeated URLs are judged alike.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.sources.layers import store

from .common import pick

# Verdict and rule (host and path start).
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Most rows, in expectation, that the trees learn from.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 11
PRIOR_ROWS = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "symbol_ratio",
    "entropy", "n_params", "has_fragment", "suffix_block_rate", "suffix_log_count",
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _UPPER.lower()), part(2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    )
    sum_ = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, sum_).otherwise(0.0)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds lexical features and the suffix (last label of the host) to rows with url, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    n = F.greatest(F.length(url), F.lit(1))
    letters = count(url, _UPPER + _UPPER.lower())
    digits = count(url, "0123456789")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    made = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "host_depth": count(F.col("host"), "."), "path_depth": count(F.col("path"), "/"),
        "digit_ratio": digits / n, "symbol_ratio": (F.length(url) - letters - digits) / n, "entropy": entropy(url),
        "n_params": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    made = {k: v.cast("double") for k, v in made.items()}
    return urls.withColumns(made).withColumn("suffix", F.substring_index("host", ".", -1))


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_block_rate, suffix_log_count): shares drawn to one half where rows are few."""
    blocked = F.sum("label")
    n = F.count(F.lit(1))
    return labelled.groupBy("suffix").agg(
        ((blocked + PRIOR_ROWS / 2) / (n + PRIOR_ROWS)).alias("suffix_block_rate"),
        F.log1p(n.cast("double")).alias("suffix_log_count"),
    )


def train(labelled: DataFrame, n_labelled: int, train_rows: int = TRAIN_ROWS) -> PipelineModel:
    """Trees from a bounded sample, held in one partition so that sums have one order."""
    kept = min(1.0, train_rows / max(n_labelled, 1))
    chance = F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    sample = store(labelled.filter(chance < kept).select("label", *FEATURES).coalesce(1), "url_sample")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    fitted = trees.fit(vectors.transform(sample.orderBy(*FEATURES, "label").coalesce(1)))
    return PipelineModel([vectors, fitted])


def judge_urls(pages: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row; score is the trees' chance of block."""
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, "page_id", "url").withColumns({"host": host, "path": path})
    rows = with_features(rows.withColumn("r", longest_rule(F.col("host"), F.col("path"))))
    rows = store(
        rows.withColumn("rule", F.col("r.rule")).withColumn("label", (F.col("r.verdict") == "block").cast("double")).drop("r"),
        "url_features",
    )
    labelled = rows.filter("rule IS NOT NULL")
    stats = store(suffix_statistics(labelled), "suffixes")
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()

    known = lambda df: df.join(stats, "suffix", "left").fillna(
        {"suffix_block_rate": 0.5, "suffix_log_count": 0.0}
    )
    if 0 < blocked < n:
        scored = train(known(labelled), n, train_rows).transform(known(rows))
        score = vector_to_array("probability")[1]
    else:
        scored, score = rows, F.lit(blocked / n if n else 0.0)
    judged = F.when(F.col("rule").isNotNull(), F.when(F.col("label") == 1, "block").otherwise("allow")).otherwise(
        F.when(score > 0.5, "block").otherwise("allow")
    )
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), score.cast("double").alias("score"))
