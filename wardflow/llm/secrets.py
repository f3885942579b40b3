"""Secret scans that link the parts of multipart credentials, in DataFrame functions only.

Base kinds (assign, access, hex) are reported wherever they stand. Weak parts are reported only if a
complementary part co-occurs in the same scope: an identifier needs a secret, a secret needs an
identifier or an endpoint, an endpoint needs a secret. Base spans are strong parts: access is an
identifier, assign and hex are secrets. A scope is the
window of `reach` code points around a part.

Parts are rows (text key, start, end); co-occurrence is an interval join on (text key, block of
`reach` code points), so a long text or a hot one spreads over its blocks, and copies of a text are
linked once.

Defined results: a null text counts as empty; a span is kind:start:end in code points, end
exclusive; no spans give the empty string and its digest; repeated rows get equal results; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.sources.layers import store

from .common import pick

# The base patterns, the smallest lengths, and the order of kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
LEAST_VALUE = 8
# Weak parts.
IDENT = r"""(?i:\b(?:client_?id|access_?key_?id|account_?id|user_?name|user|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i:\b(?:https?|jdbc:[a-z]+|ftp|amqp|redis|postgres(?:ql)?|mongodb)://|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9.:-]{4,}"""
REACH = 200


SPANS = "array<struct<start:int,kind:int,end:int>>"


def located(found: Column, pieces: Column) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches, in code points.

    The pieces between matches come from split, the matches from extract; running lengths give the
    places. Matches are never empty, so there is one piece more than there are matches.
    """
    kind = "array<struct<start:int,end:int,found:string>>"
    gaps = F.transform(F.slice(pieces, 1, F.size(found)), F.length)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    both = F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("found")))
    spans = F.aggregate(both, begin, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(kind))


def as_spans(matches: Column, kind: str) -> Column:
    code = KINDS.index(kind)
    return F.transform(
        matches, lambda m: F.struct(m["start"].alias("start"), F.lit(code).alias("kind"), m["end"].alias("end"))
    )


def with_parts(docs: DataFrame, weak: bool = True) -> DataFrame:
    """Adds `key`, `base` (sorted spans of the base kinds) and, if wanted, `weak` (spans of weak parts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    if weak:
        patterns |= {"ident": IDENT, "weak": WEAK, "endpoint": ENDPOINT}
    found = {f"_found_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()}
    pieces = {f"_pieces_{k}": F.when(F.size(f"_found_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()}
    spans = {f"_{k}": located(F.col(f"_found_{k}"), F.col(f"_pieces_{k}")) for k in patterns}
    out = docs.withColumns(found).withColumns(pieces).withColumns(spans)
    full, short = (
        F.filter("_assign", lambda m: value(m) >= LEAST_VALUE), F.filter("_assign", lambda m: value(m) < LEAST_VALUE)
    )
    added = {
        "key": F.unhex(F.sha2(text.cast("binary"), 256)),
        "base": F.sort_array(
            F.concat(as_spans(full, "assign"), as_spans(F.col("_access"), "access"), as_spans(F.col("_hex"), "hex"))
        ),
    }
    if weak:
        added["weak"] = F.concat(
            as_spans(F.col("_ident"), "ident"), as_spans(short, "weak"), as_spans(F.col("_weak"), "weak"),
            as_spans(F.col("_endpoint"), "endpoint"),
        )
    return out.withColumns(added).drop(*found, *pieces, *spans)


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, linked): weak spans of a text that have a complementary part within reach."""
    texts = (
        parts.filter(F.size("weak") > 0).groupBy("key")
        .agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    )
    spans = store(
        texts.select("key", F.explode(F.array_distinct(F.concat("base", "weak"))).alias("s")).select("key", "s.*"), "parts"
    )
    strong = F.col("kind") < KINDS.index("ident")
    # a weak part that overlaps a base span is that secret again
    place = Window.partitionBy("key").orderBy("start", "kind", "end")
    before = F.max(F.when(strong, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(strong, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("clear", clear).filter(strong | F.col("clear")).drop("clear")
    role = (
        F.when(F.col("kind").isin(KINDS.index("access"), KINDS.index("ident")), "ident")
        .when(F.col("kind") == KINDS.index("endpoint"), "endpoint").otherwise("secret")
    )
    spans = store(spans.withColumn("role", role), "clear_parts")

    block = lambda at: F.floor(at / reach)
    there = (
        spans.select("key", "role", "start", "end", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("block"))
        .groupBy("key", "block", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    )
    # per block the extremes decide: in an outer block of the window only one of the two ends can fail
    needs = F.when(F.col("role") == "secret", F.array(F.lit("ident"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret")))
    wanted = (
        spans.filter(~strong).withColumn("needs", F.explode(needs))
        .withColumn("block", F.explode(F.sequence(block(F.col("start") - reach), block(F.col("end") + reach))))
        .select("key", F.col("needs").alias("role"), "block", "start", "kind", "end")
    )
    hits = wanted.join(there, ["key", "role", "block"]).filter(
        (F.col("first") <= F.col("end") + reach) & (F.col("last") >= F.col("start") - reach)
    )
    return hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    )


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Counts of base kinds, their digest, and all spans per row."""
    parts = store(with_parts(pick(docs, "doc_id", "text")).select("doc_id", "key", "base", "weak"), "scanned")
    linked = store(linked_parts(parts, reach), "linked")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    all_spans = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(SPANS))))
    return parts.join(linked, "key", "left").select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(all_spans).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """The documents with every span replaced by a mark; n_chars follows the text."""
    kinds, columns = dict(docs.dtypes), docs.columns
    narrow = with_parts(docs.select("text")).filter(F.size("weak") > 0).select("key", "base", "weak")
    linked = store(linked_parts(store(narrow, "scanned"), reach), "linked")
    found = with_parts(docs, weak=False).join(linked, "key", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(SPANS))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        piece = F.when(s["end"] > acc["at"], F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(gap))
        return F.struct(
            F.greatest(s["end"], acc["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.coalesce(piece, F.lit("")))).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(
        spans, begin, step,
        lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    text = F.when((F.size("base") > 0) | F.col("linked").isNotNull(), masked).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(kinds["n_chars"])).select(*columns)
