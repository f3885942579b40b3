"""Exact interpolated quantiles that never gather a column in one task: the same three passes for
every size.

1. percentile_approx, a sketch of fixed size, gives two edges around each wanted rank.
2. Rows below and up to the edges are counted; an edge that misses its rank moves to the minimum or
   maximum (which happens where a column has fewer rows than the sketch has cells).
3. Values between the edges are counted per value and summed up in order; one row per wanted rank
   comes back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


@dataclass
class _Bracket:
    """Two values that enclose the 0-based ranks `first` and `last` of a column."""

    col: str
    probability: float
    first: int
    last: int
    lo: float
    hi: float
    size: int
    least: float
    most: float
    below: int = 0

    def inside(self) -> Column:
        return F.col(self.col).between(self.lo, self.hi)


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, dict[float, float | None]]:
    """{column: {probability: value}}; NULLs are ignored, an empty column gives None."""
    cols = [c for c in wanted if wanted[c]]
    out: dict[str, dict[float, float | None]] = {c: dict.fromkeys(wanted[c]) for c in wanted}
    if not cols:
        return out
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    brackets = _sketched(df, {c: wanted[c] for c in cols})
    if not brackets:
        return out
    _enclose(df, brackets)
    for b, (x, y) in zip(brackets, _values(df, brackets)):
        at = b.probability * (b.size - 1)
        out[b.col][b.probability] = x + (y - x) * (at - b.first)
    return out


def _sketched(df: DataFrame, wanted: dict[str, list[float]]) -> list[_Bracket]:
    aggs = []
    for i, (c, ps) in enumerate(wanted.items()):
        edges = [min(max(p + side * 2 / ACCURACY, 0.0), 1.0) for p in ps for side in (-1, 1)]
        aggs += [
            F.count(c).alias(f"n_{i}"), F.min(c).alias(f"lo_{i}"), F.max(c).alias(f"hi_{i}"),
            F.percentile_approx(c, edges, ACCURACY).alias(f"edges_{i}"),
        ]
    row, out = df.agg(*aggs).first(), []
    for i, (c, ps) in enumerate(wanted.items()):
        n = row[f"n_{i}"]
        for j, p in enumerate(ps if n else []):
            at = p * (n - 1)
            lo, hi = row[f"edges_{i}"][2 * j : 2 * j + 2]
            out.append(
                _Bracket(c, p, math.floor(at), math.ceil(at), lo, hi, n, row[f"lo_{i}"], row[f"hi_{i}"])
            )
    return out


def _enclose(df: DataFrame, brackets: list[_Bracket]) -> None:
    aggs = []
    for i, b in enumerate(brackets):
        aggs += [F.count_if(F.col(b.col) < b.lo).alias(f"below_{i}"), F.count_if(F.col(b.col) <= b.hi).alias(f"upto_{i}")]
    row = df.agg(*aggs).first()
    for i, b in enumerate(brackets):
        b.below = row[f"below_{i}"]
        if b.below > b.first:
            b.lo, b.below = b.least, 0
        if row[f"upto_{i}"] <= b.last:
            b.hi = b.most


def _values(df: DataFrame, brackets: list[_Bracket]) -> list[tuple[float, float]]:
    """Values at the first and last rank of each bracket."""
    hits = [F.when(b.inside(), F.struct(F.lit(i).alias("i"), F.col(b.col).alias("x"))) for i, b in enumerate(brackets)]
    counted = (
        df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.i", "h.x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("x"))

    def rank(which: str) -> Column:
        pairs = [F.lit(v) for i, b in enumerate(brackets) for v in (i, getattr(b, which) - b.below)]
        return F.element_at(F.create_map(*pairs), F.col("i"))

    at = lambda which: F.min(F.when(F.col("upto") > rank(which), F.col("x")))
    rows = counted.withColumn("upto", upto).groupBy("i").agg(at("first").alias("a"), at("last").alias("b")).collect()
    found = {r["i"]: (r["a"], r["b"]) for r in rows}
    return [found[i] for i in range(len(brackets))]
