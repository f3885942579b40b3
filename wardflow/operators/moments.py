"""Pairwise moments of many columns in one pass.

Each Arrow batch gives matrices of counts, sums, squares and products of all column pairs on the rows
where both are known (a mask matrix product each). A task adds them up, so a task puts out one row per
pair, and one small aggregate adds the tasks up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double"


def _task_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        known = ~np.isnan(values)
        x, m = np.where(known, values, 0.0), known.astype(float)
        here = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        total = here if total is None else total + here
    if total is None:
        return
    pairs = list(combinations_with_replacement(range(total.shape[1]), 2))
    i, j = np.array(pairs).T
    n, s, q, p = total
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j].astype(np.int64)),
            pa.array(s[i, j]), pa.array(s[j, i]), pa.array(q[i, j]), pa.array(q[j, i]), pa.array(p[i, j]),
        ],
        names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
    )


def pairwise_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x, y, n, sx, sy, sxx, syy, sxy) per pair of columns, each with itself included.

    Columns become doubles; NULL and NaN are unknown. Pairs are there in the order of `cols`; without rows
    there are none.
    """
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sums = ("sx", "sy", "sxx", "syy", "sxy")
    total = wide.mapInArrow(_task_moments, _PARTS).groupBy("i", "j").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]
    )
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(F.get(names, "i").alias("x"), F.get(names, "j").alias("y"), "n", *sums)


def pearson() -> Column:
    """Correlation of a row of `pairwise_moments`; NULL below two rows or without spread."""
    n = F.col("n").cast("double")
    xy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    xx, yy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    # what is left of equal values by rounding is no spread
    spread = (xx > F.col("sxx") * 1e-12) & (yy > F.col("syy") * 1e-12)
    return F.when((F.col("n") > 1) & spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), xy / F.sqrt(xx * yy))))


def gram(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray]:
    """Rows without unknown values, and the matrix of sums of products of the columns and of 1 (last).

    The matrix has as many rows as there are columns, however long the table is.
    """
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    size = len(cols)
    out = np.zeros((size + 1, size + 1))
    at = {c: i for i, c in enumerate(cols)}
    n = 0
    for r in pairwise_moments(whole, cols).collect():
        i, j, n = at[r["x"]], at[r["y"]], r["n"]
        out[i, j] = out[j, i] = r["sxy"]
        if i == j:
            out[i, size] = out[size, i] = r["sx"]
    out[size, size] = n
    return n, out
