"""Attribution of a weighted portfolio of signals, from one mergeable Gram matrix.

Every task adds up X'X over its observations (with a column of ones, so that sums and counts come
along); rows of the matrix are added where they are dealt.  For N units that is one pass over the
data, N rows of N numbers a task, and N x N numbers on the driver, however many observations there
are; ``MOST_UNITS`` bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = 252
#: Units of a Gram matrix: 4,000 take 128 MB on the driver and in a task.
MOST_UNITS = 4000
LEAST_ROWS = 5


def gram(values: DataFrame, unit: str, obs: list[str], value: str) -> tuple[list, np.ndarray]:
    """(units in order, X'X of a column of ones and the units), over the observations that have a
    value of every unit."""
    names = sorted(r[0] for r in values.select(unit).distinct().limit(MOST_UNITS + 1).collect())
    if len(names) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units")
    n = len(names)
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*obs).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(value).cast("double").alias("v")))).alias("x"))
    rows = rows.where(F.size("x") == n).select(F.col("x.v").alias("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1, n + 1))
        seen = False
        for b in batches:
            if b.num_rows:
                x = np.hstack([np.ones((b.num_rows, 1)), b.column("x").flatten().to_numpy().reshape(b.num_rows, n)])
                total += x.T @ x
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def merge(t: pa.Table) -> pa.Table:
        row = np.sum([np.frombuffer(x, float) for x in t.column("row").to_pylist()], 0)
        return pa.table({"i": t.column("i")[:1], "row": pa.array([row.tobytes()], pa.binary())})

    out = np.zeros((n + 1, n + 1))
    for r in rows.mapInArrow(add, "i int, row binary").groupBy("i").applyInArrow(merge, "i int, row binary").collect():
        out[r.i] = np.frombuffer(r.row, float)
    return names, out


def mean_and_covariance(g: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and the sample covariance of a Gram matrix."""
    n = int(round(g[0, 0]))
    if n < 2:
        return n, np.zeros(len(g) - 1), np.zeros((len(g) - 1, len(g) - 1))
    mean = g[0, 1:] / n
    return n, mean, (g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)


def correlations(g: np.ndarray) -> np.ndarray:
    """Correlation matrix; 0 where a side does not vary, 1 on the diagonal."""
    _, _, cov = mean_and_covariance(g)
    d = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(np.outer(d, d) > 1e-15, cov / np.outer(d, d), 0.0)
    np.fill_diagonal(c, 1.0)
    return c


def attribute(names: list, g: np.ndarray, weights: dict, scores: dict | None = None, risk_free: float = 0.0) -> list[tuple]:
    """Per unit with a weight: weight, marginal Sharpe contribution, shares of variance, return and
    score, whether it drags, the Sharpe without it; then the portfolio's return, volatility, Sharpe
    and diversification ratio."""
    at = [i for i, x in enumerate(names) if x in weights]
    rows, mean, cov = mean_and_covariance(g)
    if not at or rows < LEAST_ROWS:
        return []
    w = np.array([weights[names[i]] for i in at], float)
    mu, c = mean[at] * YEAR, cov[np.ix_(at, at)] * YEAR
    var = float(w @ c @ w)
    vol = float(np.sqrt(max(var, 1e-12)))
    total = (float(w @ mu) - risk_free) / vol
    raw = w * (np.linalg.pinv(c) @ mu)
    msc = raw * (total / raw.sum()) if abs(raw.sum()) > 1e-8 else raw
    share = w * (c @ w) / var if var > 1e-12 else np.full(len(w), 1 / len(w))
    part = w * mu
    part = part / part.sum() if abs(part.sum()) > 1e-12 else np.zeros(len(w))
    if scores is None:
        score = np.full(len(w), 1 / len(w))
    else:
        score = np.array([scores.get(names[i], 0.0) for i in at])
        score = score / score.sum() if score.sum() > 1e-8 else np.zeros(len(w))
    # without one unit: totals less its row and column, so all units cost no more than one
    cw, one = c @ w, float(w.sum())
    left = one - w
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.sqrt(np.maximum((var - 2 * w * cw + w**2 * np.diag(c)) / left**2, 1e-12))
        rest = np.where(left < 1e-8, 0.0, ((w @ mu - w * mu) / left - risk_free) / v)
    ratio = float(w @ np.sqrt(np.maximum(np.diag(c), 0))) / vol if vol > 1e-8 else 1.0
    whole = (float(w @ mu), vol, total, ratio)
    return [(names[i], *(float(x[k]) for x in (w, msc, share, part, score)), bool(msc[k] < 0), float(rest[k] if len(at) > 1 else 0.0), *whole) for k, i in enumerate(at)]


SCHEMA = "formula_id string, weight double, msc double, variance_share double, return_share double, score_share double, drags boolean, sharpe_without double, portfolio_return double, portfolio_volatility double, portfolio_sharpe double, diversification double"


def report(pnl: DataFrame, weights: dict[str, float], scores: dict[str, float] | None = None, risk_free: float = 0.0) -> DataFrame:
    """Attribution of the formulas' profits under fixed weights; no rows where there is no formula
    with a weight or fewer than five dates that all have."""
    names, g = gram(pnl.where(F.col("formula_id").isin(*weights)), "formula_id", ["dt"], "pnl")
    return pnl.sparkSession.createDataFrame(attribute(names, g, weights, scores, risk_free), SCHEMA)
