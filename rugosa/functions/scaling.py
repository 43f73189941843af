"""Scaling and power transforms (F9-F14) as Catalyst expressions plus the
one-pass aggregates that fit their statistics.

Conventions follow the reference's library defaults:
* robust scaling centres on the median and divides by the 25-75 IQR; a zero
  IQR divides by 1;
* Yeo-Johnson uses the usual four branches; lambda is fitted by maximum
  likelihood ``-n/2 ln var_pop(t) + (lambda-1) sum sign(y) ln(1+|y|)``;
* standardisation divides by the *population* standard deviation; a zero
  deviation divides by 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.settings import SETTINGS

_EPS = float(np.spacing(1.0))
_TINY = float(np.finfo(np.float64).tiny)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(v):
    return v if isinstance(v, Column) else F.lit(float(v))


# --------------------------------------------------------------------------
# Yeo-Johnson (F10) and its inverse
# --------------------------------------------------------------------------

def yeo_johnson(x: Column | str, lam: float | Column) -> Column:
    """Yeo-Johnson transform of ``x`` for a given lambda (literal or
    column). Literal lambdas emit only the branches that apply."""
    x = _c(x)
    pos = x >= F.lit(0.0)
    if not isinstance(lam, Column):
        lam = float(lam)
        if abs(lam) < _EPS:
            p = F.log1p(x)
        else:
            p = (F.pow(x + F.lit(1.0), F.lit(lam)) - F.lit(1.0)) / F.lit(lam)
        if abs(lam - 2.0) > _EPS:
            n = -(F.pow(F.lit(1.0) - x, F.lit(2.0 - lam)) - F.lit(1.0)) / F.lit(2.0 - lam)
        else:
            n = -F.log1p(-x)
        return F.when(pos, p).otherwise(n)
    p = F.when(F.abs(lam) < F.lit(_EPS), F.log1p(x)).otherwise(
        (F.pow(x + F.lit(1.0), lam) - F.lit(1.0)) / lam
    )
    n = F.when(F.abs(lam - F.lit(2.0)) > F.lit(_EPS),
               -(F.pow(F.lit(1.0) - x, F.lit(2.0) - lam) - F.lit(1.0)) / (F.lit(2.0) - lam)
               ).otherwise(-F.log1p(-x))
    return F.when(pos, p).otherwise(n)


def yeo_johnson_inverse(t: Column | str, lam: float | Column) -> Column:
    """Inverse of :func:`yeo_johnson` (the sign of ``t`` equals the sign of
    the original value)."""
    t = _c(t)
    lam = _lit(lam)
    pos = t >= F.lit(0.0)
    p = F.when(F.abs(lam) < F.lit(_EPS), F.expm1(t)).otherwise(
        F.pow(t * lam + F.lit(1.0), F.lit(1.0) / lam) - F.lit(1.0)
    )
    n = F.when(F.abs(lam - F.lit(2.0)) > F.lit(_EPS),
               F.lit(1.0) - F.pow(-(F.lit(2.0) - lam) * t + F.lit(1.0), F.lit(1.0) / (F.lit(2.0) - lam))
               ).otherwise(-F.expm1(-t))
    return F.when(pos, p).otherwise(n)


# --------------------------------------------------------------------------
# Yeo-Johnson lambda fit (F11): one scan, every grid lambda at once
# --------------------------------------------------------------------------

def yj_grid(lo: float, hi: float, n: int) -> list[float]:
    return [float(v) for v in np.linspace(lo, hi, n)]


def yj_loglik_columns(x: Column | str, grid: Sequence[float]) -> list[Column]:
    """Aggregate columns for one pass: ``n``, ``slog`` (sum sign*ln(1+|x|)) and
    ``v_i`` = var_pop of the transform at ``grid[i]``. No row explosion: the
    grid is spread over columns of a single aggregate."""
    x = _c(x)
    cols = [F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("slog")]
    cols += [F.var_pop(yeo_johnson(x, lam)).alias(f"v_{i}") for i, lam in enumerate(grid)]
    return cols


def yj_fit_table(df: DataFrame, column: str, grid: Sequence[float]) -> DataFrame:
    """F11 on a grid: one row per lambda with its log-likelihood,
    ``(lambda, loglik)``. Variances below the float tiny are rejected
    (log-likelihood -inf), as the reference's library does."""
    agg = df.agg(*yj_loglik_columns(column, grid))
    rows = F.array(*[
        F.struct(
            F.lit(float(lam)).alias("lambda"),
            F.when(F.col(f"v_{i}") < F.lit(_TINY), F.lit(float("-inf"))).otherwise(
                -F.col("n") / F.lit(2.0) * F.ln(F.col(f"v_{i}"))
                + F.lit(float(lam) - 1.0) * F.col("slog")
            ).alias("loglik"),
        )
        for i, lam in enumerate(grid)
    ])
    return agg.select(F.inline(rows))


def yj_best(fit_table: DataFrame) -> DataFrame:
    """Best lambda of a fit table (max log-likelihood; ties -> smaller lambda)."""
    return fit_table.agg(
        F.max_by(F.struct("lambda", "loglik"), F.struct(F.col("loglik"), -F.col("lambda"))).alias("b")
    ).select("b.lambda", "b.loglik")


def yj_fit_lambda(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None,
                  n: int | None = None, refine_rounds: int | None = None) -> float:
    """Lambda by maximum likelihood to ~1e-3: a coarse grid in one scan, then
    ``refine_rounds`` finer grids around the best (each one more scan). The
    grid widens when the optimum sits on an edge. Returns a driver float
    (parameter-sized)."""
    glo, ghi, gn = SETTINGS.yj_grid
    lo = glo if lo is None else lo
    hi = ghi if hi is None else hi
    n = gn if n is None else n
    rounds = SETTINGS.yj_refine_rounds if refine_rounds is None else refine_rounds
    for _ in range(4):
        grid = yj_grid(lo, hi, n)
        best = yj_best(yj_fit_table(df, column, grid)).first()["lambda"]
        step = grid[1] - grid[0]
        if best == grid[0]:
            lo, hi = lo - (hi - lo), hi
        elif best == grid[-1]:
            lo, hi = lo, hi + (hi - lo)
        else:
            break
    for _ in range(rounds):
        grid = yj_grid(best - step, best + step, 17)
        best = yj_best(yj_fit_table(df, column, grid)).first()["lambda"]
        step = grid[1] - grid[0]
    return float(best)


# --------------------------------------------------------------------------
# Robust scaling (F9), standardisation
# --------------------------------------------------------------------------

def robust_stats(df: DataFrame, columns: Sequence[str], exact: bool = True,
                 accuracy: int = 10_000) -> DataFrame:
    """One-row table of ``<c>_med`` and ``<c>_iqr`` for every column. Exact
    linear-interpolation percentiles by default, computed with bounded memory
    (``operators/quantiles.py``) and returned as a literal parameter row;
    ``exact=False`` uses ``percentile_approx``."""
    qs = [0.25, 0.5, 0.75]
    if exact:
        from rugosa.operators.quantiles import exact_quantiles

        vals = exact_quantiles(df, columns, qs)
        sel = []
        for c in columns:
            q1, med, q3 = vals[c]
            iqr = q3 - q1
            sel.append(F.lit(float(med)).alias(f"{c}_med"))
            sel.append(F.lit(1.0 if iqr < 10 * _EPS else float(iqr)).alias(f"{c}_iqr"))
        return df.sparkSession.range(1).select(*sel)
    aggs = []
    for c in columns:
        aggs.append(F.percentile_approx(c, qs, accuracy).alias(f"{c}__q"))
    out = df.agg(*aggs)
    sel = []
    for c in columns:
        iqr = F.col(f"{c}__q")[2] - F.col(f"{c}__q")[0]
        sel.append(F.col(f"{c}__q")[1].alias(f"{c}_med"))
        sel.append(F.when(iqr < F.lit(10 * _EPS), F.lit(1.0)).otherwise(iqr).alias(f"{c}_iqr"))
    return out.select(*sel)


def bind_params(df: DataFrame, params: DataFrame, name: str = "_p") -> DataFrame:
    """Attach a one-row parameter table to every row as a struct, through a
    scalar subquery (evaluated once per query, no join)."""
    return df.withColumn(name, params.select(F.struct(*params.columns)).scalar())


def robust_scale(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """``(x - median) / IQR`` for every column, statistics from ``df``."""
    stats = robust_stats(df, columns, exact=exact)
    bound = bind_params(df, stats)
    return bound.withColumns(
        {c: (F.col(c) - F.col(f"_p.{c}_med")) / F.col(f"_p.{c}_iqr") for c in columns}
    ).drop("_p")


def standard_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = []
    for c in columns:
        aggs.append(F.avg(c).alias(f"{c}_mean"))
        sd = F.stddev_pop(c)
        aggs.append(F.when((sd == F.lit(0.0)) | sd.isNull(), F.lit(1.0)).otherwise(sd).alias(f"{c}_sd"))
    return df.agg(*aggs)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - mean) / std_pop``; a zero deviation divides by 1."""
    bound = bind_params(df, standard_stats(df, columns))
    return bound.withColumns(
        {c: (F.col(c) - F.col(f"_p.{c}_mean")) / F.col(f"_p.{c}_sd") for c in columns}
    ).drop("_p")
