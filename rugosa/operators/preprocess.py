"""Per-fold model preprocessing: polynomial expansion -> robust scaling ->
Yeo-Johnson -> standardisation, refitted for every training split.

"States": state ``k < n_splits`` is the training part of split k (rows with
``fold <> k``); state ``n_splits`` is all rows (final refit). All statistics
are fitted on the *distinct-input table* -- ``groupBy(Vc, Fz, ap)`` with one
row count and target sums per fold -- because every model input is a
function of the three base inputs: a training row set is then a weight
vector over distinct inputs (``N - n_k``), and repeated inputs (a hot input
combination holding a third of all rows) collapse in the map-side partial
aggregate instead of reaching a task.

Statistics per (state, column):
* median / IQR: exact weighted quantiles of all columns and states at once
  (``operators/ranks.py``);
* Yeo-Johnson lambda: log-likelihood on a lambda grid from partial sums,
  refined once around the best grid point;
* mean / population std of the transformed column: partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.functions.features import poly_terms
from rugosa.operators.linalg import partial_sums
from rugosa.settings import SETTINGS

INPUTS = ("Vc", "Fz", "ap")
_EPS = float(np.spacing(1.0))


# --------------------------------------------------------------------------
# numpy kernels (run inside tasks)
# --------------------------------------------------------------------------

def engineered_np(v: np.ndarray, eps: float = SETTINGS.guard_eps) -> np.ndarray:
    """The 15 model inputs (guarded ratios and logs) from ``(Vc, Fz, ap)``."""
    vc, fz, ap = v[:, 0], v[:, 1], v[:, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        cols = [vc, fz, ap, vc * vc, fz * fz, ap * ap, vc * fz, vc * ap, fz * ap,
                vc / (fz + eps), fz / (ap + eps), vc / (ap + eps),
                np.log(vc + eps), np.log(fz + eps), np.log(ap + eps)]
    return np.column_stack(cols)


def poly_np(x: np.ndarray, degree: int) -> np.ndarray:
    """All monomials of degree 1..degree (same order as ``poly_terms``)."""
    terms = poly_terms(x.shape[1], degree)
    index = {t: i for i, t in enumerate(terms)}
    out = np.empty((x.shape[0], len(terms)))
    for i, t in enumerate(terms):
        out[:, i] = x[:, t[0]] if len(t) == 1 else out[:, index[t[:-1]]] * x[:, t[-1]]
    return out


def yj_np(x: np.ndarray, lam: np.ndarray, log1p_abs: np.ndarray | None = None) -> np.ndarray:
    """Yeo-Johnson with per-column (broadcast) lambdas, written with one
    ``expm1`` per element: for x >= 0, ((1+x)^l - 1)/l = expm1(l ln(1+x))/l;
    for x < 0, -((1-x)^(2-l) - 1)/(2-l) = expm1((2-l) ln(1-x)) / (l-2); the
    log branches (l = 0 for x >= 0, l = 2 for x < 0) are +-ln(1+|x|).
    ``log1p_abs`` may be passed in when many lambdas share one ``x``."""
    x, lam = np.broadcast_arrays(np.asarray(x, dtype=np.float64), np.asarray(lam, dtype=np.float64))
    pos = x >= 0
    L = np.log1p(np.abs(x)) if log1p_abs is None else np.broadcast_to(log1p_abs, x.shape)
    e = np.where(pos, lam, 2.0 - lam)
    special = np.abs(e) < _EPS
    den = np.where(pos, lam, lam - 2.0)
    with np.errstate(all="ignore"):
        gen = np.expm1(e * L) / np.where(special, 1.0, den)
    return np.where(special, np.where(pos, L, -L), gen)


def yj_inverse_np(t: np.ndarray, lam: float) -> np.ndarray:
    pos = t >= 0
    with np.errstate(all="ignore"):
        if abs(lam) < _EPS:
            p = np.expm1(t)
        else:
            p = np.power(t * lam + 1.0, 1.0 / lam) - 1.0
        if abs(lam - 2.0) > _EPS:
            n = 1.0 - np.power(-(2.0 - lam) * t + 1.0, 1.0 / (2.0 - lam))
        else:
            n = -np.expm1(-t)
    return np.where(pos, p, n)


def model_inputs_np(v: np.ndarray, inputs: str = "engineered") -> np.ndarray:
    """Model input columns from ``(Vc, Fz, ap)``: the 15 engineered features,
    or the three base inputs themselves (``inputs="base"``)."""
    return engineered_np(v) if inputs == "engineered" else np.asarray(v, dtype=np.float64)


@dataclass
class Prep:
    """Fitted preprocessing of one polynomial degree for every state."""

    degree: int
    med: np.ndarray    # (S, p)
    iqr: np.ndarray    # (S, p)
    lam: np.ndarray    # (S, p)
    mean: np.ndarray   # (S, p)
    sd: np.ndarray     # (S, p)
    inputs: str = "engineered"
    live: np.ndarray | None = None   # (S,) columns that are not constant
    moving: np.ndarray | None = None   # (S, p) which they are

    def expand(self, v: np.ndarray) -> np.ndarray:
        """Polynomial expansion of the model inputs of raw ``(Vc, Fz, ap)``."""
        return poly_np(model_inputs_np(v, self.inputs), self.degree)

    @property
    def width(self) -> int:
        return self.med.shape[1]

    def transform(self, poly: np.ndarray, state: int) -> np.ndarray:
        z = (poly - self.med[state]) / self.iqr[state]
        t = yj_np(z, self.lam[state])
        return (t - self.mean[state]) / self.sd[state]

    def gamma_scale(self, state: int) -> float:
        """``gamma="scale"``: 1 / (p * variance of all transformed entries).
        Columns have mean 0 and variance 1, constant ones variance 0."""
        return 1.0 / max(self.width if self.live is None else int(self.live[state]), 1)


# --------------------------------------------------------------------------
# distinct-input table
# --------------------------------------------------------------------------

def input_summary(folded: DataFrame, target: str, n_splits: int = SETTINGS.n_splits,
                  fold_col: str = "fold") -> DataFrame:
    """``(Vc, Fz, ap, n_k, sy_k, syy_k for every fold k, y0)``: one row per
    distinct input, built by a partial (map-side) aggregate. Sums are of targets
    less ``y0``, their mean, so that squares of a large common part never cancel."""
    y0 = folded.agg(F.avg(target)).first()[0] or 0.0
    aggs = [F.lit(float(y0)).alias("y0")]
    for k in range(n_splits):
        inf = F.col(fold_col) == k
        y = F.col(target) - F.lit(float(y0))
        aggs += [
            F.sum(F.when(inf, 1).otherwise(0)).cast("long").alias(f"n{k}"),
            F.sum(F.when(inf, y).otherwise(0.0)).alias(f"sy{k}"),
            F.sum(F.when(inf, y * y).otherwise(0.0)).alias(f"syy{k}"),
        ]
    summary = folded.groupBy(*INPUTS).agg(*aggs)
    return spread(summary, INPUTS)


def spread(df: DataFrame, keys=INPUTS, factor: int = 1) -> DataFrame:
    """Hash-partition by ``keys`` over at least ``factor x`` the cluster's
    parallelism. The numpy passes are CPU-bound per distinct input, so a
    small table must not be coalesced into one task; rows of one input land
    in one task, so features are computed once per input per task."""
    n = max(df.sparkSession.sparkContext.defaultParallelism * factor, 1)
    return df.repartition(n, *keys)


def state_weights(pdf: pd.DataFrame, n_splits: int) -> np.ndarray:
    """(rows, S) training weights: ``N - n_k`` per split, ``N`` for all."""
    n = np.column_stack([pdf[f"n{k}"].to_numpy(np.float64) for k in range(n_splits)])
    tot = n.sum(axis=1, keepdims=True)
    return np.hstack([tot - n, tot])


# --------------------------------------------------------------------------
# fitting passes
# --------------------------------------------------------------------------

#: Beyond this a power transform overflows doubles; the search ends there.
YJ_LIMIT = 64.0


def robust_fold_stats(summary: DataFrame, degree: int, n_splits: int = SETTINGS.n_splits,
                      inputs: str = "engineered") -> tuple[np.ndarray, np.ndarray]:
    """Median and interquartile range ``(states, columns)`` of every expanded column
    in every training state: exact weighted quantiles of all columns side by side
    (``operators/ranks.py``), a zero range replaced by 1."""
    from rugosa.operators.ranks import weighted_quantiles

    p = len(poly_terms(model_inputs_np(np.ones((1, 3)), inputs).shape[1], degree))

    def values(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return poly_np(model_inputs_np(pdf[list(INPUTS)].to_numpy(np.float64), inputs), degree), state_weights(pdf, n_splits)

    read = summary.select(*INPUTS, *[f"n{k}" for k in range(n_splits)])
    q = weighted_quantiles(read, values, p, n_splits + 1, (0.25, 0.5, 0.75))
    spread_ = q[:, :, 2] - q[:, :, 0]
    return q[:, :, 1], np.where(spread_ < 10 * _EPS, 1.0, spread_)


def _yj_pass(summary: DataFrame, degree: int, n_splits: int, med, iqr, grids: np.ndarray,
             inputs: str = "engineered") -> np.ndarray:
    """Returns ``(S, p, G)`` log-likelihoods for per-(state, column) grids."""
    S, p, G = grids.shape

    def fn(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        poly = poly_np(model_inputs_np(pdf[list(INPUTS)].to_numpy(np.float64), inputs), degree)
        w = state_weights(pdf, n_splits)
        out = {}
        with np.errstate(all="ignore"):
            for s in range(S):
                ws = w[:, s]
                z = (poly - med[s]) / iqr[s]
                L = np.log1p(np.abs(z))
                slog = ws @ (np.sign(z) * L)
                acc = np.empty((3, p, G))
                for g in range(G):
                    t = yj_np(z, grids[s, :, g], L)
                    acc[0, :, g] = ws @ t
                    acc[1, :, g] = ws @ (t * t)
                    acc[2, :, g] = slog
                out[s] = np.concatenate([[ws.sum()], acc.ravel()])
        return out

    sums = partial_sums(summary, fn)
    ll = np.full((S, p, G), -np.inf)
    for s in range(S):
        v = sums[s]
        wtot = v[0]
        acc = v[1:].reshape(3, p, G)
        mean = acc[0] / wtot
        var = acc[1] / wtot - mean * mean
        with np.errstate(divide="ignore", invalid="ignore"):
            ll[s] = np.where(var > np.finfo(np.float64).tiny,
                             -wtot / 2.0 * np.log(var) + (grids[s] - 1.0) * acc[2], -np.inf)
    return ll


def _std_pass(summary: DataFrame, degree: int, n_splits: int, med, iqr, lam,
              inputs: str = "engineered") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and which columns are not constant. Columns are centred
    at their median by now, so plain sums of squares do not cancel."""
    S = n_splits + 1

    def fn(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        poly = poly_np(model_inputs_np(pdf[list(INPUTS)].to_numpy(np.float64), inputs), degree)
        w = state_weights(pdf, n_splits)
        out = {}
        for s in range(S):
            t = yj_np((poly - med[s]) / iqr[s], lam[s])
            out[s] = np.concatenate([[w[:, s].sum()], w[:, s] @ t, w[:, s] @ (t * t)])
        return out

    sums = partial_sums(summary, fn)
    p = med.shape[1]
    mean, sd, moving = np.zeros((S, p)), np.ones((S, p)), np.zeros((S, p), bool)
    for s in range(S):
        v = sums[s]
        m = v[1:1 + p] / v[0]
        var = np.maximum(v[1 + p:] / v[0] - m * m, 0.0)
        sdv = np.sqrt(var)
        mean[s] = m
        sd[s] = np.where(sdv == 0.0, 1.0, sdv)
        moving[s] = sdv > 0
    return mean, sd, moving


def fit_prep(summary: DataFrame, degree: int, n_splits: int = SETTINGS.n_splits,
             inputs: str = "engineered") -> Prep:
    """Fit the preprocessing of one polynomial degree for every state (four
    kinds of small passes over the distinct-input table)."""
    from rugosa.sources.experiments import assert_finite

    assert_finite(summary, list(INPUTS))
    med, iqr = robust_fold_stats(summary, degree, n_splits, inputs)
    S, p = med.shape

    def search(grids):
        ll = _yj_pass(summary, degree, n_splits, med, iqr, grids, inputs)
        best = ll.argmax(axis=2)
        return np.take_along_axis(grids, best[..., None], axis=2)[..., 0], best

    lo, hi, _ = SETTINGS.yj_grid
    base = np.linspace(lo, hi, 17)
    step = base[1] - base[0]
    lam, at = search(np.broadcast_to(base, (S, p, len(base))).copy())
    edge = (at == 0) | (at == len(base) - 1)
    # the best value lies beyond the grid: follow it
    while edge.any() and np.abs(lam).max() < YJ_LIMIT:
        wide = lam[..., None] + 4 * step * np.linspace(-1, 1, 9)[None, None, :]
        far, at = search(wide)
        lam, edge = np.where(edge, far, lam), edge & ((at == 0) | (at == 8))
    for _ in range(2):
        lam, _at = search(lam[..., None] + np.linspace(-step, step, 9)[None, None, :])
        step /= 4
    mean, sd, moving = _std_pass(summary, degree, n_splits, med, iqr, lam, inputs)
    return Prep(degree, med, iqr, lam, mean, sd, inputs, moving.sum(axis=1), moving)


def fit_preps(summary: DataFrame, degrees: Sequence[int], n_splits: int = SETTINGS.n_splits,
              inputs: str = "engineered") -> dict[int, Prep]:
    """The preprocessing of several degrees from one fit: columns are in degree-major
    order, so those of a lower degree are the first ones of the highest."""
    top = fit_prep(summary, max(degrees), n_splits, inputs)
    width = model_inputs_np(np.ones((1, 3)), inputs).shape[1]
    out = {}
    for d in sorted(set(degrees)):
        p = len(poly_terms(width, d))
        first = {k: getattr(top, k)[:, :p] for k in ("med", "iqr", "lam", "mean", "sd")}
        out[d] = Prep(d, **first, inputs=inputs, live=top.moving[:, :p].sum(axis=1), moving=top.moving[:, :p])
    return out


# --------------------------------------------------------------------------
# target transform of the SVR (Yeo-Johnson + standardise, per state, on rows)
# --------------------------------------------------------------------------

@dataclass
class TargetPrep:
    lam: np.ndarray   # (S,)
    mean: np.ndarray  # (S,)
    sd: np.ndarray    # (S,)

    def powers(self, states) -> dict[float, str]:
        """The different lambdas of some states, each with a column name."""
        return {lam: f"t{i}" for i, lam in enumerate(sorted({self.lam[s] for s in states}))}

    def forward(self, y: np.ndarray, state: int) -> np.ndarray:
        return (yj_np(y[:, None], np.array([self.lam[state]]))[:, 0] - self.mean[state]) / self.sd[state]

    def inverse(self, t: np.ndarray, state: int) -> np.ndarray:
        return yj_inverse_np(t * self.sd[state] + self.mean[state], float(self.lam[state]))


def fit_target_prep(folded: DataFrame, target: str, n_splits: int = SETTINGS.n_splits,
                    fold_col: str = "fold") -> TargetPrep:
    """Yeo-Johnson lambda (grid + refinement) and standardisation of the
    target for every state, from partial sums over the rows."""
    S = n_splits + 1
    rows = folded.select(F.col(target).alias("y"), F.col(fold_col).alias("fold"))
    lo, hi, n = SETTINGS.yj_grid
    # transformed values are summed less the transform of the mean: what is left is
    # of the size of their deviation, so that squares do not cancel
    y0 = np.array([rows.agg(F.avg("y")).first()[0] or 0.0])

    def grid_fn(grid_of_state):
        # states that share a grid share its evaluation: values are transformed once and
        # summed per fold, and a state adds the folds it trains on
        shared: dict[bytes, list[int]] = {}
        for s in range(S):
            shared.setdefault(np.asarray(grid_of_state[s], np.float64).tobytes(), []).append(s)

        def fn(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
            f = pdf["fold"].to_numpy()
            f = np.where((f >= 0) & (f < n_splits), f, n_splits).astype(np.int64)
            order = np.argsort(f, kind="stable")
            y, f = pdf["y"].to_numpy(np.float64)[order], f[order]
            first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            own = f[first]
            common = np.column_stack([np.ones(len(y)), np.sign(y) * np.log1p(np.abs(y))])
            out = {}
            for g, states in shared.items():
                g = np.frombuffer(g, np.float64)
                t = yj_np(y[:, None], g[None, :]) - yj_np(y0[:, None], g[None, :])
                sums = np.add.reduceat(np.hstack([common[:, :1], t, t * t, common[:, 1:]]), first, axis=0)
                for s in states:
                    out[s] = sums[own != s].sum(axis=0) if s < n_splits else sums.sum(axis=0)
            return out
        return fn

    def best_of(grids):
        sums = partial_sums(rows, grid_fn(grids))
        out = []
        for s in range(S):
            v = sums[s]
            G = len(grids[s])
            cnt, st, st2, slog = v[0], v[1:1 + G], v[1 + G:1 + 2 * G], v[-1]
            var = st2 / cnt - (st / cnt) ** 2
            with np.errstate(divide="ignore", invalid="ignore"):
                ll = np.where(var > np.finfo(np.float64).tiny, -cnt / 2 * np.log(var) + (grids[s] - 1) * slog, -np.inf)
            out.append(grids[s][int(np.argmax(ll))])
        return np.array(out)

    base = np.linspace(lo, hi, n)
    b1 = best_of([base] * S)
    step = base[1] - base[0]
    b2 = best_of([b + np.linspace(-step, step, 17) for b in b1])
    step /= 8
    lam = best_of([b + np.linspace(-step, step, 17) for b in b2])

    sums = partial_sums(rows, grid_fn(lam[:, None]))
    mean, sd = np.zeros(S), np.ones(S)
    for s in range(S):
        c, a, b = sums[s][:3]
        mean[s] = a / c + yj_np(y0, np.array([lam[s]]))[0]
        v = max(b / c - (a / c) ** 2, 0.0)
        sd[s] = np.sqrt(v) if v > 0 else 1.0
    return TargetPrep(lam, mean, sd)
