"""Kernel regressors as Spark jobs: feature maps plus distributed aggregates.

GP (M3-M6). Kernel ``amp * RBF(l) * RQ(alpha, 1) + white(noise)``. Its features are
taken at landmarks: inputs chosen by the leverage that is left over (a pivoted
Cholesky factorisation over a bounded pool of distinct inputs), which with no more
distinct inputs than landmarks gives the exact process. The alternative are random
Fourier features (Rahimi & Recht, 2007): the product's spectral measure is that of
``omega = z1 / l + sqrt(tau) z2`` with ``tau ~ Gamma(alpha, rate=alpha)``, drawn in
orthogonal blocks and strata of tau.
With features the GP becomes Bayesian linear regression: one pass accumulates
``Phi'W Phi``, ``Phi' y`` and ``Phi' 1`` per (model, training state) over the
distinct-input table; tasks take one eigendecomposition of each ``D x D`` Gram matrix,
solve ``(G + s/amp I) w = Phi' y~`` in its basis and score the marginal likelihood of
all amplitude/noise candidates there (the kernel-parameter refit the reference's
library runs inside ``fit``); only likelihoods and the winners' posteriors reach the
driver. Prediction: ``mean = phi' w``, ``var = s phi' A^-1 phi + noise`` (white noise
included) plus, for landmarks, the prior variance that they do not carry, undoing the
target normalisation.

SVR (M1-M2). RBF kernel ``exp(-gamma |x-x'|^2)`` -> ``omega ~ N(0, 2 gamma I)``.
Primal ``1/2 |w|^2 + C sum L(y~ - phi'w - b)`` with the eps-insensitive loss
smoothed over a width ``delta`` (Huber corner), on the Yeo-Johnson +
standardised target. Solved by damped Newton steps on the driver; each is ONE
pass over the rows that returns objective, gradient and Hessian of every open problem
(trials x training splits) at once, so a whole tuning study shares its scans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.functions.features import poly_terms
from rugosa.operators.linalg import gathered, partial_sums, summed
from rugosa.operators.preprocess import (
    INPUTS,
    Prep,
    TargetPrep,
    engineered_np,
    poly_np,
    state_weights,
    yj_np,
)
from rugosa.settings import SETTINGS


def _unique_inputs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = pdf[list(INPUTS)].to_numpy(np.float64)
    uniq, inv = np.unique(x, axis=0, return_inverse=True)
    return uniq, inv.ravel()


def rff(z: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Cosine features; with more phases than frequencies the frequencies repeat."""
    proj = z @ omega.T
    return np.sqrt(2.0 / len(phase)) * np.cos(np.tile(proj, len(phase) // len(omega)) + phase)


# ==========================================================================
# Gaussian process
# ==========================================================================

@dataclass
class GPSpec:
    amplitude: float = 1.0
    length_scale: float = 1.0
    alpha: float = 1.0
    noise: float = 1e-4


@dataclass
class GPState:
    """Posterior of one (spec, state): everything prediction needs."""
    spec: GPSpec
    amplitude: float
    noise: float
    y_mean: float
    y_std: float
    weights: np.ndarray
    root: np.ndarray        # root @ root.T is the inverse of A = G + (s/amp) I
    lml: float
    n: float
    projected: bool = False   # features project the kernel: what they miss is variance


@dataclass
class GPModel:
    prep: Prep
    specs: list[GPSpec]
    states: dict[tuple[int, int], GPState] = field(default_factory=dict)
    candidates: list[dict] = field(default_factory=list)
    features: dict[tuple[int, int], RandomFeatures | LandmarkFeatures] = field(default_factory=dict)
    given: dict[tuple[int, int], float] = field(default_factory=dict)   # likelihood of the kernel as given

    def mean_map(self, t: int, s: int) -> tuple:
        """(features, weights of their raw form, target mean, target deviation)."""
        st, features = self.states[t, s], self.features[t, s]
        white = features.whiten()
        bare = features if white is None else LandmarkFeatures(features.points, features.spec)
        return bare, st.weights if white is None else white @ st.weights, st.y_mean, st.y_std


def gamma_strata(alpha: float, count: int) -> np.ndarray:
    """The quantiles of a Gamma(alpha, rate alpha) variable at ``(i + 1/2) / count``,
    from its density on a grid of log values. They move smoothly with alpha."""
    low = (np.log(0.25 / count) + math.lgamma(alpha + 1)) / alpha - np.log(alpha)
    if alpha > 200:   # close to 1, with a deviation of 1 / sqrt(alpha)
        fine = np.linspace(np.log1p(-12 / np.sqrt(alpha)), np.log1p(12 / np.sqrt(alpha)), 4096)
    else:
        fine = np.linspace(max(low, -40.0), np.log((alpha + 12 * np.sqrt(alpha) + 40) / alpha), 4096)
    t = np.concatenate([np.linspace(low, fine[0], 512)[:-1], fine]) if low < fine[0] else fine
    density = np.exp(alpha * (t + np.log(alpha)) - math.lgamma(alpha) - alpha * np.exp(t))
    mass = np.concatenate([[0.0], np.cumsum(0.5 * (density[1:] + density[:-1]) * np.diff(t))])
    # what lies below the grid: the density is a pure power there
    mass += np.exp(alpha * (t[0] + np.log(alpha)) - math.lgamma(alpha + 1))
    return np.exp(np.interp((np.arange(count) + 0.5) / count, mass / mass[-1], t))


def orthogonal_directions(p: int, count: int, rng: np.random.Generator) -> np.ndarray:
    """``count`` vectors in blocks of ``p`` that are orthogonal to each other; each has
    the distribution of a standard normal vector (Yu et al., 2016)."""
    blocks = []
    for _ in range(-(-count // p)):
        q, r = np.linalg.qr(rng.standard_normal((p, p)))
        blocks.append((q * np.sign(np.diag(r))).T)
    length = np.linalg.norm(rng.standard_normal((count, p)), axis=1)
    return np.vstack(blocks)[:count] * length[:, None]


def gp_draws(p: int, n_features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and the order in which the strata of the RQ scale meet them."""
    rng = np.random.default_rng(seed)
    return orthogonal_directions(p, n_features // 2, rng), rng.permutation(n_features // 2)


def gp_frequencies(p: int, spec: GPSpec, n_features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of ``n_features / 2`` cosines and as many sines, and the phases of
    all features. Given the RQ scale tau, ``z1 / l + sqrt(tau) z2`` is one normal
    vector of variance ``1 / l^2 + tau``: directions come in orthogonal blocks, and
    tau takes the mid-quantiles of its law, so that few features carry the kernel."""
    z, order = gp_draws(p, n_features, seed)
    tau = gamma_strata(float(spec.alpha), len(z))[order]
    inverse = 1.0 / np.square(np.broadcast_to(np.asarray(spec.length_scale, np.float64), (p,)))
    phase = np.repeat([0.0, -0.5 * np.pi], len(z))
    return z * np.sqrt(inverse[None, :] + tau[:, None]), phase


class RandomFeatures:
    """phi(x) = sqrt(2 / D) cos(omega x + phase)."""

    def __init__(self, omega: np.ndarray, phase: np.ndarray):
        self.omega, self.phase = omega, phase

    def raw(self, z: np.ndarray) -> np.ndarray:
        return rff(z, self.omega, self.phase)

    __call__ = raw

    def whiten(self) -> np.ndarray | None:
        return None


def kernel_np(a: np.ndarray, b: np.ndarray, spec: GPSpec) -> np.ndarray:
    """RBF(l) * RQ(alpha, 1) without the amplitude; ``length_scale`` may hold one
    length per column."""
    def squared(u, v):
        return np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (u @ v.T), 0.0)

    r2 = squared(a, b)
    length = np.asarray(spec.length_scale, np.float64)
    scaled = r2 / (length * length) if length.ndim == 0 else squared(a / length, b / length)
    return np.exp(-0.5 * scaled - spec.alpha * np.log1p(r2 / (2.0 * spec.alpha)))


class LandmarkFeatures:
    """Features of a kernel at chosen inputs: ``phi(x) = k(x, Z) B`` with
    ``B B' = k(Z, Z)^-1`` (directions of no weight left out), so that ``phi phi'`` is
    the kernel itself between landmarks and its projection on them elsewhere."""

    #: Directions of k(Z, Z) below this part of the largest are left out.
    RANK = 1e-10

    def __init__(self, points: np.ndarray, spec: GPSpec):
        self.points, self.spec = points, spec
        self._white: np.ndarray | None = None

    def raw(self, z: np.ndarray) -> np.ndarray:
        return kernel_np(z, self.points, self.spec)

    def whiten(self) -> np.ndarray:
        if self._white is None:
            e, q = np.linalg.eigh(kernel_np(self.points, self.points, self.spec))
            live = e > self.RANK * e[-1]
            self._white = q[:, live] / np.sqrt(e[live])
        return self._white

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return self.raw(z) @ self.whiten()


#: Distinct inputs, taken in the order of a hash, among which landmarks are chosen.
LANDMARK_POOL = 2048
#: The kernel under which they are chosen: heavy tails, so that far apart comes first.
LANDMARK_KERNEL = GPSpec(1.0, 16.0, 0.125, 0.0)


def choose_landmarks(summary: DataFrame, prep: Prep, count: int, pool: int = LANDMARK_POOL) -> np.ndarray:
    """Raw inputs ``(Vc, Fz, ap)`` chosen one by one where the leverage left over (the
    part of the kernel that the ones chosen so far do not carry) is largest, as a
    pivoted Cholesky factorisation does. With ``count`` distinct inputs or fewer all
    of them are landmarks, and the process is the exact one."""
    rows = summary.select(*INPUTS).orderBy(F.xxhash64(*INPUTS), *INPUTS).limit(pool).collect()
    x = np.array([tuple(r) for r in rows], dtype=np.float64)
    z = prep.transform(prep.expand(x), prep.med.shape[0] - 1)
    left = np.ones(len(z))
    factor = np.zeros((min(count, len(z)), len(z)))
    chosen = []
    for i in range(len(factor)):
        at = int(np.argmax(left))
        if left[at] <= 1e-9:
            break
        k = kernel_np(z[at:at + 1], z, LANDMARK_KERNEL)[0]
        factor[i] = (k - factor[:i].T @ factor[:i, at]) / np.sqrt(left[at])
        left = np.maximum(left - factor[i] ** 2, 0.0)
        left[at] = 0.0
        chosen.append(at)
    return x[chosen]


# candidates of the marginal-likelihood refit (M6). Amplitude and noise are
# scanned on absolute half decades, from one eigendecomposition per Gram matrix;
# length scales and RQ alphas are multipliers of the initial value, and the scan
# goes on beyond an end where the best value stands, up to KERNEL_BOUNDS
REFIT_LENGTH_MULT = (1.0, 2.0, 4.0, 8.0, 16.0)
REFIT_ALPHA_MULT = (0.125, 0.5, 2.0, 8.0)
REFIT_AMP = tuple(float(10.0 ** (e / 2.0)) for e in range(-6, 9))
REFIT_NOISE = tuple(float(10.0 ** (e / 2.0)) for e in range(-10, 3))
KERNEL_BOUNDS = (1e-5, 1e5)


def _best_scales(e: np.ndarray, c: np.ndarray, yy: float, n: float, amps, noises, missed: float = 0.0) -> tuple[float, float, float]:
    """(log marginal likelihood, amplitude, noise) of the best pair, given the
    eigenvalues ``e`` of the Gram matrix and the target sums ``c`` in its basis.
    ``missed`` is the prior variance (at amplitude 1, over all rows) that projected
    features leave out: with it the value is a lower bound of the exact likelihood
    (Titsias, 2009), and equal to it where nothing is missed."""
    d = len(e)
    best = (-np.inf, amps[0], noises[0])
    for noise in noises:
        s = noise + SETTINGS.gp_jitter
        ratio = s / np.asarray(amps)[:, None]
        shifted = e[None, :] + ratio
        quad = (yy - np.sum(c * c / shifted, axis=1)) / s
        lml = -0.5 * (quad + (n - d) * np.log(s) + d * np.log(amps) + np.sum(np.log(shifted), axis=1) + n * np.log(2 * np.pi))
        lml = lml - 0.5 * missed * np.asarray(amps) / s
        i = int(np.argmax(lml))
        if lml[i] > best[0]:
            best = (float(lml[i]), float(amps[i]), float(noise))
    return best


def _gram_table(summary: DataFrame, prep: Prep, variants: dict, n_splits: int) -> DataFrame:
    """Per variant, numbered in their order (``(spec, state, ...) -> feature map``):
    upper triangle of the weighted Gram matrix, target sums, feature sums and the
    state's moments ``(n, sum y, sum y^2)``."""
    keys = list(variants)
    maps = list(variants.values())
    states = sorted({k[1] for k in keys})

    def fn(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        poly = prep.expand(pdf[list(INPUTS)].to_numpy(np.float64))
        w, sy, syy = state_targets(pdf, n_splits)
        out = {}
        for s in states:
            z = prep.transform(poly, s)
            moments = [w[:, s].sum(), sy[:, s].sum(), syy[:, s].sum()]   # of targets less y0
            for i, (_, state, *_rest) in enumerate(keys):
                if state == s:
                    phi = maps[i].raw(z)
                    gram = phi.T @ (phi * w[:, s][:, None])
                    out[i] = np.concatenate([gram[np.triu_indices(len(gram))], phi.T @ sy[:, s], phi.T @ w[:, s], moments])
        return out

    return summed(summary, fn)


def state_targets(pdf: pd.DataFrame, n_splits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x states: training weight, sum of targets and of their squares."""
    out = []
    for stem in ("n", "sy", "syy"):
        own = np.column_stack([pdf[f"{stem}{k}"].to_numpy(np.float64) for k in range(n_splits)])
        total = own.sum(1, keepdims=True)
        out.append(np.hstack([total - own, total]))
    return tuple(out)


def solve_gram(vec: np.ndarray, features, amps, noises) -> dict:
    """From the sums of :func:`_gram_table`: the best amplitude and noise, their log
    marginal likelihood, and the posterior (weights; root @ root.T is the inverse of
    G + (s / amp) I)."""
    W, SY, SYY = vec[-3:]
    D = math.isqrt(2 * (len(vec) - 3) + 6) - 2   # len - 3 = D (D + 1) / 2 + 2 D
    upper = np.triu_indices(D)
    mu = SY / W
    var = max(SYY / W - mu * mu, 0.0)
    sd = np.sqrt(var) if var > 0 else 1.0
    G = np.zeros((D, D))
    G[upper] = vec[:len(upper[0])]
    G = G + np.triu(G, 1).T
    u, one = vec[len(upper[0]):-3].reshape(2, D)
    u = (u - mu * one) / sd
    white, missed = features.whiten(), 0.0
    if white is not None:
        G, u = white.T @ G @ white, white.T @ u
        missed = max(W - np.trace(G), 0.0)
    e, Q = np.linalg.eigh(G)
    e = np.maximum(e, 0.0)
    c = Q.T @ u
    yy = (SYY - 2 * mu * SY + mu * mu * W) / (sd * sd)
    lml, amp, noise = _best_scales(e, c, yy, W, amps, noises, missed)
    shifted = e + (noise + SETTINGS.gp_jitter) / amp
    return {"lml": lml, "amplitude": amp, "noise": noise, "y_mean": mu, "y_std": sd, "n": float(W),
            "weights": Q @ (c / shifted), "root": Q / np.sqrt(shifted)}


_SOLVED = "key int, lml double, amplitude double, noise double, y_mean double, y_std double, n double, weights binary, root binary"


def _solved(table: DataFrame, maps: dict, scales: dict[int, tuple], full: bool, tasks: int, y0: float) -> list:
    """The Gram matrices are dealt to tasks and decomposed there; the posterior comes
    along where ``full`` asks for it."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, body in zip(pdf["key"], pdf["vec"], strict=True):
                got = solve_gram(np.frombuffer(body, dtype=np.float64), maps[int(key)], *scales[int(key)])
                got["y_mean"] += y0
                got["weights"] = got["weights"].tobytes() if full else None
                got["root"] = got["root"].tobytes() if full else None
                rows.append({"key": key, **got})
            if rows:
                yield pd.DataFrame(rows)

    return table.repartition(max(tasks, 1)).mapInPandas(run, _SOLVED).collect()


class GPSearch:
    """Evaluates kernels of many (spec, state) problems, one pass over the
    distinct-input table for all that are asked for at once, and remembers the best
    of each. The sums of every pass stay in a table, from which the winners'
    posteriors are taken at the end."""

    def __init__(self, summary: DataFrame, prep: Prep, specs: Sequence[GPSpec], n_splits: int, n_features: int, seed: int, refit: bool, random: bool):
        self.summary, self.prep, self.specs = summary, prep, list(specs)
        self.landmarks = None if random else choose_landmarks(summary, prep, n_features)
        self.n_splits, self.D, self.seed, self.refit = n_splits, n_features, seed, refit
        self.best: dict[tuple[int, int], tuple] = {}   # (lml, length, alpha, amplitude, noise)
        self.first: dict[tuple[int, int], float] = {}  # likelihood of the kernel as given
        self.candidates: list[dict] = []
        self._seen: set = set()
        self._points: dict[int, np.ndarray] = {}
        self._held: list[tuple[DataFrame, list, dict, dict]] = []
        self._y0 = (summary.select("y0").first() or [0.0])[0]
        self._tasks = 2 * summary.sparkSession.sparkContext.defaultParallelism

    def feature_map(self, state: int, spec: GPSpec) -> RandomFeatures | LandmarkFeatures:
        if self.landmarks is None:
            return RandomFeatures(*gp_frequencies(self.prep.width, spec, self.D, self.seed))
        if state not in self._points:   # one array for all kernels of a state
            self._points[state] = self.prep.transform(self.prep.expand(self.landmarks), state)
        return LandmarkFeatures(self._points[state], spec)

    def evaluate(self, wanted: Sequence[tuple]) -> None:
        """``wanted``: (spec, state, length scale, alpha)."""
        from rugosa.session import materialize

        new = [k for k in dict.fromkeys((t, s, _key(le), float(al)) for t, s, le, al in wanted) if k not in self._seen]
        self._seen.update(new)
        if not new:
            return
        kernels = {k: GPSpec(self.specs[k[0]].amplitude, np.array(k[2]) if isinstance(k[2], tuple) else k[2], k[3], self.specs[k[0]].noise) for k in new}
        maps = {k: self.feature_map(k[1], sp) for k, sp in kernels.items()}
        scales = {}
        for i, k in enumerate(new):
            sp = kernels[k]
            scales[i] = (sorted({sp.amplitude, *REFIT_AMP}), sorted({sp.noise, *REFIT_NOISE})) if self.refit else ([sp.amplitude], [sp.noise])
        table = materialize(_gram_table(self.summary, self.prep, maps, self.n_splits), checkpoint=True)
        numbered = dict(enumerate(maps.values()))
        self._held.append((table, new, numbered, scales))
        for r in sorted(_solved(table, numbered, scales, False, min(len(new), self._tasks), self._y0), key=lambda r: r["key"]):
            k = new[r["key"]]
            t, s, le, al = k
            self.candidates.append({"spec": t, "state": s, "length_scale": kernels[k].length_scale, "alpha": al,
                                    "amplitude": r["amplitude"], "noise": r["noise"], "lml": r["lml"]})
            self.first.setdefault((t, s), r["lml"])
            if (t, s) not in self.best or r["lml"] > self.best[t, s][0]:
                self.best[t, s] = (r["lml"], le, al, r["amplitude"], r["noise"])

    def posteriors(self) -> dict[tuple[int, int], tuple[GPState, RandomFeatures | LandmarkFeatures]]:
        """State and features of the best kernel of every problem."""
        out = {}
        for table, keys, maps, scales in self._held:
            won = {i: k for i, k in enumerate(keys) if self.best[k[0], k[1]][1:3] == (k[2], k[3])}
            if not won:
                continue
            rows = _solved(table.where(F.col("key").isin(list(won))), maps, scales, True, min(len(won), self._tasks), self._y0)
            for r in rows:
                t, s, le, al = won[r["key"]]
                spec = GPSpec(self.specs[t].amplitude, np.array(le) if isinstance(le, tuple) else le, al, self.specs[t].noise)
                weights = np.frombuffer(r["weights"])
                root = np.frombuffer(r["root"]).reshape(len(weights), len(weights))
                out[t, s] = (GPState(spec, r["amplitude"], r["noise"], r["y_mean"], r["y_std"], weights, root, r["lml"], r["n"], self.landmarks is not None),
                             maps[r["key"]])
        return out


def _key(length) -> float | tuple:
    """A length scale, or one for each input, as something that can be looked up."""
    return float(length) if np.ndim(length) == 0 else tuple(float(v) for v in length)


def _follow(search: GPSearch, every: list, wanted, at, reach: tuple[float, float], bound) -> None:
    """Evaluate multipliers beyond an end of a scan for as long as a best value stands
    there: ``at(t, s)`` is the best multiplier, ``bound(t, s)`` its base value. A pass
    reaches further by five factors of 4."""
    low, high = reach
    while True:
        more = []
        for t, s in every:
            m, base = at(t, s), bound(t, s)
            if m >= high:
                more += [wanted(t, s, high * f) for f in FURTHER if base * high * f <= KERNEL_BOUNDS[1]]
            if m <= low:
                more += [wanted(t, s, low / f) for f in FURTHER if base * low / f >= KERNEL_BOUNDS[0]]
        if not more:
            return
        search.evaluate(more)
        low, high = low / FURTHER[-1], high * FURTHER[-1]


#: Beyond an end of a scan, and then around the best value.
FURTHER = (4.0, 16.0, 64.0, 256.0, 1024.0)
CLOSER = (0.5, 2 ** -0.5, 2 ** 0.5, 2.0)


def fit_gp(summary: DataFrame, prep: Prep, specs: Sequence[GPSpec], n_splits: int = SETTINGS.n_splits,
           n_features: int = SETTINGS.gp_features, seed: int = SETTINGS.seed,
           refit: bool = True, states: Sequence[int] | None = None,
           length_mult: Sequence[float] = REFIT_LENGTH_MULT,
           alpha_mult: Sequence[float] = REFIT_ALPHA_MULT, random: bool = False) -> GPModel:
    """M3 + M6: fit every spec on every training state; each pass over the
    distinct-input table (``input_summary``) evaluates all open candidates. With
    ``refit`` the kernel is re-selected by marginal likelihood, as the
    reference's library does inside ``fit``: length scales first, then finer
    steps, then the RQ alpha at the chosen length and finer steps; amplitude and
    noise come from the eigendecomposition of each candidate's Gram matrix, taken in
    tasks. All specs share their landmarks (or, with ``random``, their random draws),
    so they are compared on equal terms."""
    states = list(range(n_splits + 1)) if states is None else list(states)
    every = [(t, s) for t in range(len(specs)) for s in states]
    search = GPSearch(summary, prep, specs, n_splits, n_features, seed, refit, random)
    length = lambda t: np.asarray(specs[t].length_scale, np.float64)
    lengths = tuple(dict.fromkeys((1.0, *length_mult))) if refit else (1.0,)
    search.evaluate([(t, s, length(t) * m, specs[t].alpha) for t, s in every for m in lengths])
    if refit and len(lengths) > 1:
        multiple = lambda t, s: float(np.max(search.best[t, s][1])) / float(np.max(length(t)))
        _follow(search, every, lambda t, s, m: (t, s, length(t) * m, specs[t].alpha), lambda t, s: _near(multiple(t, s)),
                (min(lengths), max(lengths)), lambda t, s: float(np.max(length(t))))
        # finer around the best length, and the scan of alpha there
        chosen = {k: np.asarray(search.best[k][1]) for k in every}
        search.evaluate([(t, s, chosen[t, s] * f, specs[t].alpha) for t, s in every for f in CLOSER]
                        + [(t, s, chosen[t, s], specs[t].alpha * m) for t, s in every for m in alpha_mult])
        chosen = {k: np.asarray(search.best[k][1]) for k in every}
        if alpha_mult:
            _follow(search, every, lambda t, s, m: (t, s, chosen[t, s], specs[t].alpha * m), lambda t, s: _near(search.best[t, s][2] / specs[t].alpha),
                    (min((1.0, *alpha_mult)), max((1.0, *alpha_mult))), lambda t, s: specs[t].alpha)
            search.evaluate([(t, s, search.best[t, s][1], search.best[t, s][2] * f) for t, s in every for f in CLOSER
                             if KERNEL_BOUNDS[0] <= search.best[t, s][2] * f <= KERNEL_BOUNDS[1]])
    return gp_model(search)


def _near(m: float) -> float:
    """A multiplier without the rounding of the product it was taken from."""
    return float(f"{m:.12g}")


def gp_model(search: GPSearch) -> GPModel:
    model = GPModel(search.prep, search.specs)
    for k, (state, features) in search.posteriors().items():
        model.states[k], model.features[k] = state, features
    model.candidates, model.given = search.candidates, dict(search.first)
    return model


def gp_predict_np(model: GPModel, t: int, s: int, poly: np.ndarray, with_std: bool = True):
    st = model.states[(t, s)]
    z = model.prep.transform(poly, s)
    phi = model.features[(t, s)](z)
    mean = phi @ st.weights * st.y_std + st.y_mean
    if not with_std:
        return mean, None
    s_n = st.noise + SETTINGS.gp_jitter
    var = s_n * np.sum((phi @ st.root) ** 2, axis=1) + st.noise
    if st.projected:
        var = var + st.amplitude * np.maximum(1.0 - np.sum(phi * phi, axis=1), 0.0)
    return mean, np.sqrt(np.maximum(var, 0.0)) * st.y_std


# ==========================================================================
# Support vector regression
# ==========================================================================

@dataclass
class SVRSpec:
    C: float = 1.5
    epsilon: float = 0.2
    gamma: float | str = "scale"
    poly_degree: int = 2


@dataclass
class SVRModel:
    preps: dict[int, Prep]
    target: TargetPrep
    specs: list[SVRSpec]
    problems: list[tuple[int, int]]           # (spec index, state)
    proj: dict[int, np.ndarray]               # degree -> (D, p) standard normals
    phase: np.ndarray
    theta: np.ndarray                         # (M, D + 1)
    objective: np.ndarray
    gap: np.ndarray                           # bound on the relative distance to the optimum
    iterations: int

    def gamma(self, t: int, s: int) -> float:
        g = self.specs[t].gamma
        return self.preps[self.specs[t].poly_degree].gamma_scale(s) if g == "scale" else float(g)

    def index(self, t: int, s: int) -> int:
        return self.problems.index((t, s))


def _huber_eps(r: np.ndarray, eps: np.ndarray, delta: float):
    """Loss, slope and curvature of the smoothed eps-insensitive loss, and the
    curvature of a quadratic above its linear part (for the first steps)."""
    a = np.abs(r) - eps
    quad = (a > 0) & (a <= delta)
    lin = a > delta
    loss = np.where(quad, a * a / (2 * delta), np.where(lin, a - delta / 2, 0.0))
    d = np.where(quad, a / delta, np.where(lin, 1.0, 0.0)) * np.sign(r)
    return loss, d, np.where(quad, 1.0 / delta, 0.0), np.where(lin, 1.0 / np.maximum(a, delta), 0.0)


#: Rows that are gathered before distinct inputs are taken, and inputs of a piece.
TABLE_ROWS, TABLE_INPUTS = 100_000, 4096


def _svr_table(rows: DataFrame, model: SVRModel) -> DataFrame:
    """One row per distinct input and piece of a partition: the projections of every
    (degree, state), and the folds and targets (ascending) of that input, the targets
    transformed, for each power that a state has, but not yet standardised.
    Computed once; every Newton pass reads it. No key is shuffled, so an input that
    holds a third of all rows is spread like any other."""
    combos = sorted({(model.specs[t].poly_degree, s) for t, s in model.problems})
    preps, proj = model.preps, model.proj
    powers = model.target.powers({s for _, s in model.problems})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in gathered(it, TABLE_ROWS):
            uniq, inv = _unique_inputs(pdf)
            y, fold = pdf["y"].to_numpy(np.float64), pdf["fold"].to_numpy(np.int32)
            order = np.lexsort((y, inv))
            cuts = np.cumsum(np.bincount(inv, minlength=len(uniq)))[:-1]
            folds = np.split(fold[order], cuts)
            ys = {name: np.split(yj_np(y[order][:, None], np.array([lam]))[:, 0], cuts) for lam, name in powers.items()}
            for at in range(0, len(uniq), TABLE_INPUTS):
                piece = slice(at, at + TABLE_INPUTS)
                out = {**{name: v[piece] for name, v in ys.items()}, "fold": folds[piece]}
                eng = engineered_np(uniq[piece])
                for d in sorted({d for d, _ in combos}):
                    poly = poly_np(eng, d)
                    for s in (s for e, s in combos if e == d):
                        out[f"b{d}_{s}"] = list(preps[d].transform(poly, s) @ proj[d].T)
                yield pd.DataFrame(out)

    from rugosa.session import ship_package

    ship_package(rows.sparkSession)
    schema = "".join(f"{name} array<double>, " for name in powers.values()) + "fold array<int>, " + ", ".join(
        f"b{d}_{s} array<double>" for d, s in combos)
    return rows.select(*INPUTS, "y", "fold").mapInPandas(run, schema)


class _SortedTargets:
    """Targets of several inputs, ascending within each, with running sums: what the
    loss of all rows of an input needs at any prediction are counts, sums and sums of
    squares between its corners. The work is a search per input, not a pass over the
    rows. Targets are taken less the mean of their input, so that running sums stay
    small. Without repeated inputs a pass over the rows is the shorter way; targets that are
    missing are left to it, too."""

    #: Mean number of rows of an input from which the running sums are used.
    REPEATS = 8
    #: For the curvature above linear parts targets lie in cells: cells of a width of
    #: ``delta``, powers of the distance from a cell's middle that are summed (what is
    #: left out is below 1e-9 of a cell), rows of a cell from which that is shorter.
    CELLS, POWERS, FILLED = 8, 7, 16

    def __init__(self, yt: np.ndarray, iv: np.ndarray, inputs: int):
        self.yt, self.iv, self.inputs = yt, iv, inputs
        self.direct = len(yt) < self.REPEATS * inputs or not np.isfinite(yt).all()
        if not self.direct:
            n = np.bincount(iv, minlength=inputs)
            self.mean = np.bincount(iv, weights=yt, minlength=inputs) / np.maximum(n, 1)
            self.stop = np.cumsum(n)
            self.start = self.stop - n
            self.rounds = int(n.max()).bit_length()
            self.y = yt - self.mean[iv]
            self.s1 = np.concatenate([[0.0], np.cumsum(self.y)])
            self.s2 = np.concatenate([[0.0], np.cumsum(self.y * self.y)])

    def _fill(self, delta: float) -> None:
        """The cells (input, middle, first and last row) and running sums of powers."""
        self.half = delta / (2 * self.CELLS)
        cell = np.floor(self.y / (2 * self.half))
        new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (self.iv[1:] != self.iv[:-1])])
        self.cells = None
        if len(self.y) >= self.FILLED * len(new):
            stop = np.r_[new[1:], len(self.y)]
            middle = (cell[new] + 0.5) * (2 * self.half)
            t = (self.y - np.repeat(middle, stop - new)) / self.half
            power, sums = np.ones(len(t)), []
            for _ in range(self.POWERS):
                power = power * t
                sums.append(np.concatenate([[0.0], np.cumsum(power)]))
            self.cells = (self.iv[new], middle, new, stop, sums)
        self.filled = delta

    def _inverses(self, q: np.ndarray, eps: float, delta: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per input the sum of ``1 / a`` over the rows of the linear parts, ``a`` what
        they are beyond ``eps`` of ``q``; rows before ``low`` and from ``high`` on."""
        if getattr(self, "filled", None) != delta:
            self._fill(delta)
        if self.cells is None:
            a = np.abs(self.y - q[self.iv]) - eps
            above = np.divide(1.0, a, out=np.zeros_like(a), where=a > delta)
            return np.bincount(self.iv, weights=above, minlength=self.inputs)
        of, middle, start, stop, sums = self.cells
        out = np.zeros(self.inputs)
        for sign, first, last in ((1.0, np.maximum(start, high[of]), stop), (-1.0, start, np.minimum(stop, low[of]))):
            use = np.flatnonzero(first < last)
            if len(use):
                a, b, i = first[use], last[use], of[use]
                far = sign * (middle[use] - q[i]) - eps
                ratio, term = -sign * self.half / far, np.ones(len(use))
                total = (b - a).astype(np.float64)
                for s in sums:   # 1 / (far + t) as a series in t / far
                    term = term * ratio
                    total += term * (s[b] - s[a])
                out += np.bincount(i, weights=total / far, minlength=self.inputs)
        return out

    def _rank(self, q: np.ndarray, right: bool) -> np.ndarray:
        """Position of every ``q`` (inputs x any) among the targets of its input."""
        lo = np.repeat(self.start[:, None], q.shape[1], axis=1)
        hi = np.repeat(self.stop[:, None], q.shape[1], axis=1)
        last = len(self.y) - 1
        for _ in range(self.rounds):
            mid = (lo + hi) >> 1
            v = self.y[np.minimum(mid, last)]
            up = ((v <= q) if right else (v < q)) & (lo < hi)
            lo, hi = np.where(up, mid + 1, lo), np.where(up, hi, mid)
        return lo

    def _between(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, sum and sum of squares of the targets from position a to b, less c."""
        n = (b - a).astype(np.float64)
        s1, s2 = self.s1[b] - self.s1[a], self.s2[b] - self.s2[a]
        return n, s1 - n * c, np.maximum(s2 - 2 * c * s1 + n * c * c, 0.0)

    def sums(self, pred: np.ndarray, eps: float, delta: float, steep: bool):
        """For predictions (inputs x candidates): the summed loss of every candidate,
        and slope and curvature of the first, summed per input (``_huber_eps``)."""
        if self.direct:
            loss, dl, curv, above = _huber_eps(self.yt - pred[self.iv, 0], eps, delta)
            losses = [loss.sum(), *(_huber_eps(self.yt - pred[self.iv, j], eps, delta)[0].sum() for j in range(1, pred.shape[1]))]
            if steep:
                curv = curv + above
            return (np.array(losses), np.bincount(self.iv, weights=dl, minlength=self.inputs),
                    np.bincount(self.iv, weights=curv, minlength=self.inputs))
        q = pred - self.mean[:, None]
        start = np.repeat(self.start[:, None], q.shape[1], axis=1)
        stop = np.repeat(self.stop[:, None], q.shape[1], axis=1)
        low, near_low = np.split(self._rank(np.hstack([q - eps - delta, q - eps]), False), 2, axis=1)
        near_high, high = np.split(self._rank(np.hstack([q + eps, q + eps + delta]), True), 2, axis=1)
        n1, a1, _ = self._between(start, low, q - eps)       # below: linear
        n2, a2, b2 = self._between(low, near_low, q - eps)   # below: quadratic
        n3, a3, b3 = self._between(near_high, high, q + eps)
        n4, a4, _ = self._between(high, stop, q + eps)
        loss = (b2 + b3) / (2 * delta) + (-a1 - n1 * delta / 2) + (a4 - n4 * delta / 2)
        slope = (a2 + a3)[:, 0] / delta + n4[:, 0] - n1[:, 0]
        curv = (n2 + n3)[:, 0] / delta
        if steep and (n1[:, 0].any() or n4[:, 0].any()):
            curv = curv + self._inverses(q[:, 0], eps, delta, low[:, 0], high[:, 0])
        return loss.sum(axis=0), slope, curv


#: Step lengths whose objective a pass compares; derivatives come with the first.
SVR_STEPS = (1.0, 2.5, 0.4, 0.15)


def _svr_pass_fn(model: SVRModel, work: dict[int, tuple[np.ndarray, bool]], gammas: np.ndarray,
                 n_splits: int, delta: float):
    """Per open problem: the loss at every candidate (columns of the matrix), and
    gradient and packed Hessian of the loss at the first. The flag asks for the
    curvature above linear parts, too."""
    specs, problems, target, phase = model.specs, model.problems, model.target, model.phase
    D = phase.shape[0]
    powers = target.powers({s for _, s in problems})
    by_ds: dict[tuple[int, int], list[int]] = {}
    for m in sorted(work, key=lambda m: problems[m][1]):   # targets of one state at a time
        t, s = problems[m]
        by_ds.setdefault((specs[t].poly_degree, s), []).append(m)
    upper = np.triu_indices(D + 1)

    def fn(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        folds = pdf["fold"].tolist()
        fold = np.concatenate(folds)
        of = np.repeat(np.arange(len(folds)), [len(v) for v in folds])
        ys = {}
        out = {}
        at, targets = None, None
        for (d, s), ms in by_ds.items():
            if s != at:
                at = s
                rows = (fold != s) if s < n_splits else np.ones(len(fold), bool)
                name = powers[target.lam[s]]
                if name not in ys:
                    ys[name] = np.concatenate(pdf[name].tolist())
                targets = _SortedTargets((ys[name][rows] - target.mean[s]) / target.sd[s], of[rows], len(folds)) if rows.any() else None
            if targets is None:
                continue
            base = np.stack(pdf[f"b{d}_{s}"].to_numpy())   # (u, D)
            for m in ms:
                C, eps = specs[problems[m][0]].C, specs[problems[m][0]].epsilon
                thetas, steep = work[m]
                phi = np.empty((len(base), D + 1))
                phi[:, :D] = np.sqrt(2.0 / D) * np.cos(np.sqrt(2.0 * gammas[m]) * base + phase)
                phi[:, D] = 1.0
                losses, g, h = targets.sums(phi @ thetas, eps, delta, steep)
                hess = phi.T @ (phi * h[:, None])
                out[m] = C * np.concatenate([losses, -(phi.T @ g), hess[upper]])
        return out

    return fn


def fit_svr(rows: DataFrame, preps: dict[int, Prep], target: TargetPrep, specs: Sequence[SVRSpec],
            states: Sequence[int], n_splits: int = SETTINGS.n_splits,
            n_features: int = SETTINGS.svr_features, seed: int = SETTINGS.seed,
            delta: float = SETTINGS.svr_huber_delta, tol: float = 1e-6, give_up: int = 200) -> SVRModel:
    """M1: fit every (spec, state) problem by damped Newton steps; ``rows`` has
    columns ``Vc, Fz, ap, y, fold``. A pass serves the problems that are still open:
    it returns objective, gradient and D x D Hessian at the next point of each, and
    the objectives of a longer and two shorter steps, so that a step that fails
    costs one pass more, not one for every halving.

    The objective is 1-strongly convex in the weights, so ``|g|^2 / 2`` bounds
    its distance to the optimum; a problem is solved when that is at most ``tol``
    times the objective, and a fit that does not get there raises."""
    from rugosa.session import materialize

    D = n_features
    rng = np.random.default_rng(seed + 7)
    degrees = sorted({sp.poly_degree for sp in specs})
    proj = {d: rng.standard_normal((D, preps[d].width)) for d in degrees}
    phase = rng.uniform(0.0, 2.0 * np.pi, D)
    problems = [(t, s) for t in range(len(specs)) for s in states]
    M = len(problems)
    model = SVRModel(dict(preps), target, list(specs), problems, proj, phase,
                     np.zeros((M, D + 1)), np.zeros(M), np.zeros(M), 0)
    gammas = np.array([model.gamma(t, s) for t, s in problems])
    data = materialize(_svr_table(rows, model))
    upper = np.triu_indices(D + 1)
    own = np.concatenate([np.ones(D), [0.0]])   # the regulariser spares the offset
    state = [_SVRState(np.zeros(D + 1)) for _ in range(M)]

    def evaluate(work: dict[int, tuple[np.ndarray, bool]]) -> dict[int, tuple]:
        sums = partial_sums(data, _svr_pass_fn(model, work, gammas, n_splits, delta))
        out = {}
        for m, (thetas, _) in work.items():
            J = thetas.shape[1]
            v = sums.get(m, np.zeros(J + D + 1 + len(upper[0])))
            h = np.zeros((D + 1, D + 1))
            h[upper] = v[J + D + 1:]
            h += np.triu(h, 1).T
            f = v[:J] + 0.5 * np.sum((own[:, None] * thetas) ** 2, axis=0)
            out[m] = (f, v[J:J + D + 1] + own * thetas[:, 0], h + np.diag(own))
        return out

    def gap(st):
        return 0.5 * float(st.g @ st.g) / max(abs(st.f), 1e-12)

    try:
        for m, (f, g, h) in evaluate({m: (state[m].x[:, None], True) for m in range(M)}).items():
            state[m].take(state[m].x, f[0], g, h)
            state[m].ridge = 1e-9 * max(np.trace(h), 1.0)
        for it in range(1, give_up + 2):
            open_ = [m for m in range(M) if gap(state[m]) > tol]
            if not open_:
                break
            if it > give_up:
                raise RuntimeError(f"SVR fit did not converge: relative gaps up to {max(gap(st) for st in state):.3g}")
            got = evaluate({m: state[m].candidates() for m in open_})
            for m, (f, g, h) in got.items():
                state[m].step(f, g, h)
            model.iterations = it
    finally:
        data.unpersist(blocking=False)
    model.theta = np.stack([st.x for st in state])
    model.objective = np.array([st.f for st in state])
    model.gap = np.array([gap(st) for st in state])
    return model


class _SVRState:
    """Newton state of one problem between passes."""

    def __init__(self, x: np.ndarray):
        self.x, self.f, self.g, self.h = x, np.inf, None, None
        self.steep, self.scale, self.ridge = True, 1.0, 0.0
        self.move: np.ndarray | None = None      # a point chosen by its objective alone
        self.tried: list[np.ndarray] = []
        self.slope = 0.0

    def take(self, x: np.ndarray, f: float, g: np.ndarray, h: np.ndarray) -> None:
        self.x, self.f, self.g, self.h = x, float(f), g, h
        self.scale, self.move = 1.0, None

    def candidates(self) -> tuple[np.ndarray, bool]:
        if self.move is not None:
            self.tried = [self.move]
        else:
            step = -np.linalg.solve(self.h + self.ridge * np.eye(len(self.g)), self.g)
            self.slope = float(self.g @ step)
            self.tried = [self.x + self.scale * a * step for a in SVR_STEPS]
        return np.column_stack(self.tried), self.steep

    def step(self, f: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        if self.move is not None:
            self.take(self.move, f[0], g, h)
            return
        lengths = self.scale * np.array(SVR_STEPS)
        good = f <= self.f + 1e-4 * lengths * self.slope
        best = int(np.argmin(np.where(good, f, np.inf)))
        if good[0] and self.f - f[0] >= 0.6 * (self.f - f[best]):
            # plain Newton once steps gain little
            self.steep = self.steep and self.f - f[0] >= 0.05 * abs(self.f)
            self.take(self.tried[0], f[0], g, h)
        elif good.any():
            self.steep = self.steep or not good[0]   # back to the careful curvature where steps fail
            self.move = self.tried[best]
        else:
            self.steep = True
            self.scale *= 0.05


def svr_predict_np(model: SVRModel, t: int, s: int, eng: np.ndarray, polys: dict | None = None) -> np.ndarray:
    d = model.specs[t].poly_degree
    poly = polys[d] if polys is not None and d in polys else poly_np(eng, d)
    z = model.preps[d].transform(poly, s)
    D = model.phase.shape[0]
    g = np.sqrt(2.0 * model.gamma(t, s))
    phi = np.sqrt(2.0 / D) * np.cos(g * (z @ model.proj[d].T) + model.phase)
    th = model.theta[model.index(t, s)]
    return model.target.inverse(phi @ th[:D] + th[D], s)


#: Predictions taken at once by :func:`svr_swapped_np`.
SWAP_ROWS = 8192


def svr_swapped_np(model: SVRModel, t: int, s: int, eng: np.ndarray):
    """A function ``(j, rows, values) -> predictions`` of the rows of ``eng`` with input
    j replaced: only the terms that hold j are expanded and transformed again, and the
    projection of a row is moved by what they change."""
    d, D = model.specs[t].poly_degree, model.phase.shape[0]
    prep, proj, th = model.preps[d], model.proj[d], model.theta[model.index(t, s)]
    terms = poly_terms(eng.shape[1], d)
    z = prep.transform(poly_np(eng, d), s)
    base, g = z @ proj.T, np.sqrt(2.0 * model.gamma(t, s))

    def run(j: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        held = [i for i, term in enumerate(terms) if j in term]
        med, iqr, lam, mean, sd = (v[s, held] for v in (prep.med, prep.iqr, prep.lam, prep.mean, prep.sd))
        move = np.ascontiguousarray(proj[:, held].T)
        out = np.empty(len(rows))
        for at in range(0, len(rows), SWAP_ROWS):
            r = rows[at:at + SWAP_ROWS]
            x = eng[r]
            x[:, j] = values[at:at + SWAP_ROWS]
            poly = np.empty((len(r), len(held)))
            for i, k in enumerate(held):
                v = x[:, terms[k][0]]
                for c in terms[k][1:]:
                    v = v * x[:, c]
                poly[:, i] = v
            new = (yj_np((poly - med) / iqr, lam) - mean) / sd
            phi = np.sqrt(2.0 / D) * np.cos(g * (base[r] + (new - z[r][:, held]) @ move) + model.phase)
            out[at:at + SWAP_ROWS] = model.target.inverse(phi @ th[:D] + th[D], s)
        return out

    return run


# ==========================================================================
# scoring rows (M2, M4, M5, M8)
# ==========================================================================

def score_rows(rows: DataFrame, svr: SVRModel | None, gp: GPModel | None, key: str = "run_id",
               svr_spec: int = 0, gp_spec: int = 0, state: int | None = None,
               n_splits: int = SETTINGS.n_splits) -> DataFrame:
    """``(key, fold, y, pred_svr, pred_gpr, std_gpr)`` for every row: each row
    is scored by the model of its own held-out split (``state=None``, out of
    fold) or by one given state (e.g. the all-rows refit). Both models are
    applied in the same ``mapInPandas`` pass, so predictions never need a join
    to be aligned. Parameters travel inside the task closure (small)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf) == 0:
                continue
            uniq, inv = _unique_inputs(pdf)
            fold = pdf["fold"].to_numpy()
            eng = engineered_np(uniq)
            ps = np.full(len(pdf), np.nan)
            pg = np.full(len(pdf), np.nan)
            sg = np.full(len(pdf), np.nan)
            polys = {}
            for s in (range(n_splits) if state is None else [state]):
                sel = (fold == s) if state is None else np.ones(len(pdf), bool)
                if not sel.any():
                    continue
                used = np.unique(inv[sel])
                if svr is not None:
                    vals = np.full(len(uniq), np.nan)
                    d = svr.specs[svr_spec].poly_degree
                    if d not in polys:
                        polys[d] = poly_np(eng, d)
                    vals[used] = svr_predict_np(svr, svr_spec, s, eng[used], {d: polys[d][used]})
                    ps[sel] = vals[inv[sel]]
                if gp is not None:
                    m, sd = gp_predict_np(gp, gp_spec, s, gp.prep.expand(uniq[used]))
                    vm, vs = np.full(len(uniq), np.nan), np.full(len(uniq), np.nan)
                    vm[used], vs[used] = m, sd
                    pg[sel], sg[sel] = vm[inv[sel]], vs[inv[sel]]
            yield pd.DataFrame({key: pdf[key], "fold": pdf["fold"].astype("int32"), "y": pdf["y"],
                                "pred_svr": ps, "pred_gpr": pg, "std_gpr": sg})

    from rugosa.session import ship_package

    ship_package(rows.sparkSession)
    schema = f"{key} string, fold int, y double, pred_svr double, pred_gpr double, std_gpr double"
    return rows.select(key, *INPUTS, "y", "fold").mapInPandas(run, schema)


#: Rows that are gathered before the trials are scored, so that few inputs come twice.
SCORE_ROWS = 65_536


def pooled_trial_mse(rows: DataFrame, svr: SVRModel | None = None, gp: GPModel | None = None,
                     n_specs: int = 0, n_splits: int = SETTINGS.n_splits) -> np.ndarray:
    """A10 for a whole study: pooled out-of-fold MSE of every spec in one
    pass. SVR trials of one degree share the projection of every split; of a GP only
    what its mean takes travels to the tasks."""
    means = {} if gp is None else {(t, s): gp.mean_map(t, s) for t in range(n_specs) for s in range(n_splits)}
    prep = None if gp is None else gp.prep

    def fn(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        uniq, inv = _unique_inputs(pdf)
        fold = pdf["fold"].to_numpy()
        y = pdf["y"].to_numpy(np.float64)
        sse = np.zeros(n_specs)
        for s in range(n_splits):
            sel = fold == s
            if not sel.any():
                continue
            used, local = np.unique(inv[sel], return_inverse=True)
            local = local.ravel()
            xs = uniq[used]
            own = y[sel]
            n = np.bincount(local, minlength=len(used))
            mean = np.bincount(local, weights=own, minlength=len(used)) / n
            within = np.sum((own - mean[local]) ** 2)
            if svr is not None:
                D = svr.phase.shape[0]
                by_d: dict[int, list[int]] = {}
                for t in range(n_specs):
                    by_d.setdefault(svr.specs[t].poly_degree, []).append(t)
                for d, ts in by_d.items():
                    base = svr.preps[d].transform(poly_np(engineered_np(xs), d), s) @ svr.proj[d].T
                    ts = np.array(ts)
                    g = np.sqrt(2.0 * np.array([svr.gamma(t, s) for t in ts]))
                    phi = np.sqrt(2.0 / D) * np.cos(g[:, None, None] * base[None] + svr.phase[None, None, :])
                    th = svr.theta[[svr.index(t, s) for t in ts]]
                    f = np.einsum("tud,td->tu", phi, th[:, :D]) + th[:, D:D + 1]
                    pred = svr.target.inverse(f, s)
                    # rows of an input, about their mean: a trial costs inputs, not rows
                    sse[ts] += within + np.sum(n * (mean - pred) ** 2, axis=1)
            else:
                z = prep.transform(prep.expand(xs), s)
                for t in range(n_specs):
                    features, beta, mu, sd = means[t, s]
                    pred = features.raw(z) @ beta * sd + mu
                    sse[t] += within + np.sum(n * (mean - pred) ** 2)
        return {0: np.concatenate([[len(y)], sse])}

    v = partial_sums(rows.select(*INPUTS, "y", "fold"), fn, rows=SCORE_ROWS)[0]
    return v[1:] / v[0]


#: Rows of a partition of the model passes, at most about.
ROWS_PER_TASK = 2_000_000


def with_fold_rows(folded: DataFrame, target: str, key: str = "run_id") -> DataFrame:
    """Rows for the model passes. Rows of one input lie together, so that a pass
    computes its features once: partitioned by input and sorted inside. Inputs that
    hold more rows than a fair share (no more of them than partitions, so they may be
    broadcast) are cut into parts by the row's key. The number of partitions follows
    the rows."""
    rows = folded.select(key, *INPUTS, F.col(target).alias("y"), "fold")
    counts = rows.groupBy(*INPUTS).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    n = max(folded.sparkSession.sparkContext.defaultParallelism * 2, -(-total // ROWS_PER_TASK))
    fair = max(total / n, 1.0)
    hot = F.broadcast(counts.where(F.col("_n") > fair).withColumn("_parts", F.ceil(F.col("_n") * 8 / fair)))
    dealt = rows.join(hot, list(INPUTS), "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(key), F.col("_parts")), F.lit(0)))
    return dealt.repartition(n, *INPUTS, "_part").sortWithinPartitions(*INPUTS).select(key, *INPUTS, "y", "fold")


def score_inputs(df: DataFrame, svr: SVRModel | None, gp: GPModel | None, key: str = "run_id",
                 state: int = SETTINGS.n_splits, svr_spec: int = 0, gp_spec: int = 0) -> DataFrame:
    """Stateless scoring of new inputs ``(key, Vc, Fz, ap)`` with one fitted
    state (default: the all-rows refit): ``(key, pred_svr, pred_gpr,
    std_gpr)``. A pure per-batch projection, so it also runs on a streaming
    DataFrame."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf) == 0:
                continue
            uniq, inv = _unique_inputs(pdf)
            eng = engineered_np(uniq)
            n = len(pdf)
            ps, pg, sg = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
            if svr is not None:
                ps = svr_predict_np(svr, svr_spec, state, eng)[inv]
            if gp is not None:
                m, sd = gp_predict_np(gp, gp_spec, state, gp.prep.expand(uniq))
                pg, sg = m[inv], sd[inv]
            yield pd.DataFrame({key: pdf[key].astype(str), "pred_svr": ps, "pred_gpr": pg, "std_gpr": sg})

    from rugosa.session import ship_package

    ship_package(df.sparkSession)
    schema = f"{key} string, pred_svr double, pred_gpr double, std_gpr double"
    return df.select(F.col(key).cast("string").alias(key), *INPUTS).mapInPandas(run, schema)


def gp_sensitivity(summary: DataFrame, n_features: int = SETTINGS.gp_tuning_features, seed: int = SETTINGS.seed,
                   grid: Sequence[float] = (0.25, 0.5, 1.0, 2.0, 4.0),
                   state: int = SETTINGS.n_splits) -> tuple[list[dict], GPModel]:
    """I6 (ARD variant): one length scale per base variable on the
    standardised, Yeo-Johnson-transformed base inputs, chosen by marginal
    likelihood over the full ``grid^3`` in ONE Gram pass; importance is the
    inverse length scale normalised to sum 1."""
    import itertools

    from rugosa.operators.preprocess import fit_prep

    prep = fit_prep(summary, 1, inputs="base")
    base = GPSpec(**SETTINGS.gpr_defaults)
    specs = [GPSpec(base.amplitude, np.array(c, dtype=np.float64), base.alpha, base.noise)
             for c in itertools.product(grid, repeat=len(INPUTS))]
    model = fit_gp(summary, prep, specs, n_features=n_features, seed=seed, refit=False, states=[state])
    best_t = max(range(len(specs)), key=lambda t: (model.states[(t, state)].lml, -t))
    ls = np.asarray(specs[best_t].length_scale, dtype=np.float64)
    inv = 1.0 / ls
    imp = inv / inv.sum() if inv.sum() != 0 else np.zeros_like(inv)
    rows = [{"variable": v, "length_scale": float(l), "inv_length_scale": float(i), "importance": float(m),
             "lml": float(model.states[(best_t, state)].lml)} for v, l, i, m in zip(INPUTS, ls, inv, imp)]
    return rows, model
