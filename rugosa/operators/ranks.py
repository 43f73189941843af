"""Exact weighted quantiles of many columns and many weightings at once.

A *rank summary* of a set of values is a short table (value, weight for every
weighting). Summaries of two parts merge into one of the whole: equal values
are united, and a table that outgrows its share is thinned to values at even
steps of the total weight, each of which takes over the weight of the values
left out before it. A summary that was never thinned is exact.

One pass builds a summary per column. Columns with few distinct values are
done. For the others the summary's values cut the column; a second pass counts
exactly, for every weighting, what lies below and at each cut; the order
statistics asked for then lie at a cut or strictly between two of them, and
only these intervals are summarised again. Each round narrows an interval by the
size of a summary, so a handful of rounds settles any number of distinct values,
with tables of bounded size in tasks, shuffles and driver. No value is
gathered per column, and nothing is sampled: the answer is exact.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rugosa.operators.linalg import PARTIAL_SCHEMA, gathered, partial_sums

#: Entries of all summaries of a pass together, and of one at least and at most.
ENTRIES = 1 << 16
LEAST, MOST = 32, 4096
#: Cells (rows x columns) handled at a time, and rows gathered for that.
SLICE, ROWS = 1 << 21, 1 << 17

Values = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]


class Interval:
    """Values of a column in (low, high], with the weight at or below ``low``; a low
    of NaN is below every value."""

    def __init__(self, column: int, low: float, high: float, below: np.ndarray):
        self.column, self.low, self.high, self.below = column, low, high, below


def _pack(table: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, table)
    return out.getvalue()


def merge_summaries(tables: Sequence[np.ndarray], cap: int) -> np.ndarray:
    """Rows (interval, value, thinned, weights...) of all tables, united by value and
    thinned to ``cap`` rows per interval. The largest value always stays."""
    rows = np.vstack(tables)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    at = np.flatnonzero(new)
    out = rows[at]
    out[:, 3:] = np.add.reduceat(rows[:, 3:], at, axis=0)
    out[:, 2] = np.maximum.reduceat(rows[:, 2], at)
    bounds = np.flatnonzero(np.r_[True, out[1:, 0] != out[:-1, 0], True])
    if np.diff(bounds).max() <= cap:
        return out
    kept = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        kept.append(_thinned(out[a:b], cap))
    return np.vstack(kept)


def _thinned(part: np.ndarray, cap: int) -> np.ndarray:
    """The rows of one interval, ascending and different, thinned to ``cap``."""
    if len(part) <= cap:
        return part
    upto = np.cumsum(part[:, 3:].sum(axis=1))
    step = np.searchsorted(upto, upto[-1] * np.arange(1, cap + 1) / cap)
    pick = np.unique(np.minimum(step, len(part) - 1))
    start = np.r_[0, pick[:-1] + 1]
    thin = part[pick]
    thin[:, 3:] = np.add.reduceat(part[: pick[-1] + 1, 3:], start, axis=0)
    if pick[-1] < len(part) - 1:   # weightless values at the end
        thin = np.vstack([thin, part[-1:]])
    thin[:, 2] = 1.0
    return thin


def _merger(cap: int):
    @pandas_udf(T.BinaryType())
    def merged(parts: pd.Series) -> bytes:
        return _pack(merge_summaries([np.load(io.BytesIO(p)) for p in parts], cap))

    return merged


def _members(x: np.ndarray, intervals: list[Interval]) -> tuple[np.ndarray, np.ndarray]:
    """Of a column's values: rows that lie in one of its (disjoint, ascending)
    intervals, and which."""
    high = np.array([i.high for i in intervals])
    low = np.array([i.low for i in intervals])
    at = np.searchsorted(high, x)
    inside = at < len(high)
    inside[inside] = ~(x[inside] <= low[at[inside]])
    rows = np.flatnonzero(inside)   # NaN sorts last and is in none
    return rows, at[rows]


def _slices(values: Values, pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch in slices of bounded size, however many columns it has."""
    at, rows = 0, 256
    while at < len(pdf):
        x, w = values(pdf.iloc[at : at + rows])
        yield x, w
        at += rows
        rows = max(256, SLICE // max(x.shape[1], 1))


def _by_column(intervals: list[Interval]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for n, i in enumerate(intervals):
        out.setdefault(i.column, []).append(n)
    return out


def summaries(df: DataFrame, values: Values, intervals: list[Interval], fanin: int = 64) -> tuple[np.ndarray, int]:
    """The merged summaries of all intervals (rows as in :func:`merge_summaries`)."""
    from rugosa.session import ship_package

    cap = max(LEAST, min(MOST, ENTRIES // len(intervals)))
    own = _by_column(intervals)

    def tables(x: np.ndarray, w: np.ndarray) -> Iterator[np.ndarray]:
        for c, names in own.items():
            rows, at = _members(x[:, c], [intervals[n] for n in names])
            if not len(rows):
                continue
            v = x[rows, c]
            # intervals ascend: sorted by value, rows are sorted by interval, too
            order = np.argsort(v)
            v, at, weight = v[order], at[order], w[rows[order]]
            new = np.ones(len(v), bool)
            np.not_equal(v[1:], v[:-1], out=new[1:])
            first = np.flatnonzero(new)
            table = np.empty((len(first), 3 + w.shape[1]))
            table[:, 0], table[:, 1], table[:, 2] = np.array(names)[at[first]], v[first] + 0.0, 0.0
            table[:, 3:] = np.add.reduceat(weight, first, axis=0)
            yield table if len(table) <= cap else _thinned(table, cap) if len(names) == 1 else merge_summaries([table], cap)

    def per_partition(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in gathered(it, ROWS):
            for x, w in _slices(values, pdf):
                for table in tables(x, w):
                    held.append(table)
                    size += len(table)
                if size > 4 * ENTRIES:
                    held = [merge_summaries(held, cap)]
                    size = 0
        if held:
            yield pd.DataFrame({"key": [0], "vec": [_pack(merge_summaries(held, cap))]})

    ship_package(df.sparkSession)
    merged = _merger(cap)
    parts = df.mapInPandas(per_partition, PARTIAL_SCHEMA)
    level = parts.groupBy((F.abs(F.hash(F.spark_partition_id())) % fanin).alias("_t")).agg(merged("vec").alias("vec"))
    rows = level.agg(merged("vec").alias("vec")).collect()
    body = rows[0]["vec"] if rows else None
    return (np.load(io.BytesIO(body)) if body is not None else np.zeros((0, 3))), cap


def _counts(df: DataFrame, values: Values, intervals: list[Interval], cuts: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Per interval an array (2 len(cuts), width): the weight strictly between a cut
    and the one before, and the weight at the cut, in turn."""
    own = _by_column(intervals)
    start = np.cumsum([0] + [2 * len(c) for c in cuts])
    together = {c: np.concatenate([cuts[n] for n in names]) for c, names in own.items()}

    def fn(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        out = np.zeros((start[-1], width))
        for x, w in _slices(values, pdf):
            for c, names in own.items():
                rows, _at = _members(x[:, c], [intervals[n] for n in names])
                # a column's intervals ascend and follow each other, as do their cuts
                v, t = x[rows, c], together[c]
                pos = np.searchsorted(t, v)
                cell = 2 * pos + (t[pos] == v) if len(v) else pos
                mine = slice(start[names[0]], start[names[-1] + 1])
                for s in range(width):
                    out[mine, s] += np.bincount(cell, weights=w[rows, s], minlength=2 * len(t))
        return {0: out.ravel()}

    total = partial_sums(df, fn, rows=ROWS)[0].reshape(-1, width)
    return [total[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]


def weighted_quantiles(df: DataFrame, values: Values, columns: int, width: int, qs: Sequence[float]) -> np.ndarray:
    """Linear-interpolation quantiles ``(width, columns, len(qs))``: ``values`` turns a
    batch into the columns (NaN is left out) and the weights (whole numbers, rows x
    width). NaN where a column has no weight."""
    intervals = [Interval(c, np.nan, np.inf, np.zeros(width)) for c in range(columns)]
    found: dict[tuple[int, int, int], float] = {}      # (weighting, column, rank)
    wanted: dict[int, list[tuple[int, int]]] | None = None   # interval -> (weighting, rank)
    total = np.zeros((width, columns))

    def ranks(s, c):
        n = int(total[s, c])
        for q in qs:
            k = math.floor((n - 1) * q)
            yield from (k, min(k + 1, n - 1))

    while intervals:
        table, _cap = summaries(df, values, intervals)
        at = np.searchsorted(table[:, 0], np.arange(len(intervals) + 1)) if len(table) else np.zeros(len(intervals) + 1, int)
        parts = [table[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if wanted is None:
            for c, part in enumerate(parts):
                total[:, c] = part[:, 3:].sum(axis=0) if len(part) else 0.0
            wanted = {c: sorted({(s, r) for s in range(width) if total[s, c] > 0 for r in ranks(s, c)}) for c in range(columns)}
        thinned = [n for n, part in enumerate(parts) if wanted[n] and part[:, 2].any()]
        again = set(thinned)
        for n, part in enumerate(parts):
            if n in again or not wanted[n]:
                continue
            upto = intervals[n].below + np.cumsum(part[:, 3:], axis=0)
            for s, r in wanted[n]:
                found[s, intervals[n].column, r] = float(part[np.searchsorted(upto[:, s], r, "right"), 1])
        if not thinned:
            break
        open_ = [intervals[n] for n in thinned]
        cuts = [parts[n][:, 1].copy() for n in thinned]
        counted = _counts(df, values, open_, cuts, width)
        narrower: dict[tuple[int, float, float], tuple[Interval, list]] = {}
        for n, i, t, cells in zip(thinned, open_, cuts, counted, strict=True):
            upto = i.below + np.cumsum(cells, axis=0)
            for s, r in wanted[n]:
                cell = int(np.searchsorted(upto[:, s], r, "right"))
                k = cell // 2
                if cell % 2:
                    found[s, i.column, r] = float(t[k])
                    continue
                low = t[k - 1] if k else i.low
                below = upto[2 * k - 1] if k else i.below
                # the cut itself is no value of the interval any more
                high = float(np.nextafter(t[k], -np.inf))
                narrower.setdefault((i.column, low, high), (Interval(i.column, float(low), high, below), []))[1].append((s, r))
        held = [narrower[k] for k in sorted(narrower, key=lambda k: (k[0], k[2]))]
        intervals, wanted = [i for i, _ in held], {n: sorted(w) for n, (_, w) in enumerate(held)}
    out = np.full((width, columns, len(qs)), np.nan)
    for s in range(width):
        for c in range(columns):
            n = int(total[s, c])
            for j, q in enumerate(qs if n else ()):
                h = (n - 1) * q
                k = math.floor(h)
                a, b = found[s, c, k], found[s, c, min(k + 1, n - 1)]
                out[s, c, j] = a if h == k or a == b else a + (h - k) * (b - a)
    return out
