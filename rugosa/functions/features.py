"""Engineered features (F1-F8) and the ordered feature matrix.

All features are plain Catalyst expressions added in one ``withColumns``
projection, so they fuse into the scan's whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.settings import SETTINGS

BASE_INPUTS = ("Vc", "Fz", "ap")

# fixed values: model input order of the modular variant (15 columns)
FEATURES_15 = (
    "Vc", "Fz", "ap",
    "Vc2", "Fz2", "ap2",
    "Vc_Fz", "Vc_ap", "Fz_ap",
    "Vc_Fz_ratio", "Fz_ap_ratio", "Vc_ap_ratio",
    "log_Vc", "log_Fz", "log_ap",
)
# fixed values: model input order of the monolith variant (12 columns)
FEATURES_12 = (
    "Vc", "Fz", "ap",
    "Vc2", "Fz2", "ap2",
    "Vc_Fz", "Vc_ap", "Fz_ap",
    "Vc/Fz", "Fz/ap", "Vc/ap",
)

_PAIRS = (("Vc", "Fz"), ("Vc", "ap"), ("Fz", "ap"))


def square_features() -> dict[str, Column]:
    """``Vc2, Fz2, ap2``."""
    return {f"{c}2": F.col(c) * F.col(c) for c in BASE_INPUTS}


def interaction_features() -> dict[str, Column]:
    """``Vc_Fz, Vc_ap, Fz_ap``."""
    return {f"{a}_{b}": F.col(a) * F.col(b) for a, b in _PAIRS}


def ratio_features(guard_eps: float | None = SETTINGS.guard_eps) -> dict[str, Column]:
    """F3 (guarded ``a/(b+eps)``, names ``a_b_ratio``) or F4 (unguarded
    ``a/b``, names ``a/b``). A zero denominator gives NULL, never an error."""
    out = {}
    for a, b in (("Vc", "Fz"), ("Fz", "ap"), ("Vc", "ap")):
        if guard_eps is None:
            out[f"{a}/{b}"] = F.try_divide(F.col(a), F.col(b))
        else:
            out[f"{a}_{b}_ratio"] = F.try_divide(F.col(a), F.col(b) + F.lit(guard_eps))
    return out


def log_features(guard_eps: float | None = SETTINGS.guard_eps) -> dict[str, Column]:
    """F5 (``ln(x+eps)``) or F6 (``ln(x)``, NULL for x <= 0)."""
    out = {}
    for c in BASE_INPUTS:
        arg = F.col(c) if guard_eps is None else F.col(c) + F.lit(guard_eps)
        out[f"log_{c}"] = F.ln(arg)
    return out


def add_engineered_features(df: DataFrame, guard_eps: float | None = SETTINGS.guard_eps) -> DataFrame:
    """all twelve engineered columns in one projection; the input frame
    is not modified (DataFrames are immutable)."""
    cols: dict[str, Column] = {}
    cols.update(square_features())
    cols.update(interaction_features())
    cols.update(ratio_features(guard_eps))
    cols.update(log_features(guard_eps))
    return df.withColumns(cols)


def feature_matrix(df: DataFrame, features: Sequence[str] = FEATURES_15,
                   target: str = "Ra", key: str = "run_id") -> DataFrame:
    """``(key, x ARRAY<DOUBLE>, y)`` with ``x`` in the fixed order.
    The ordered names stay on the driver (``features``)."""
    return df.select(
        F.col(key),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.col(target).cast("double").alias("y"),
    )


def poly_terms(n_inputs: int, degree: int) -> list[tuple[int, ...]]:
    """Monomials of total degree 1..degree, degree-major then lexicographic:
    ``x0, x1, .., x0^2, x0 x1, ..``. Each term is a tuple of input indexes."""
    terms: list[tuple[int, ...]] = []
    for d in range(1, degree + 1):
        terms.extend(combinations_with_replacement(range(n_inputs), d))
    return terms


def poly_term_name(term: tuple[int, ...], names: Sequence[str]) -> str:
    parts = []
    for i in sorted(set(term)):
        k = term.count(i)
        parts.append(names[i] if k == 1 else f"{names[i]}^{k}")
    return " ".join(parts)


def poly_expand(df: DataFrame, inputs: Sequence[str], degree: int,
                keep: Sequence[str] = ()) -> DataFrame:
    """F8 for small widths: every monomial as a Catalyst product column,
    named by its exponents (``Vc^2``, ``Vc Fz``). Wide expansions (degree 3-4
    on 15 inputs, thousands of terms) are one array, see :func:`poly_array`, and in
    the model operators numpy inside tasks."""
    cols = [F.col(keep_c) for keep_c in keep]
    for term in poly_terms(len(inputs), degree):
        expr = F.col(inputs[term[0]])
        for i in term[1:]:
            expr = expr * F.col(inputs[i])
        cols.append(expr.alias(poly_term_name(term, inputs)))
    return df.select(*cols)


def poly_array(inputs: Column, n_inputs: int, degree: int) -> Column:
    """F8 at any degree: the monomials of the array ``inputs`` in the order of
    :func:`poly_terms`, as one array expression. The terms of a degree that begin with
    input i are that input times the terms of the degree before that begin with i or
    later, and these are its last ones: a table of starts drives the recurrence, so
    the plan does not grow with the thousands of terms."""
    # of C(n + d - 2, d - 1) terms one degree lower, C(n - i + d - 2, d - 1) begin with i or later
    starts = F.array(*[
        F.array(*[F.lit(comb(n_inputs + d - 2, d - 1) - comb(n_inputs - i + d - 2, d - 1)) for i in range(n_inputs)])
        for d in range(2, degree + 1)
    ])

    def grow(acc: Column, firsts: Column) -> Column:
        last = acc["last"]
        terms = F.flatten(F.transform(firsts, lambda at, i: F.transform(
            F.slice(last, at + 1, F.size(last) - at), lambda m: F.get(inputs, i) * m)))
        # bound once, used twice
        return F.get(F.transform(F.array(terms), lambda t: F.struct(F.concat(acc["all"], t).alias("all"), t.alias("last"))), F.lit(0))

    if degree == 1:
        return inputs
    return F.aggregate(starts, F.struct(inputs.alias("all"), inputs.alias("last")), grow, lambda acc: acc["all"])


#: Rows expanded at once by :func:`poly_degree_sums`: all their terms fit a core's cache.
POLY_ROWS = 1024


def poly_terms_np(x, degree: int) -> list:
    """F8 in numpy: the terms of degree 1, 2, .. ``degree`` of the columns of ``x``
    (inputs x rows), a table (terms x rows) for each degree, in the order of
    :func:`poly_terms`. The recurrence is that of :func:`poly_array`, a block of terms
    at a time."""
    import numpy as np

    n = len(x)
    out = [x]
    for d in range(2, degree + 1):
        last = out[-1]
        out.append(np.concatenate([x[i] * last[len(last) - comb(n - i + d - 2, d - 1):] for i in range(n)]))
    return out


def poly_degree_sums(inputs: Sequence[Column], degree: int) -> Column:
    """F8 expanded in tasks, a block of rows at a time: a struct of the number of terms
    and of every degree's sum, its terms added one by one in their order (``n_terms,
    sum_d1, ..``). As in the array form, a NULL input makes the sums NULL."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import SparkSession
    from pyspark.sql.functions import arrow_udf

    from rugosa.session import ship_package

    ship_package(SparkSession.active())
    names = ["n_terms", *[f"sum_d{d}" for d in range(1, degree + 1)]]

    def expand(*columns):
        x = np.array([c.to_numpy(zero_copy_only=False) for c in columns], dtype=np.float64)
        missing = np.zeros(x.shape[1], bool)
        for c in columns:
            missing |= c.is_null().to_numpy(zero_copy_only=False)
        sums, count = np.empty((degree, x.shape[1])), 0
        for at in range(0, x.shape[1], POLY_ROWS):
            tables = poly_terms_np(x[:, at:at + POLY_ROWS], degree)
            count = sum(len(t) for t in tables)
            for d, t in enumerate(tables):
                np.add.reduce(t, axis=0, out=sums[d, at:at + POLY_ROWS])
        return pa.StructArray.from_arrays(
            [pa.array(np.full(x.shape[1], count, np.int32)), *[pa.array(v, mask=missing) for v in sums]], names=names)

    schema = "n_terms int, " + ", ".join(f"{c} double" for c in names[1:])
    return arrow_udf(expand, schema)(*inputs)
