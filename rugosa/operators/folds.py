"""Quantile bins, seeded ranks, stratified folds and fold splits
(A11, W1-W3, P4, P8, U1).

Randomness is md5 only (``md5('<seed>:<key>')``), so the same folds come out
of Spark and of a SQL oracle, on any partitioning.

Exact ranks at scale use two stages instead of one window over a whole
stratum (a stratum can hold a fifth or more of all rows):

1. bucket = first ``hex`` digits of the md5 sort key (uniform);
   count rows per (stratum, bucket) -- a partial aggregate, and turn the
   counts into offsets with a window over that small table;
2. ``row_number`` inside (stratum, bucket), plus the bucket's offset.

The offset table has at most ``n_strata * 16**hex`` rows, which is the proven
bound that justifies broadcasting it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rugosa.session import materialize
from rugosa.settings import SETTINGS


def seeded_key(key: str | Column, seed: int | str = SETTINGS.seed) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def quantile_edges(df: DataFrame, column: str, n_bins: int = SETTINGS.n_bins,
                   exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Equal-frequency edges with duplicates dropped, one row
    ``edges ARRAY<DOUBLE>`` (ascending). Exact linear percentiles by default,
    computed with bounded memory (``operators/quantiles.py``); the edges are
    parameters (n_bins + 1 numbers) bound as literals."""
    if not exact:
        qs = [i / n_bins for i in range(n_bins + 1)]
        return df.agg(F.array_distinct(F.percentile_approx(column, qs, accuracy)).alias("edges"))
    return df.sparkSession.range(1).select(
        F.array(*[F.lit(v) for v in _exact_edges(df, column, n_bins)]).cast("array<double>").alias("edges"))


def _exact_edges(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """The edges as driver floats. The passes of the quantiles read the one column, held
    for their duration."""
    from rugosa.operators.quantiles import exact_quantiles

    held = materialize(df.select(column))
    vals = exact_quantiles(held, [column], [i / n_bins for i in range(n_bins + 1)])[column]
    held.unpersist(blocking=False)
    uniq = []
    for v in vals:
        if v is not None and (not uniq or v != uniq[-1]):
            uniq.append(float(v))
    return uniq


def bin_code(value: Column, edges: Column) -> Column:
    """Right-closed bins with the lowest value included; the code is the
    number of interior edges strictly below the value. (Not ``ntile``,
    which splits ties.)"""
    interior = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(interior, lambda e: value > e)).cast("int")


def stratified_bins(df: DataFrame, column: str, n_bins: int = SETTINGS.n_bins,
                    exact: bool = True, out: str = "bin") -> DataFrame:
    """Add the bin code of ``column``: the number of interior edges below the value
    (:func:`bin_code`). Exact edges are literals, compared one by one; approximate ones
    are bound to every row through a scalar subquery."""
    if exact:
        below = [F.when(F.col(column) > F.lit(e), 1).otherwise(0) for e in _exact_edges(df, column, n_bins)[1:-1]]
        return df.withColumn(out, sum(below, F.lit(0)).cast("int"))
    edges = quantile_edges(df, column, n_bins, exact=exact).select("edges").scalar()
    bound = df.withColumn("_edges", edges)
    return bound.withColumn(out, bin_code(F.col(column), F.col("_edges"))).drop("_edges")


def _bucketed_rank(df: DataFrame, sort_key: Column, strata: Sequence[str],
                   hex_digits: int, out: str) -> DataFrame:
    """Exact 1-based ``row_number() over (partition by strata order by
    sort_key)`` computed in two stages (see module doc)."""
    d = df.withColumn("_sk", sort_key).withColumn("_bk", F.substring("_sk", 1, hex_digits))
    counts = d.groupBy(*strata, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    if strata:
        w_off = Window.partitionBy(*strata).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "_bk", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*strata, "_bk").orderBy("_sk")
    ranked = d.withColumn("_rn", F.row_number().over(w_in))
    return (
        ranked.join(F.broadcast(offsets), on=[*strata, "_bk"], how="inner")
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_sk", "_bk", "_rn", "_off")
    )


def stratified_kfold(df: DataFrame, key: str, strata: str, n_splits: int = SETTINGS.n_splits,
                     seed: int = SETTINGS.seed, hex_digits: int = SETTINGS.rank_bucket_hex,
                     out: str = "fold") -> DataFrame:
    """Balanced folds inside every stratum: rank rows of a stratum by
    ``md5(seed:key)`` and deal them round-robin, ``fold = (rank-1) % k``. Fold
    sizes inside a stratum differ by at most one."""
    ranked = _bucketed_rank(df, seeded_key(key, seed), [strata], hex_digits, "_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % n_splits).cast("int")).drop("_rank")


def dense_index(df: DataFrame, key: str, seed: int | str | None = None,
                hex_digits: int = SETTINGS.rank_bucket_hex, out: str = "idx") -> DataFrame:
    """A dense 0..n-1 index ordered by ``md5(key)`` (or ``md5(seed:key)``)
    without a single-partition window."""
    sort_key = F.md5(F.col(key).cast("string")) if seed is None else seeded_key(key, seed)
    ranked = _bucketed_rank(df, sort_key, [], hex_digits, "_rank")
    return ranked.withColumn(out, F.col("_rank") - 1).drop("_rank")


def seeded_shuffle(df: DataFrame, key: str, seed: int = SETTINGS.seed,
                   hex_digits: int = SETTINGS.rank_bucket_hex, out: str = "shuffle_pos") -> DataFrame:
    """A seeded full shuffle expressed as a position column (0-based).
    Sorting by it gives the shuffled order; nothing is collected."""
    return dense_index(df, key, seed=seed, hex_digits=hex_digits, out=out)


def assign_folds(df: DataFrame, key: str, target: str, n_bins: int = SETTINGS.n_bins,
                 n_splits: int = SETTINGS.n_splits, seed: int = SETTINGS.seed) -> DataFrame:
    """A11 + W1 + W2: bins of the target, then stratified folds."""
    binned = stratified_bins(df, target, n_bins)
    return stratified_kfold(binned, key, "bin", n_splits=n_splits, seed=seed)


def train_test_counts(folded: DataFrame, n_splits: int = SETTINGS.n_splits,
                      fold_col: str = "fold") -> DataFrame:
    """Rows in the training part (``fold <> k``) and the test part
    (``fold = k``) of every split, from one grouped count."""
    per = folded.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n_test"))
    total = folded.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return per.select(
        F.col(fold_col).cast("int").alias("fold"),
        (total - F.col("n_test")).cast("long").alias("n_train"),
        F.col("n_test").cast("long").alias("n_test"),
    )


def split(folded: DataFrame, k: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` of split ``k`` as two filters of one table."""
    return folded.filter(F.col(fold_col) != k), folded.filter(F.col(fold_col) == k)


def union_folds(per_fold: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-fold result tables by column name."""
    out = per_fold[0]
    for part in per_fold[1:]:
        out = out.unionByName(part)
    return out
