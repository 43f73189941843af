"""Closed-form out-of-fold base scorers.

For a row in fold k the prediction is the mean target of its group over the
*other* folds, ``(sum_all - sum_k) / (n_all - n_k)``, falling back to the
training mean when the group has no training rows. Everything is a partial
aggregate per (group, fold) joined back on the group key -- no window over a
data key, so a hot group (a third of all rows) only makes its aggregate
bucket bigger, never a task. These scorers stand in for the kernel models in
every SQL-checked query (metrics, blending, stacking, plot data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.session import stored


def _summand(target: str, decimals: int | None):
    """The value that is summed: the target itself, or -- for fixed-precision
    targets -- the target in integer units of ``10**-decimals``, which makes
    every sum exact and independent of the summation order."""
    if decimals is None:
        return F.col(target)
    return F.round(F.col(target) * F.lit(10.0 ** decimals), 0).cast("long")


def _mean(s, n, decimals: int | None):
    m = s.cast("double") / n.cast("double")
    return m if decimals is None else m / F.lit(10.0 ** decimals)


def group_sums(folded: DataFrame, group_cols: Sequence[str], target: str, fold_col: str = "fold",
               decimals: int | None = None) -> DataFrame:
    """``(group, fold, _s, _n)``: sum and count of the target per group and fold. One
    scan of the rows; the scorers of coarser groups sum these sums."""
    return folded.groupBy(*group_cols, fold_col).agg(
        F.sum(_summand(target, decimals)).alias("_s"), F.count(F.lit(1)).alias("_n"))


def training_means(sums: DataFrame, fold_col: str = "fold", decimals: int | None = None) -> DataFrame:
    """Per fold k: mean target of rows outside fold k, from :func:`group_sums`. At most
    n_splits rows."""
    per = sums.groupBy(fold_col).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    tot = sums.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).select(F.struct("s", "n")).scalar()
    return per.select(
        F.col(fold_col),
        F.when(tot["n"] - F.col("_n") > 0, _mean(tot["s"] - F.col("_s"), tot["n"] - F.col("_n"), decimals))
        .alias("_tm"),
    )


#: Groups whose statistics a broadcast may hold (a few dozen bytes each); more are
#: joined by a shuffle of the rows.
BROADCAST_GROUPS = 200_000


def _rest(sums: DataFrame, group_cols: Sequence[str], fold_col: str) -> DataFrame:
    """``(group, fold, _rs, _rn)``: sum and count over the other folds. Stored, so that
    its rows can be counted before the join: few are broadcast, and the rows stay
    where they are."""
    g = sums.groupBy(*group_cols, fold_col).agg(F.sum("_s").alias("_gs"), F.sum("_n").alias("_gn"))
    gt = g.groupBy(*group_cols).agg(F.sum("_gs").alias("_ts"), F.sum("_gn").alias("_tn"))
    rest = stored(g.join(gt, on=list(group_cols), how="inner").select(
        *group_cols, fold_col,
        (F.col("_ts") - F.col("_gs")).alias("_rs"),
        (F.col("_tn") - F.col("_gn")).alias("_rn"),
    ), "group-rest")
    return F.broadcast(rest) if rest.count() <= BROADCAST_GROUPS else rest


def oof_group_mean(folded: DataFrame, group_cols: Sequence[str], target: str, out: str,
                   fold_col: str = "fold", decimals: int | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = out-of-fold mean of ``target`` within ``group_cols``. ``sums`` are
    the :func:`group_sums` of these or finer groups, where there are some."""
    if sums is None:
        sums = group_sums(folded, group_cols, target, fold_col, decimals)
    # bounded by n_splits rows -> broadcast is safe
    tm = F.broadcast(training_means(sums, fold_col, decimals))
    return (
        folded.join(_rest(sums, group_cols, fold_col), on=[*group_cols, fold_col], how="inner")
        .join(tm, on=fold_col, how="inner")
        .withColumn(out, F.when(F.col("_rn") > 0, _mean(F.col("_rs"), F.col("_rn"), decimals))
                    .otherwise(F.col("_tm")))
        .drop("_rs", "_rn", "_tm")
    )


def oof_base_predictions(folded: DataFrame, target: str, key: str = "run_id",
                         fold_col: str = "fold", decimals: int | None = None) -> DataFrame:
    """The OOF table ``(key, fold, y, pred_svr, pred_gpr)`` from the two
    closed-form scorers: group mean by ``Vc`` and by ``(Fz, ap)``."""
    base = folded.select(key, "Vc", "Fz", "ap", target, fold_col)
    sums = stored(group_sums(base, ["Vc", "Fz", "ap"], target, fold_col, decimals), "group-sums")
    a = oof_group_mean(base, ["Vc"], target, "pred_svr", fold_col, decimals, sums)
    # rows without a group are gone from here on, as they are from the sums of the next scorer
    b = oof_group_mean(a, ["Fz", "ap"], target, "pred_gpr", fold_col, decimals, sums.where("Vc is not null"))
    return b.select(
        F.col(key), F.col(fold_col).alias("fold"), F.col(target).alias("y"),
        "pred_svr", "pred_gpr",
    )
