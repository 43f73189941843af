"""Stateless scoring of a streaming DataFrame.

The reference has no streaming; every fitted artifact here is a small
parameter set, so applying it to an unbounded stream is a per-batch
projection: no watermark or state store is needed. The fitted parameters
travel in the task closure; the same code path scores batch DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rugosa.operators.kernels import GPModel, SVRModel, score_inputs
from rugosa.settings import SETTINGS


def score_stream(stream: DataFrame, svr: SVRModel | None, gp: GPModel | None, key: str = "run_id",
                 state: int = SETTINGS.n_splits) -> DataFrame:
    """``readStream`` of ``(key, Vc, Fz, ap)`` -> ``(key, pred_svr, pred_gpr,
    std_gpr)`` using the all-rows refit (or another fitted state)."""
    return score_inputs(stream, svr, gp, key=key, state=state)
