"""Exact linear-interpolation quantiles with bounded memory.

Spark's exact ``percentile`` keeps every distinct value in one aggregation
buffer, which a single task must merge at the end -- fine for thousands of
rows, fatal for billions. Here all columns are summarised side by side in the
wide table and narrowed down exactly, see ``operators/ranks.py``. The method is
the same at every size.

The value is ``x[k] + (h - k) * (x[k+1] - x[k])`` with ``h = (n - 1) q``, the
usual linear (type 7) definition, so results equal ``percentile`` /
``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.operators.ranks import weighted_quantiles


def exact_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """``{column: [quantile at q for q in qs]}`` (driver floats; NULL and NaN are
    left out, a column without values gives None)."""
    cols = list(columns)

    def values(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf.to_numpy(np.float64), np.ones((len(pdf), 1))

    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    got = weighted_quantiles(wide, values, len(cols), 1, [float(q) for q in qs])[0]
    return {c: [None if np.isnan(v) else float(v) for v in got[i]] for i, c in enumerate(cols)}
