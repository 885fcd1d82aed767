"""Forecast operators (M4 baseline here; the quantile booster is in ``booster``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .quantiles import exact_percentiles

QUANTILES = (0.1, 0.5, 0.9)
QUANTILE_NAMES = ("p10", "p50", "p90")


def segment_quantile_forecast(actuals: DataFrame, segment_cols: Sequence[str], target_col: str,
                              train_col: str | None = None, holdout_bucket: int = 0) -> DataFrame:
    """M4: p10/p50/p90 of the target per segment, learned on the training split
    (rows whose ``train_col`` bucket differs from ``holdout_bucket``) and
    attached to every row.  The per-segment table has one row per segment; it is
    broadcast when it is small, so rows are not shuffled to a few segment keys."""
    seg = list(segment_cols)
    train = actuals.where(F.col(train_col) != holdout_bucket) if train_col else actuals
    q = broadcast_if_small(exact_percentiles(train, seg, target_col, QUANTILES, QUANTILE_NAMES))
    out = actuals.join(q, seg, "left")
    return out.select(*actuals.columns, *QUANTILE_NAMES,
                      (F.col("p90") - F.col("p10")).alias("width"))
