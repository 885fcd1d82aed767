"""Forecast post-processing and campaign advice rules.

Fixed values: the thresholds and labels below are the published rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# gap = target - predicted, checked from the top.
TIER_RULES = [
    (0.2, "Scale aggressively - high potential"),
    (0.1, "Scale moderately - good potential"),
    (0.0, "Scale cautiously - marginal potential"),
    (-0.1, "Maintain current spend"),
    (-0.2, "Reduce spend - underperforming"),
]
TIER_LAST = "Cut spend - poor performance"
# Interval width.
CONFIDENCE_RULES = [(0.1, "High"), (0.2, "Medium")]
CONFIDENCE_LAST = "Low"
# (min predicted ROAS, max width exclusive or None, action)
ACTION_RULES = [(1.5, 0.5, "scale"), (1.0, 0.8, "maintain"), (0.5, None, "reduce")]
ACTION_LAST = "cut"
ACTIONS = ["scale", "maintain", "reduce", "cut"]
DEFAULT_WIDTH = 0.8
ROAS_PROXY_EPS = 1e-9
CLIP_LOW, CLIP_HIGH = 0.0, 10.0


def advice_tier(gap: Column, polarity: str = "documented") -> Column:
    """X14.  ``documented``: a large positive gap (prediction far *below*
    target) reads "Scale aggressively", as published.  ``below_target_is_bad``
    flips the sign of the gap first."""
    g = gap if polarity == "documented" else -gap
    expr = None
    for thr, label in TIER_RULES:
        expr = F.when(g > thr, label) if expr is None else expr.when(g > thr, label)
    return expr.otherwise(TIER_LAST)


def confidence_level(width: Column) -> Column:
    """X15."""
    expr = None
    for thr, label in CONFIDENCE_RULES:
        expr = F.when(width < thr, label) if expr is None else expr.when(width < thr, label)
    return expr.otherwise(CONFIDENCE_LAST)


def campaign_action(pred: Column, width: Column) -> Column:
    """Four-action rule on predicted ROAS and interval width."""
    expr = None
    for lo, wmax, action in ACTION_RULES:
        cond = pred >= lo if wmax is None else ((pred >= lo) & (width < wmax))
        expr = F.when(cond, action) if expr is None else expr.when(cond, action)
    return expr.otherwise(ACTION_LAST)


def roas_proxy(cost: Column, revenue: Column) -> Column:
    """ROAS used when no forecast exists: revenue / (cost + 1e-9), nulls as 0."""
    return F.coalesce(revenue, F.lit(0.0)) / (F.coalesce(cost, F.lit(0.0)) + F.lit(ROAS_PROXY_EPS))


def clip_prediction(c: Column) -> Column:
    """Non-finite -> 0, then clamp to [0, 10]."""
    finite = F.when(F.isnan(c) | c.isNull() | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)
    return F.greatest(F.lit(CLIP_LOW), F.least(F.lit(CLIP_HIGH), finite))


def reason_text(pred: Column, target: Column, improvement: Column) -> Column:
    """X17."""
    return F.format_string("Predicted ROAS %.3f vs target %.3f (improvement: %.3f)", pred, target, improvement)


# Metric grading labels.
def grade_r2(c: Column) -> Column:
    return F.when(c > 0.8, "Excellent").when(c > 0.6, "Good").when(c > 0.4, "Fair").otherwise("Poor")


def grade_rmse(c: Column) -> Column:
    return F.when(c < 0.1, "Low").when(c < 0.3, "Moderate").otherwise("High")


def grade_mape(c: Column) -> Column:
    return F.when(c < 0.1, "Excellent").when(c < 0.2, "Good").when(c < 0.3, "Fair").otherwise("Poor")


def grade_coverage(c: Column) -> Column:
    return F.when(c > 0.8, "Good").when(c > 0.6, "Fair").otherwise("Poor")


# ---- oracle spellings ---------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def advice_tier_sql(gap: str) -> str:
    whens = " ".join(f"WHEN {gap} > {thr} THEN {_q(label)}" for thr, label in TIER_RULES)
    return f"(CASE {whens} ELSE {_q(TIER_LAST)} END)"


def confidence_level_sql(width: str) -> str:
    whens = " ".join(f"WHEN {width} < {thr} THEN {_q(label)}" for thr, label in CONFIDENCE_RULES)
    return f"(CASE {whens} ELSE {_q(CONFIDENCE_LAST)} END)"


def campaign_action_sql(pred: str, width: str) -> str:
    parts = []
    for lo, wmax, action in ACTION_RULES:
        cond = f"{pred} >= {lo}" if wmax is None else f"{pred} >= {lo} AND {width} < {wmax}"
        parts.append(f"WHEN {cond} THEN {_q(action)}")
    return f"(CASE {' '.join(parts)} ELSE {_q(ACTION_LAST)} END)"
