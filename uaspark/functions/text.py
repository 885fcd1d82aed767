"""Keyword classifiers and question extraction over text columns.

All of them are CASE / ``contains`` / array higher-order expressions, so a
text is processed whole inside one row expression and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists, checked in this order (first match wins).
PLATFORM_KEYWORDS = [
    ("unity_ads", ["unity"]),
    ("mistplay", ["mistplay"]),
    ("facebook", ["facebook", "meta"]),
    ("google", ["google"]),
    ("tiktok", ["tiktok"]),
]
FILENAME_PLATFORM_KEYWORDS = [
    ("unity_ads", ["unity"]),
    ("mistplay", ["mistplay"]),
    ("facebook", ["facebook"]),
    ("google", ["google"]),
    ("tiktok", ["tiktok"]),
]
FILENAME_CHANNEL_KEYWORDS = [("android", ["android"]), ("ios", ["ios"]), ("web", ["web"])]
CHANNEL_VALUES = ["android", "ios", "web", "desktop"]

INTENT_KEYWORDS = [
    ("roi_timeline", ["100% roi", "when will roi", "break-even", "payback", "d15", "d30", "d90"]),
    ("budget_action", ["continue", "pause", "scale", "cut", "reduce", "maintain", "budget"]),
    ("projection_same_spend", ["projected roas", "keep spending", "same pace", "projection"]),
    ("level_quality_channels", ["level progression", "highest quality", "long-term", "retention", "cohort"]),
    ("forecast_vs_actual", ["compare", "actual", "ai forecast", "day"]),
]
INTENT_DEFAULT = "general_insight"

ROUTE_KEYWORDS = [
    ("roi_timeline", ["100% roi", "when will roi", "break-even", "payback", "d15", "d30", "d90", "roi of 100%"]),
    ("metrics", ["perform", "metric", "accuracy", "r2", "mape", "rmse", "mae"]),
    ("best_platform", ["best platform", "which platform", "platform perform"]),
    ("drivers", ["driver", "feature", "important"]),
    ("expectation", ["expect roas", "forecast", "prediction", "expected roas"]),
    ("actions", ["scale", "cut", "reduce", "maintain", "budget"]),
    ("coverage", ["data", "coverage", "how much", "volume"]),
]
ROUTE_DEFAULT = "unsupported"

QUESTION_STARTS = ["q", "question", "what", "how", "why", "when", "where", "which", "who", "can",
                   "should", "will", "does", "is", "are"]
PARAGRAPH_STARTS = ["what", "how", "why", "when", "where", "which", "who", "can", "should", "will",
                    "does", "is", "are"]
MIN_QUESTION_CHARS = 10

FEATURE_LABELS = [
    ("User engagement indicator", ["retention"]),
    ("Historical performance", ["roas"]),
    ("Acquisition efficiency", ["cost", "cpi"]),
    ("Monetization potential", ["revenue"]),
    ("Game progression", ["level"]),
    ("Channel performance", ["platform"]),
]


def _any_contains(s: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = s.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def first_keyword_label(s: Column, table: list[tuple[str, list[str]]], default: str | None) -> Column:
    expr = None
    for label, words in table:
        cond = _any_contains(s, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("string"))


def classify_platform(c: Column) -> Column:
    """Network from a free-text value (null when none matches)."""
    return first_keyword_label(F.lower(F.trim(c.cast("string"))), PLATFORM_KEYWORDS, None)


def classify_channel(c: Column) -> Column:
    """Device channel when the value is exactly a known channel."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin(*CHANNEL_VALUES), v)


def platform_from_filename(c: Column) -> Column:
    return first_keyword_label(F.lower(c), FILENAME_PLATFORM_KEYWORDS, None)


def channel_from_filename(c: Column) -> Column:
    return first_keyword_label(F.lower(c), FILENAME_CHANNEL_KEYWORDS, None)


def question_intent(c: Column) -> Column:
    """Six intents by keyword precedence."""
    return first_keyword_label(F.lower(c), INTENT_KEYWORDS, INTENT_DEFAULT)


def question_route(c: Column) -> Column:
    """Keyword route of the rule-based answerer."""
    return first_keyword_label(F.lower(c), ROUTE_KEYWORDS, ROUTE_DEFAULT)


def feature_label(c: Column) -> Column:
    """Business reading of a feature name ('' when none applies)."""
    return first_keyword_label(F.lower(c), FEATURE_LABELS, "")


def _starts_any(s: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = s.startswith(w)
        cond = c if cond is None else (cond | c)
    return cond


def strip_ws(c: Column) -> Column:
    """Python-style ``strip()``: all surrounding whitespace, not just blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _clean_line(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \-\t]+|[ \-\t]+$", "")


def _strip_prefix(line: Column) -> Column:
    s = F.regexp_replace(line, r"(?i)^q\s*[:\-.]\s*", "")
    s = F.regexp_replace(s, r"(?i)^question\s*[:\-.]\s*", "")
    return strip_ws(s)


def extract_questions(text: Column) -> Column:
    """Array of questions found in a whole text.

    Line rule: a stripped line that starts with a question word (or ``q``) or
    ends with ``?``; ``Q:`` / ``Question:`` prefixes are removed; kept when
    longer than 10 characters.  When no line qualifies, paragraphs that hold
    ``?`` or start with a question word give their first sentence.
    """
    lines = F.transform(F.split(text, "\n"), _clean_line)
    is_q = lambda l: (l != "") & (_starts_any(F.lower(l), QUESTION_STARTS) | l.endswith("?"))
    line_qs = F.filter(F.transform(F.filter(lines, is_q), _strip_prefix),
                       lambda l: F.length(l) > MIN_QUESTION_CHARS)
    paras = F.transform(F.split(text, "\n\n"), strip_ws)
    para_ok = lambda p: (p != "") & ((F.instr(p, "?") > 0) | _starts_any(F.lower(p), PARAGRAPH_STARTS))
    firsts = F.transform(F.filter(paras, para_ok), lambda p: strip_ws(F.split(p, r"\.").getItem(0)))
    para_qs = F.filter(firsts, lambda s: F.length(s) > MIN_QUESTION_CHARS)
    return F.when(F.size(line_qs) > 0, line_qs).otherwise(para_qs)


# ---- oracle spellings (DuckDB) -------------------------------------------

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first_keyword_label_sql(e: str, table, default: str | None) -> str:
    parts = []
    for label, words in table:
        cond = " OR ".join(f"contains({e}, {_sql_str(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {_sql_str(label)}")
    d = _sql_str(default) if default is not None else "NULL"
    return f"(CASE {' '.join(parts)} ELSE {d} END)"


def question_intent_sql(e: str) -> str:
    return first_keyword_label_sql(f"lower({e})", INTENT_KEYWORDS, INTENT_DEFAULT)


def question_route_sql(e: str) -> str:
    return first_keyword_label_sql(f"lower({e})", ROUTE_KEYWORDS, ROUTE_DEFAULT)


def feature_label_sql(e: str) -> str:
    return first_keyword_label_sql(f"lower({e})", FEATURE_LABELS, "")


def classify_platform_sql(e: str) -> str:
    return first_keyword_label_sql(f"lower(trim(CAST({e} AS VARCHAR)))", PLATFORM_KEYWORDS, None)


def classify_channel_sql(e: str) -> str:
    v = f"lower(trim(CAST({e} AS VARCHAR)))"
    vals = ", ".join(_sql_str(x) for x in CHANNEL_VALUES)
    return f"(CASE WHEN {v} IN ({vals}) THEN {v} END)"
