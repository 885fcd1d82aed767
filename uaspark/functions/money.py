"""Currency and percent parsing as pure column expressions.

Both dialects stay JVM-side (regexp / split / try_cast) so they run inside
whole-stage codegen; no Python UDF touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "zero" in each dialect.
P10_ZERO_TOKENS = ["$-", "$", "€-", "€", "£-", "£", "¥-", "¥", "-", ""]
P11_ZERO_TOKENS = ["", "$-", "-", "None", "nan"]
P11_SYMBOLS = "$£€₹"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A plain number with an exponent, as Spark prints doubles from 1e7 on and below 1e-3.
_EXPONENT = r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"


def _bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def parse_currency(c: str | Column) -> Column:
    """P10: ``$1,234.56`` -> 1234.56, ``12,50`` -> 12.5, ``1,234`` -> 1234,
    ``-`` anywhere -> negative, blanks and failures -> 0.0.  Numbers, also in
    exponent form, are taken as they are."""
    raw = _c(c)

    def amount(cleaned: Column) -> Column:
        unsigned = F.translate(cleaned, "-", "")
        comma = F.instr(unsigned, ",")
        whole = F.translate(unsigned, ",", "")
        decimal_comma = ((comma > 0) & (F.instr(unsigned, ".") == 0) & (F.length(unsigned) - F.length(whole) == 1)
                         & (F.length(unsigned) - comma <= 2))
        digits = F.when(decimal_comma, F.translate(unsigned, ",", ".")).otherwise(whole)
        sign = F.when(F.instr(cleaned, "-") > 0, -1.0).otherwise(1.0)
        return F.coalesce(digits.try_cast("double"), F.lit(0.0)) * sign

    def parse(s: Column) -> Column:
        return (F.when(s.isNull() | s.isin(*P10_ZERO_TOKENS), F.lit(0.0))
                 .when(s.rlike(_EXPONENT), F.coalesce(s.try_cast("double"), F.lit(0.0)))
                 .otherwise(_bind(F.regexp_replace(s, r"[^0-9.,\-]", ""), amount)))

    return _bind(F.trim(raw.cast("string")), parse)


def parse_currency_or_percent(c: str | Column) -> Column:
    """Drop commas; ``31%`` -> 0.31; drop currency symbols; blanks -> 0.0."""
    raw = _c(c)
    s = F.trim(raw.cast("string"))
    no_commas = F.regexp_replace(s, ",", "")
    pct = F.try_divide(no_commas.substr(F.lit(1), F.length(no_commas) - 1).try_cast("double"),
                       F.lit(100.0))
    plain = F.regexp_replace(no_commas, f"[{P11_SYMBOLS}]", "").try_cast("double")
    parsed = F.when(no_commas.endswith("%"), pct).otherwise(plain)
    value = F.coalesce(parsed, raw.cast("string").try_cast("double"), F.lit(0.0))
    return F.when(raw.isNull() | s.isin(*P11_ZERO_TOKENS), F.lit(0.0)).otherwise(value)


def to_number(c: str | Column) -> Column:
    """Numeric coercion, bad text -> null."""
    return _c(c).cast("string").try_cast("double")


# ---- oracle spellings (DuckDB) -------------------------------------------

def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parse_currency_sql(e: str) -> str:
    s = f"trim(CAST({e} AS VARCHAR))"
    cl = f"regexp_replace({s}, '[^0-9.,\\-]', '', 'g')"
    u = f"replace({cl}, '-', '')"
    norm = (f"CASE WHEN contains({u}, ',') AND contains({u}, '.') THEN replace({u}, ',', '') "
            f"WHEN contains({u}, ',') AND len(string_split({u}, ',')) = 2 "
            f"AND length(string_split({u}, ',')[2]) <= 2 THEN replace({u}, ',', '.') "
            f"WHEN contains({u}, ',') THEN replace({u}, ',', '') ELSE {u} END")
    v = f"coalesce(TRY_CAST({norm} AS DOUBLE), 0.0)"
    zeros = ", ".join(_sq(t) for t in P10_ZERO_TOKENS)
    return (f"(CASE WHEN {e} IS NULL OR {s} IN ({zeros}) THEN 0.0 "
            f"WHEN regexp_matches({s}, '{_EXPONENT}') THEN coalesce(TRY_CAST({s} AS DOUBLE), 0.0) "
            f"WHEN contains({cl}, '-') THEN -{v} ELSE {v} END)")


def parse_currency_or_percent_sql(e: str) -> str:
    s = f"trim(CAST({e} AS VARCHAR))"
    nc = f"replace({s}, ',', '')"
    pct = f"TRY_CAST(substr({nc}, 1, length({nc}) - 1) AS DOUBLE) / 100.0"
    plain = f"TRY_CAST(regexp_replace({nc}, '[{P11_SYMBOLS}]', '', 'g') AS DOUBLE)"
    zeros = ", ".join(_sq(t) for t in P11_ZERO_TOKENS)
    return (f"(CASE WHEN {e} IS NULL OR {s} IN ({zeros}) THEN 0.0 ELSE coalesce("
            f"CASE WHEN suffix({nc}, '%') THEN {pct} ELSE {plain} END, TRY_CAST(CAST({e} AS VARCHAR) AS DOUBLE), 0.0) END)")


def to_number_sql(e: str) -> str:
    return f"TRY_CAST(CAST({e} AS VARCHAR) AS DOUBLE)"
