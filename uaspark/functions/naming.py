"""Dataset / model naming rules as column expressions.

Fixed values: names are at most 80 characters, the game slug at most 20,
the fallback is ``dataset_<8 hex of md5>_<date range>``, a valid name matches
``[A-Za-z0-9_-]+`` and has at least three underscores, model names read
``lgbm_roas_d<day>_<platform slug>_quantile`` and artifacts live under
``artifacts/<model name>/v<version>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME = 80
MAX_GAME = 20


def slug(c: Column) -> Column:
    """Lower-case, non-alphanumerics to ``_``, squeeze, strip ``_``."""
    s = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit("none"))), "[^a-zA-Z0-9]", "_")
    s = F.regexp_replace(s, "_+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def _countries_token(countries: Column) -> Column:
    n = F.coalesce(F.size(countries), F.lit(0))
    return (F.when(n <= 0, F.lit("unknown"))
             .when(n == 1, slug(F.element_at(countries, 1)))
             .otherwise(F.lit("multi")))


def canonical_name(game: Column, platform: Column, channel: Column, countries: Column,
                   start: Column, end: Column) -> Column:
    """``game_platform_channel_country|multi|unknown_start-end``."""
    game_s = F.substring(slug(game), 1, MAX_GAME)
    tail_parts = [slug(platform), slug(channel), _countries_token(countries)]
    dates = F.when(start.isNotNull() & end.isNotNull(),
                   F.concat(F.date_format(start, "yyyyMMdd"), F.lit("-"), F.date_format(end, "yyyyMMdd"))
                   ).otherwise(F.lit("unknown"))
    tail = F.concat(F.lit("_"), F.concat_ws("_", *tail_parts, dates))
    full = F.concat(game_s, tail)
    room = F.lit(MAX_NAME) - F.length(tail)
    hashed = F.concat(F.lit("dataset_"), F.substring(F.md5(full), 1, 8), F.lit("_"), dates)
    return (F.when(F.length(full) <= MAX_NAME, full)
             .when(room > 0, F.concat(game_s.substr(F.lit(1), room), tail))
             .otherwise(hashed))


def is_valid_name(name: Column) -> Column:
    """Non-empty, <= 80, ``[A-Za-z0-9_-]+``, at least three underscores."""
    underscores = F.length(name) - F.length(F.regexp_replace(name, "_", ""))
    return (F.coalesce(name.isNotNull() & (F.length(name) > 0) & (F.length(name) <= MAX_NAME)
                       & name.rlike("^[a-zA-Z0-9_-]+$") & (underscores >= 3), F.lit(False)))


def model_name(target_day: Column, platform: Column) -> Column:
    """``lgbm_roas_d{day}_{platform}_quantile``."""
    return F.concat(F.lit("lgbm_roas_d"), target_day.cast("string"), F.lit("_"), slug(platform),
                    F.lit("_quantile"))


def artifact_path(name: Column, version: Column) -> Column:
    return F.concat(F.lit("artifacts/"), name, F.lit("/v"), version.cast("string"))


# ---- oracle spellings (DuckDB) ------------------------------------------

def slug_sql(e: str) -> str:
    s = f"regexp_replace(lower(coalesce(CAST({e} AS VARCHAR), 'none')), '[^a-zA-Z0-9]', '_', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    return f"regexp_replace({s}, '^_+|_+$', '', 'g')"


def canonical_name_sql(game: str, platform: str, channel: str, countries: str, start: str, end: str) -> str:
    game_s = f"substr({slug_sql(game)}, 1, {MAX_GAME})"
    n = f"coalesce(len({countries}), 0)"
    ctry = f"(CASE WHEN {n} <= 0 THEN 'unknown' WHEN {n} = 1 THEN {slug_sql(countries + '[1]')} ELSE 'multi' END)"
    dates = (f"(CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL THEN "
             f"strftime({start}, '%Y%m%d') || '-' || strftime({end}, '%Y%m%d') ELSE 'unknown' END)")
    tail = f"('_' || concat_ws('_', {slug_sql(platform)}, {slug_sql(channel)}, {ctry}, {dates}))"
    full = f"({game_s} || {tail})"
    room = f"({MAX_NAME} - length({tail}))"
    return (f"(CASE WHEN length({full}) <= {MAX_NAME} THEN {full} "
            f"WHEN {room} > 0 THEN substr({game_s}, 1, {room}) || {tail} "
            f"ELSE 'dataset_' || substr(md5({full}), 1, 8) || '_' || {dates} END)")


def is_valid_name_sql(e: str) -> str:
    us = f"(length({e}) - length(replace({e}, '_', '')))"
    return (f"coalesce({e} IS NOT NULL AND length({e}) > 0 AND length({e}) <= {MAX_NAME} "
            f"AND regexp_full_match({e}, '[a-zA-Z0-9_-]+') AND {us} >= 3, false)")


def model_name_sql(day: str, platform: str) -> str:
    return f"('lgbm_roas_d' || CAST({day} AS VARCHAR) || '_' || {slug_sql(platform)} || '_quantile')"
