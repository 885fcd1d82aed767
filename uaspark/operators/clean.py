"""Schema mapping and cleaning operators.

Name work (P1-P5, P16-P18, P22) looks only at ``df.columns`` / ``df.schema``
on the driver and ends in ONE ``select``, so Catalyst sees a single
projection.  Value work is column expressions; the only data-dependent
decisions (P13 "sums to zero", P15 "all null") come from one aggregate row
that is cross-joined back (a one-row side, so its broadcast is bounded) or
read as a single row of counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.money import parse_currency, parse_currency_or_percent, to_number
from ..functions.text import classify_channel, classify_platform, channel_from_filename, \
    platform_from_filename

HIERARCHY = ["game", "platform", "channel", "country"]
# Defaults for missing hierarchy columns.
HIERARCHY_DEFAULTS = {"game": "Unknown Game", "channel": "Unknown Channel",
                      "country": "Unknown Country", "platform": "Unknown Platform"}
REQUIRED = ["date", "installs", "cost", "revenue"]
# Header synonyms (P3), per target, generic list included.
SYNONYMS = {
    "date": ["date", "report_date", "day", "reporting_date"],
    "installs": ["installs", "install_count", "installs_count", "install", "total_installs", "downloads"],
    "cost": ["cost", "spend", "adspend", "ad_spend", "media_spend", "total_spend"],
    "revenue": ["revenue", "ad_revenue", "total_revenue", "net_revenue", "gross_revenue", "adrev"],
}
GAME_ALIASES = ["game", "title", "app", "app_name"]
COUNTRY_ALIASES = ["country", "countries", "geo", "region"]
MAX_COUNTRIES = 5
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _col(name: str) -> Column:
    return F.col(_q(name))


# ---- P1 / P2 ------------------------------------------------------------

def _by_position(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named by position, which no two headers share, and
    those names: headers that differ only in case can't be told apart by name."""
    names = [f"_p{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip + lower header names; the first of duplicates wins."""
    at, names = _by_position(df)
    first = {c.strip().lower(): n for c, n in reversed(list(zip(df.columns, names)))}
    return at.select(*[F.col(n).alias(c) for c, n in sorted(first.items(), key=lambda x: names.index(x[1]))])


def _numbered(names: Sequence[str]) -> list[str]:
    """The k-th of equal names gets ``_k``, from the second on."""
    return [n if k == 0 else f"{n}_{k + 1}" for n, k in
            ((n, names[:i].count(n)) for i, n in enumerate(names))]


def sanitized_names(columns: Sequence[str]) -> list[str]:
    """Letters and digits stay, what lies between becomes one ``_``, lower case;
    blanks are ``unnamed_<position>``; equal names are numbered until none is left."""
    names = [re.sub("[^0-9a-z]+", "_", c.lower()).strip("_") or f"unnamed_{i}" for i, c in enumerate(columns)]
    while len(set(names)) < len(names):
        names = _numbered(names)
    return names


def sanitize_headers(df: DataFrame) -> DataFrame:
    """Non ``[0-9a-zA-Z_]`` -> ``_``, squeeze, strip, lower; blanks ->
    ``unnamed_i``; collisions get ``_2``, ``_3``."""
    return df.toDF(*sanitized_names(df.columns))


# ---- P3 / P4 / P5 ---------------------------------------------------------

SYNONYM_OF = {word: target for target, words in SYNONYMS.items() for word in words if word != target}
# Metric headers (P4), pattern and name.
HEADER_RULES = [(r"roas[_\s]*d\s*(\d+)", r"roas_d\1"),
                (r"retention(?:_rate)?[_\s]*d\s*(\d+)", r"retention_d\1"),
                (r"ad_?spend", "cost")]


def canonical_header(name: str, present: Iterable[str]) -> str:
    """P3, then P4: a synonym takes its target's name unless the target is there;
    a metric header takes the name of the first rule that it fits."""
    target = SYNONYM_OF.get(name)
    if target and target not in present:
        return target
    text = name.strip().lower()
    return next((re.sub(rule, new, text) for rule, new in HEADER_RULES if re.fullmatch(rule, text)), name)


def synonym_targets(columns: Sequence[str]) -> dict[str, str]:
    """P3 + P4 rename plan: the headers that get another name."""
    renamed = {c: canonical_header(c, set(columns)) for c in columns}
    return {c: t for c, t in renamed.items() if c != t}


def map_synonyms(df: DataFrame, add_missing: bool = True) -> DataFrame:
    """Rename synonyms and metric headers; several headers of one target
    are coalesced in header order; missing required columns are added as 0."""
    plan = synonym_targets(df.columns)
    groups: dict[str, list[Column]] = {}
    for c in df.columns:
        groups.setdefault(plan.get(c, c), []).append(_col(c))
    cols = [(srcs[0] if len(srcs) == 1 else F.coalesce(*srcs)).alias(t) for t, srcs in groups.items()]
    if add_missing:
        cols += [F.lit(0).alias(r) for r in REQUIRED if r not in groups]
    return df.select(*cols)


def normalize_ingest(df: DataFrame, date_formats: list[str] | None = None, fill_zero: bool = True) -> DataFrame:
    """G2 ingest normalisation in one projection: P2, P3-P5, P8 (date), P9
    (installs, roas), P10 (cost, revenue), P11 (retention, so ``31%`` is 0.31);
    then P12 fills the nulls of these numbers with 0 unless ``fill_zero`` is off.
    Dates stay null when unparsable (never 1970-01-01)."""
    df = map_synonyms(sanitize_headers(df))
    out, numbers = [], []
    for c in df.columns:
        if c == "date":
            out.append(parse_date(_col(c), date_formats).alias(c))
            continue
        parse = (parse_currency if c in ("cost", "revenue") else parse_currency_or_percent if c.startswith("retention_d")
                 else to_number if c == "installs" or c.startswith("roas_d") else None)
        if parse is None:
            out.append(_col(c))
        else:
            out.append(F.when(_col(c).isNotNull(), parse(_col(c))).alias(c))
            numbers.append(c)
    out = df.select(*out)
    return fill_numeric_nulls(out, numbers, 0) if fill_zero else out


# ---- P6 / P7 ------------------------------------------------------------

def ensure_hierarchy(df: DataFrame) -> DataFrame:
    """Add missing hierarchy columns; channel falls back to subdirectory."""
    extra = []
    cols = set(df.columns)
    for h in HIERARCHY:
        if h in cols:
            continue
        if h == "channel" and "subdirectory" in cols:
            extra.append(F.col("subdirectory").alias("channel"))
        else:
            extra.append(F.lit(HIERARCHY_DEFAULTS[h]).alias(h))
    return df.select("*", *extra) if extra else df


def standardize_kind(df: DataFrame, data_type: str, revenue_mode: str = "ad") -> DataFrame:
    """Adspend files get ``spend := cost`` and, in ``ad`` mode (parity),
    ``revenue := ad_revenue``; ``total`` keeps ad + in-app; ``as_is`` leaves
    revenue alone.  Other kinds pass through with the hierarchy ensured."""
    df = ensure_hierarchy(df)
    if data_type != "adspend_revenue":
        return df
    cols = set(df.columns)
    sel = []
    for c in df.columns:
        if c == "revenue" and "ad_revenue" in cols and revenue_mode == "ad":
            sel.append(F.col("ad_revenue").alias("revenue"))
        else:
            sel.append(_col(c))
    if "revenue" not in cols and "ad_revenue" in cols:
        sel.append(F.col("ad_revenue").alias("revenue"))
    if "cost" in cols:
        sel.append(F.col("cost").alias("spend"))
    return df.select(*sel)


# ---- P12-P17 --------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def fill_numeric_nulls(df: DataFrame, subset: Iterable[str] | None = None, value: float = 0) -> DataFrame:
    """Explicit fill of numeric nulls (never implicit)."""
    subset = list(subset) if subset is not None else numeric_columns(df)
    return df.na.fill(value, subset=subset) if subset else df


def hydrate_financials(df: DataFrame) -> DataFrame:
    """When ``cost`` / ``revenue`` is missing or sums to 0, take the first
    header variant (``' cost '``, ``'Revenue '``, ``'Cost'``...) as text, keep a
    ``_raw`` copy, and emit ``_num`` parsed by the second dialect (P11).  The sum
    check is one aggregate row cross-joined back."""
    at, names = _by_position(df)
    found = {t: [n for c, n in zip(df.columns, names) if c.strip().lower() == t] for t in ("cost", "revenue")}
    exact = {t: next((n for c, n in zip(df.columns, names) if c == t), None) for t in found}
    sums = [F.sum(F.coalesce(to_number(F.col(n)), F.lit(0.0))).alias(f"_sum_{t}") for t, n in exact.items() if n]
    base = at.crossJoin(F.broadcast(at.agg(*sums))) if sums else at
    sel = [F.col(n).alias(c) for c, n in zip(df.columns, names) if n not in exact.values()]
    for t, n in exact.items():
        variant = next((F.col(v).cast("string") for v in found[t] if v != n), None)
        if n is None and variant is None:
            continue
        if n is None:
            chosen = raw = variant
        elif variant is None:
            chosen, raw = F.col(n).cast("string"), None
        else:
            empty = F.col(f"_sum_{t}") == 0
            chosen, raw = F.when(empty, variant).otherwise(F.col(n).cast("string")), F.when(empty, variant)
        if raw is not None:
            sel.append(raw.alias(f"{t}_raw"))
        sel += [parse_currency_or_percent(chosen).alias(f"{t}_num"), parse_currency_or_percent(chosen).alias(t)]
    return base.select(*sel)


def clean_features(df: DataFrame) -> DataFrame:
    """Numeric only; NaN and +-inf -> null -> 0; string columns dropped."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = _col(f.name)
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            out.append(F.coalesce(F.when(~bad, c), F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, NUMERIC_TYPES):
            out.append(F.coalesce(_col(f.name), F.lit(0)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.coalesce(_col(f.name).cast("int"), F.lit(0)).alias(f.name))
    return df.select(*out)


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row: non-null count per column (the only input P15 needs)."""
    return df.agg(*[F.count(_col(c)).alias(c) for c in df.columns])


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop all-null rows, then all-null columns, then duplicate columns.
    Column emptiness is read from ONE aggregate row (a count per column)."""
    rows = df.na.drop(how="all")
    counts = non_null_counts(rows).first()
    keep, seen = [], set()
    for c in rows.columns:
        if counts is not None and counts[c] and c not in seen:
            keep.append(c)
            seen.add(c)
    return rows.select(*[_col(c) for c in keep])


def numeric_only(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """P16."""
    ex = set(exclude)
    return df.select(*[_col(c) for c in numeric_columns(df) if c not in ex])


def top_features(df: DataFrame, ranked_names: Sequence[str], n: int,
                 base: Sequence[str] = ("platform", "subdirectory", "data_type")) -> DataFrame:
    """Keep the first ``n`` names of an importance ranking plus base columns."""
    cols = set(df.columns)
    keep = [b for b in base if b in cols] + [c for c in list(ranked_names)[:n] if c in cols]
    return df.select(*[_col(c) for c in dict.fromkeys(keep)])


def first_existing_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """Driver-side resolve over ``df.columns``."""
    cols = set(df.columns)
    return next((c for c in candidates if c in cols), None)


def first_element(c: Column) -> Column:
    """List-valued cell -> its first element (scalars pass through)."""
    return F.get(c, 0)


def compact_payload(df: DataFrame, order_cols: Sequence[str], limit: int = 200) -> DataFrame:
    """P20: first ``limit`` rows in ``order_cols`` as JSON objects of strings;
    nulls kept (a display operator: the limit is the feature)."""
    src = df.orderBy(*order_cols)
    as_str = F.struct(*[_col(c).cast("string").alias(c) for c in df.columns])
    return src.limit(limit).select(F.to_json(as_str, {"ignoreNullFields": "false"}).alias("payload"))


def align_features(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Training feature order; missing features are 0."""
    cols = set(df.columns)
    feats = [(_col(f) if f in cols else F.lit(0.0)).alias(f) for f in feature_names]
    return df.select(*[_col(k) for k in keep if k in cols], *feats)


# ---- P21 ------------------------------------------------------------------

def detect_hierarchy(df: DataFrame, group_cols: Sequence[str], order_col: str,
                     filename_col: str | None = None) -> DataFrame:
    """P21 per group (one group = one file): platform and channel from file-name
    keywords, then from the first non-null column value (by ``order_col``);
    a swapped pair (device in ``platform``, network in ``channel``) is
    corrected; game = first non-null value of the first alias that has one;
    countries = the first five distinct by ``order_col``, in that order.

    Values are partial aggregations (``min_by``).  Countries are reduced to one
    row per (group, country) first, so a group's list holds distinct values.
    """
    cols = set(df.columns)
    o = F.col(order_col)

    def first_nonnull(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o))

    def aliased(names: Sequence[str]) -> Column | None:
        have = [n for n in names if n in cols]
        return F.coalesce(*[first_nonnull(n).cast("string") for n in have]) if have else None

    aggs = []
    if "platform" in cols:
        aggs.append(first_nonnull("platform").cast("string").alias("_pv"))
    if "channel" in cols:
        aggs.append(first_nonnull("channel").cast("string").alias("_cv"))
    game_c = aliased(GAME_ALIASES)
    if game_c is not None:
        aggs.append(game_c.alias("_game"))
    if filename_col:
        aggs.append(F.min_by(F.col(filename_col), o).alias("_fn"))
    g = df.groupBy(*group_cols).agg(*aggs)
    ctry_c = [c for c in COUNTRY_ALIASES if c in cols]
    if ctry_c:
        # the first alias that has a value in the group names its countries
        long = df.select(*group_cols, o.alias("_o"), F.posexplode(F.array(*[F.col(c).cast("string") for c in ctry_c])))
        seen = long.where("col IS NOT NULL").groupBy(*group_cols, "pos", "col").agg(F.min("_o").alias("_o"))
        place = F.row_number().over(Window.partitionBy(*group_cols, "pos").orderBy("_o", "col"))
        five = seen.withColumn("_n", place).where(F.col("_n") <= MAX_COUNTRIES)
        lists = (five.groupBy(*group_cols, "pos").agg(F.array_sort(F.collect_list(F.struct("_n", "col"))).alias("_l"))
                 .groupBy(*group_cols).agg(F.min_by("_l", "pos").alias("_l")))
        lists = lists.select(*[F.col(c).alias(f"_k_{c}") for c in group_cols], F.col("_l.col").alias("_ctry"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in group_cols])
        g = g.join(lists, same, "left").drop(*[f"_k_{c}" for c in group_cols])
    pv = F.col("_pv") if "platform" in cols else F.lit(None).cast("string")
    cv = F.col("_cv") if "channel" in cols else F.lit(None).cast("string")
    fn = F.col("_fn") if filename_col else F.lit("")
    plat_from_p, chan_from_p = classify_platform(pv), classify_channel(pv)
    plat_from_c, chan_from_c = classify_platform(cv), classify_channel(cv)
    swapped = chan_from_p.isNotNull() & plat_from_c.isNotNull()
    base_platform = F.coalesce(platform_from_filename(fn), F.lit("unknown"))
    base_channel = channel_from_filename(fn)
    platform = F.when(swapped, plat_from_c).otherwise(F.coalesce(plat_from_p, base_platform))
    channel = F.when(swapped, chan_from_p).otherwise(F.coalesce(chan_from_c, base_channel))
    game = F.coalesce(F.col("_game"), F.lit("Unknown Game")) if game_c is not None else F.lit("Unknown Game")
    countries = F.col("_ctry") if ctry_c else F.lit(None).cast("array<string>")
    return g.select(*group_cols, platform.alias("platform"), channel.alias("channel"),
                    game.alias("game"), countries.alias("countries"))
