"""Campaign CSV sources.

A campaign folder looks like ``<root>/<network>/<channel>/<kind file>.csv``.
Files of a folder differ in their headers.  Network, channel and kind come from the
path; of the files of the wanted kinds only the head is read, for the header line.
Files are then grouped by (kind, header), each group is one CSV scan with an explicit
all-text schema, and the groups are united by name (missing columns are null).  Headers
keep their spelling and padding (P1 / P2 run later).
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Kind keywords in precedence order.
KIND_RULES = [
    ("adspend_revenue", ["adspend", "revenue", "cost"]),
    ("retention", ["retention"]),
    ("roas", ["roas"]),
    ("level_progression", ["level", "progression"]),
]
KIND_UNKNOWN = "unknown"
# Names that are never data files.
EXCLUDED_NAME_PARTS = ["template", "feature_importance", "demo_"]
TEMP_PREFIX = "~$"


def classify_data_type(name: Column) -> Column:
    """First matching kind of the lower-cased file name."""
    low = F.lower(name)
    expr = None
    for kind, words in KIND_RULES:
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, kind) if expr is None else expr.when(cond, kind)
    return expr.otherwise(KIND_UNKNOWN)


def is_data_file(name: Column, excluded: Sequence[str] = EXCLUDED_NAME_PARTS) -> Column:
    """Drop names that hold an excluded part (templates, exports of
    importances, demo files; pass your own list for others) and lock files."""
    low = F.lower(name)
    bad = low.startswith(TEMP_PREFIX)
    for p in excluded:
        bad = bad | low.contains(p.lower())
    return ~bad


def best_name_match(files: DataFrame, wanted: str, name_col: str = "source_file") -> DataFrame:
    """The files named ``wanted``; else those that differ in the extension
    only; else those that differ in case only (extension ignored)."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    name, target = F.col(name_col), F.lit(wanted)
    rank = (F.when(name == target, 0).when(stem(name) == stem(target), 1)
             .when(F.lower(stem(name)) == F.lower(stem(target)), 2))
    ranked = files.withColumn("_rank", rank).where("_rank IS NOT NULL")
    best = ranked.agg(F.min("_rank").alias("_best"))
    return ranked.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def _decoded(uri: Column) -> Column:
    """Text of a path in a URI (``url_decode`` alone would read ``+`` as a blank)."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


#: Bytes of a file that are read for its header line; doubled while no line ends in them.
HEAD_BYTES = 1 << 16


def head_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, of which no more than its head is read, by the session's
    own file systems; null for an empty file."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    size = HEAD_BYTES
    while True:
        stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).open(at)
        try:
            head = bytes(stream.readNBytes(size))
        finally:
            stream.close()
        ends = [i for i in (head.find(b"\n"), head.find(b"\r")) if i >= 0]
        if ends or len(head) < size:
            line = head[:min(ends)] if ends else head
            return line.decode("utf-8", "replace") if head else None
        size *= 2


def list_data_files(spark: SparkSession, root: str, kinds: Sequence[str] | None = None,
                    excluded: Sequence[str] = EXCLUDED_NAME_PARTS, readers: int = 16) -> DataFrame:
    """One row per data file: ``path``, ``header`` (its first line), ``platform``,
    ``subdirectory``, ``source_file`` and ``data_type``.

    The two folders above the file name the network and the channel.  Files are listed by
    name and size only; of those that pass the kind filter, the head is read, ``readers`` at a
    time, so the bytes read don't grow with the files.  Files without a line are left out."""
    parts = F.split(F.col("path"), "/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
             .select("path", F.element_at(parts, -3).alias("platform"), F.element_at(parts, -2).alias("subdirectory"),
                     F.element_at(parts, -1).alias("source_file"))
             .withColumn("data_type", classify_data_type(F.col("source_file")))
             .where(is_data_file(F.col("source_file"), excluded)))
    wanted = files.where(F.col("data_type").isin(*kinds)) if kinds else files
    found = wanted.collect()                                   # names of files, as any scan lists them on the driver
    with ThreadPoolExecutor(max(1, readers)) as pool:
        heads = list(pool.map(lambda r: head_line(spark, r["path"]), found))
    rows = [(r["path"], h, r["platform"], r["subdirectory"], r["source_file"], r["data_type"]) for r, h in zip(found, heads) if h is not None]
    return spark.createDataFrame(rows, "path string, header string, platform string, subdirectory string, source_file string, data_type string")


def header_names(header: str) -> list[str]:
    """Column names of a header line; a name that repeats an earlier one but for
    case gets ``__<position>`` (Spark could not tell the two apart)."""
    seen, out = set(), []
    for i, name in enumerate(next(csv.reader([header.lstrip("\ufeff")]), [])):
        out.append(f"{name}__{i}" if name.lower() in seen else name)
        seen.add(name.lower())
    return out


def read_campaign_folder(spark: SparkSession, root: str, kinds: Sequence[str] | None = None,
                         excluded: Sequence[str] = EXCLUDED_NAME_PARTS) -> DataFrame:
    """S1 + S3 + S4: every data file under ``root/<network>/<channel>/`` as text
    columns, with ``platform``, ``subdirectory``, ``data_type`` and ``source_file``.
    A header named like one of these tags is kept with the prefix ``file_``."""
    tags = ["platform", "subdirectory", "data_type", "source_file"]
    # one row per file: what any scan of these files lists on the driver
    families: dict[tuple[str, str], list[str]] = {}
    files = list_data_files(spark, root, kinds, excluded)
    for r in files.select("path", "data_type", "header").collect():
        families.setdefault((r["data_type"], r["header"]), []).append(r["path"])
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = _decoded(F.element_at(parts, -1))
    frames = []
    for (kind, header), paths in sorted(families.items()):
        names = [f"file_{n}" if n.strip().lower() in tags else n for n in header_names(header)]
        schema = StructType([StructField(n, StringType()) for n in names])
        scan = (spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", False)
                .option("ignoreTrailingWhiteSpace", False).csv(paths))
        frames.append(scan.select("*", _decoded(F.element_at(parts, -3)).alias("platform"),
                                  _decoded(F.element_at(parts, -2)).alias("subdirectory"),
                                  F.lit(kind).alias("data_type"), name.alias("source_file")))
    if not frames:
        return spark.createDataFrame([], StructType([StructField(t, StringType()) for t in tags]))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def read_kind(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """S1 for one kind: files of other kinds are not scanned."""
    return read_campaign_folder(spark, root, [kind])


def read_csv_file(spark: SparkSession, path: str) -> DataFrame:
    """S3: one CSV with header; an empty file is an error."""
    df = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False)
               .option("ignoreTrailingWhiteSpace", False).csv(path))
    if not df.columns or df.limit(1).count() == 0:
        raise ValueError(f"empty data file: {path}")
    return df


def read_call_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Call logs, one JSON document per file, with ``kind`` and ``logged_at``
    from names like ``<kind>_<yyyymmdd>_<hhmmss>_<micros>.json``."""
    name = F.regexp_extract("source_file", r"^(.*)_(\d{8}_\d{6})_(\d{1,6})\.json$", 1)
    stamp = F.concat_ws(".", F.regexp_extract("source_file", r"_(\d{8}_\d{6})_\d{1,6}\.json$", 1),
                        F.rpad(F.regexp_extract("source_file", r"_(\d{1,6})\.json$", 1), 6, "0"))
    logs = (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
            .select("*", _decoded(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("source_file")))
    return logs.select("*", F.when(name != "", name).alias("kind"),
                       F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss.SSSSSS")).alias("logged_at"))


def preview(df: DataFrame, order_cols: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` (the limit is the feature)."""
    return df.orderBy(*order_cols).limit(n)
