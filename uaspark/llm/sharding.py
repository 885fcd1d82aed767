"""Sharding by histogram sort (DataFrame functions only).

Rows are ordered by (62 bits of the text hash, id).  Splitters cut that order
into shards of near equal bytes.  Each round counts the exact bytes in a grid
of candidate key ranges over all partitions, places every splitter at the range
edge nearest its target, and refines only the ranges whose edges both miss the
target by more than the tolerance: first by more bits of the hash, then, inside
one hash value (copies of a text, however many), by ranges of the id.  When all
splitters hold, rows are exchanged once.

A shard is cut into blocks by further splitters of the same search, so that no
task sorts a whole shard; the slot of a row is the row count of the blocks
before it in its shard plus its rank in its block.

Copies of a text are neighbours in the order, so they share a shard unless a
splitter has to pass between them to meet the tolerance.

Defined results: a null text has size 1 and the key of an empty text; a null id
sorts as -1; rows equal in text hash and id stay together, in no stated order; an
empty table gives an empty result; extra columns pass through, and one that bears the
name of a result is renamed (``columns.apart``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import Neutral

KEY_BITS = 62
FIRST_BITS = 14
STEP_BITS = 6
ID_GRID = 64


@dataclass
class _Target:
    want: int                     # bytes that should lie below the splitter
    slack: float                  # allowed miss in bytes
    low: int = 0                  # open key range [low, high)
    high: int = 1 << KEY_BITS
    below: int = 0                # exact bytes below the range
    key: int | None = None        # inside one key: its value and the open id range
    id_low: int = 0
    id_high: int = 0
    found: tuple[int, int | None] | None = None


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``size`` (bytes + 1), ``_key`` and ``_sub`` (the order)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({
        "size": F.octet_length(text).cast("long") + 1,
        "_key": F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS),
        "_sub": F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")),
    })


def _place(t: _Target, cells: list[tuple[int, int, int, int]]) -> None:
    """Move ``t`` into the cell that holds its target, or settle it on an edge of
    that cell if one is near enough or the cell can't be cut (one row or one id).

    ``cells``: (low, high, bytes, rows) in order, covering the open range.
    """
    below = t.below
    for i, (low, high, size, rows) in enumerate(cells):
        if below + size >= t.want or i == len(cells) - 1:
            break
        below += size
    miss_low, miss_high = abs(t.want - below), abs(below + size - t.want)
    inside = t.key is not None
    if min(miss_low, miss_high) <= t.slack or rows <= 1 or inside and high - low <= 1:
        edge = low if miss_low <= miss_high else high
        t.found = (t.key, edge) if inside else (edge, None)
    t.below = below
    if inside:
        t.id_low, t.id_high = low, high
    else:
        t.low, t.high = low, high


def _refine_keys(rows: DataFrame, targets: list[_Target], bits: int, step: int) -> None:
    """One round over the hash: histogram the open ranges on ``bits + step`` bits."""
    spark = rows.sparkSession
    shift, fine = KEY_BITS - bits, KEY_BITS - bits - step
    if bits:
        opened = sorted({t.low >> shift for t in targets})
        table = spark.createDataFrame([(v,) for v in opened], "_open long")
        rows = rows.join(F.broadcast(table), F.shiftright("_key", shift) == F.col("_open"), "left_semi")
    hist = {r[0]: (r[1], r[2]) for r in rows.groupBy(F.shiftright("_key", fine).alias("c"))
            .agg(F.sum("size"), F.count(F.lit(1))).collect()}
    for t in targets:
        first = t.low >> fine
        count = 1 << (step if bits else FIRST_BITS)
        _place(t, [(c << fine, c + 1 << fine, *hist.get(c, (0, 0))) for c in range(first, first + count)])


def _refine_ids(rows: DataFrame, targets: list[_Target]) -> None:
    """One round inside single hash values: histogram ranges of the id."""
    spark = rows.sparkSession
    opened = sorted({(t.key, t.id_low, t.id_high) for t in targets})
    table = spark.createDataFrame(
        [(k, a, b, max(1, -(-(b - a) // ID_GRID))) for k, a, b in opened],
        "_k long, _a long, _b long, _w long")
    hit = rows.join(F.broadcast(table), (F.col("_key") == F.col("_k"))
                    & (F.col("_sub") >= F.col("_a")) & (F.col("_sub") < F.col("_b")))
    cell = F.floor((F.col("_sub").cast("decimal(20,0)") - F.col("_a")) / F.col("_w")).cast("long")
    hist: dict[tuple, dict[int, tuple[int, int]]] = {}
    for k, a, b, c, size, count in (hit.groupBy("_k", "_a", "_b", cell.alias("c"))
                                    .agg(F.sum("size"), F.count(F.lit(1))).collect()):
        hist.setdefault((k, a, b), {})[c] = size, count
    for t in targets:
        own = hist.get((t.key, t.id_low, t.id_high), {})
        width = max(1, -(-(t.id_high - t.id_low) // ID_GRID))
        _place(t, [(low, min(low + width, t.id_high), *own.get(i, (0, 0)))
                   for i, low in enumerate(range(t.id_low, t.id_high, width))])


def splitters(rows: DataFrame, parts: int, coarse: int, tolerance: float) -> list[tuple[int, int | None]]:
    """``parts * coarse - 1`` splitters (key, id or None = before every id).

    Every ``coarse``-th one bounds a part and is held to ``tolerance`` of a
    part's bytes; the others bound blocks and may miss by a quarter of a block.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = parts * coarse
    targets = [_Target(total * i // n, total / parts * tolerance if i % coarse == 0 else total / n / 4)
               for i in range(1, n)]
    if not total:
        return [(0, None)] * (n - 1)
    bits, step = 0, FIRST_BITS
    while bits < KEY_BITS and (left := [t for t in targets if t.found is None]):
        _refine_keys(rows, left, bits, step)
        bits, step = bits + step, STEP_BITS
    left = [t for t in targets if t.found is None]
    if left:
        spark = rows.sparkSession
        table = spark.createDataFrame([(k,) for k in sorted({t.low for t in left})], "_open long")
        span = {r[0]: (r[1], r[2]) for r in
                rows.join(F.broadcast(table), F.col("_key") == F.col("_open"), "left_semi")
                .groupBy("_key").agg(F.min("_sub"), F.max("_sub")).collect()}
        for t in left:
            t.key = t.low
            low, high = span[t.key]
            t.id_low, t.id_high = low, high + 1
        while left := [t for t in left if t.found is None]:
            _refine_ids(rows, left)
    return sorted((t.found for t in targets), key=lambda s: (s[0], -(1 << 63) if s[1] is None else s[1]))


def _block(cuts: list[tuple[int, int | None]], rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows joined with the cell table, and the number of splitters at or below a row."""
    shift = KEY_BITS - FIRST_BITS
    inner: dict[int, list] = {}
    for k, d in cuts:
        inner.setdefault(k >> shift, []).append((k, -(1 << 63) if d is None else d))
    table, before = [], 0
    for c in range(1 << FIRST_BITS):
        table.append((c, before, inner.get(c, [])))
        before += len(inner.get(c, []))
    cells = rows.sparkSession.createDataFrame(
        table, "_cell long, _before int, _inner array<struct<k:long,d:long>>")
    rows = rows.withColumn("_cell", F.shiftright("_key", shift)).join(F.broadcast(cells), "_cell")
    passed = F.filter("_inner", lambda s: (F.col("_key") > s.k) | ((F.col("_key") == s.k) & (F.col("_sub") >= s.d)))
    return rows, F.col("_before") + F.size(passed)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   tolerance: float = 0.001, rows_per_block: int = 50_000,
                   max_blocks: int = 256) -> DataFrame:
    """``docs`` with ``size`` long, ``shard`` int and ``slot`` long (gapless from 0 per shard).

    Splitters are searched on (key, id, size) only; the columns of ``docs``
    move once, in the final exchange.  The driver places ``max_blocks`` blocks a shard
    at most; of larger inputs each block is cut further into equal ranges of its key
    (of its ids, if it lies in one text), so that a task sorts about ``rows_per_block``
    rows at any size.
    """
    own = Neutral(docs)
    order = cut_lineage(keyed(own.df.select(own[id_col], own[text_col]), own[id_col], own[text_col])
                        .select("_key", "_sub", "size"))
    count = order.count()
    coarse = min(max_blocks, max(1, -(-count // (shards * rows_per_block))))
    pieces = max(1, -(-count // (shards * coarse * rows_per_block)))
    cuts = splitters(order, shards, coarse, tolerance)
    bounds = _bounds(order, cuts, shards, coarse)

    def placed(rows: DataFrame) -> DataFrame:
        rows, block = _block(cuts, rows)
        rows = rows.withColumn("_block", block.cast("int"))
        if pieces == 1:
            return rows.withColumn("_piece", F.lit(0))
        inside = F.col("_low") == F.col("_high")
        at = F.when(inside, (F.col("_sub") - F.col("_id_low")) / F.greatest(F.lit(1.0), F.col("_id_high") - F.col("_id_low"))).otherwise(
            (F.col("_key") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1.0))
        piece = F.least(F.lit(pieces - 1), F.greatest(F.lit(0), F.floor(at * pieces))).cast("int")
        return rows.join(F.broadcast(bounds), "_block").withColumn("_piece", F.coalesce(piece, F.lit(0)))

    shard = F.floor(F.col("_block") / coarse).cast("int")
    sizes = placed(order).groupBy("_block", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block", "_piece")) - F.col("_n")
    offsets = sizes.withColumn("shard", shard).withColumn("_start", before).select("_block", "_piece", "shard", "_start")
    if pieces == 1:
        offsets = F.broadcast(offsets)                        # a row per block, shards * max_blocks at most
    rank = F.row_number().over(Window.partitionBy("_block", "_piece").orderBy("_key", "_sub"))
    out = (placed(keyed(own.df, own[id_col], own[text_col])).withColumn("_rank", rank)
           .join(offsets, ["_block", "_piece"]).withColumn("slot", F.col("_start") + F.col("_rank") - 1))
    return own.shown(out, "size", "shard", "slot")


def _bounds(order: DataFrame, cuts: list[tuple[int, int | None]], shards: int, coarse: int) -> DataFrame:
    """(_block, _low, _high, _id_low, _id_high): the key range of each block, and the ids
    that bound it if it lies in one key."""
    first, last = order.agg(F.min("_sub"), F.max("_sub")).first()
    ends = [(0, None), *cuts, (1 << KEY_BITS, None)]
    rows = []
    for block in range(shards * coarse):
        (low, id_low), (high, id_high) = ends[block], ends[block + 1]
        rows.append((block, low, high, float((first or 0) if id_low is None else id_low),
                     float((last or 0) + 1 if id_high is None else id_high)))
    return order.sparkSession.createDataFrame(rows, "_block int, _low long, _high long, _id_low double, _id_high double")


def write_shards(docs: DataFrame, path: str, shards: int = 16, **kw) -> None:
    """Write the shards as Parquet folders ``shard=<n>`` under ``path``."""
    shard_by_bytes(docs, shards, **kw).write.mode("overwrite").partitionBy("shard").parquet(path)
