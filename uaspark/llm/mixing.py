"""Mixing sources to target weights (temperature mixing).

Weights are the token shares of the sources raised to an exponent and
normalised.  The exponent is the least one in [0, 1] that keeps the entropy of
the weights at or below the target and the passes over any source at or below
the repetition limit, found by bisection (both fall as the exponent rises).
A round is one small aggregate over the table of sources, which tries ``GRID``
exponents at once; the sources are never collected.  The token budget is given, or
the least one that shows every document once.

A source gets ``weight * budget`` tokens: whole passes (epochs) over all its
documents, then part of one more.  Each epoch is a permutation of the source by
a seeded hash, cut into cells whose exact token sums are counted; the partial
epoch ends at the last document that its budget holds, searched in one cell
only.  The token sums also deal the cells of all sources into blocks, so that
every block carries each source in proportion to its weight; inside a block
rows are permuted again.  A source has ``CELLS`` cells for each block that it
reaches (single rows, if it has fewer), so a block differs from its share by a cell at
each end, at any size.  No window spans a source: cells are summed in runs of
``RUN``, the runs of a source among themselves.  Tables of sources and of cells are
broadcast while they are small and joined by shuffle beyond; rows are spread over
salts then, so that a hot source is no hot key.

A document counts its words plus one (so empty documents count one).

Defined results: a null source is a source of its own.  Rows that share an id are
taken or left together and stay next to each other in the order of a block, in no
stated order among themselves.  An empty table gives an empty result.  Columns of
``docs`` pass through, one that bears the name of a result renamed
(``columns.apart``); the new ones are ``epoch``, ``block`` and ``slot``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import Neutral
from .store import stored

#: Cells of a source and epoch for each block that the epoch reaches.
CELLS = 32
#: Cells that are summed together before the runs are.
RUN = 1024
#: Rows of a table of sources or cells that is broadcast (some 60 bytes each).
FEW = 200_000
#: Copies of a larger table of sources, over which the rows of a source are spread.
SALTS = 64
#: Exponents tried in one round of the bisection.
GRID = 32
KEY_BITS = 31


@dataclass
class MixPlan:
    exponent: float
    weights: dict[str, float]
    epochs: dict[str, float]      # passes over each source, not whole
    budget: float


def weights_at(shares: dict[str, float], exponent: float) -> dict[str, float]:
    raw = {s: p ** exponent for s, p in shares.items()}
    total = math.fsum(raw.values())
    return {s: r / total for s, r in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def plan(tokens: dict[str, int], target_entropy: float = 0.92, max_epochs: float = 2.0,
         budget: float | None = None) -> MixPlan:
    """``target_entropy`` as a share of the entropy of equal weights."""
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}

    def realised(exponent: float) -> tuple[dict[str, float], float]:
        w = weights_at(shares, exponent)
        return w, budget if budget is not None else max(tokens[s] / w[s] for s in w)

    def fits(exponent: float) -> bool:
        w, size = realised(exponent)
        return (entropy(w) <= target_entropy * math.log(max(2, len(w)))
                and max(w[s] * size / tokens[s] for s in w) <= max_epochs * (1 + 1e-12))

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    for _ in range(60):
        mid = (low + high) / 2
        if high == low:
            break
        low, high = (low, mid) if fits(mid) else (mid, high)
    w, size = realised(high)
    return MixPlan(high, w, {s: w[s] * size / tokens[s] for s in w}, size)


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def exponent_for(sources: DataFrame, target_entropy: float, max_epochs: float, budget: float | None) -> tuple[float, float, float]:
    """(exponent, budget, sum of the raised shares) for ``sources`` (tokens); the same
    rule as ``plan``, by aggregates.  Sums are taken in decimals, so they don't depend
    on the partitioning."""
    total, many = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    share = F.col("tokens") / F.lit(float(total))
    exact = lambda c: F.sum(c.cast("decimal(38,24)")).cast("double")

    def tried(exponents: list[float]) -> list[tuple[float, float, float, float]]:
        """(raised sum, entropy, size, passes) of each exponent."""
        tries = F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a")
        raised = F.pow(share, F.col("a"))
        rows = sources.select("tokens", tries).withColumn("r", raised).groupBy("a").agg(
            exact(F.col("r")), exact(F.col("r") * F.log("r")), F.max(F.col("tokens") / F.col("r")), F.max(F.col("r") / F.col("tokens"))).collect()
        out = []
        for _, z, e, most, least in sorted(tuple(r) for r in rows):
            size = budget if budget is not None else most * z
            out.append((z, math.log(z) - e / z, size, least / z * size))
        return out

    def fits(found: tuple) -> bool:
        return found[1] <= target_entropy * math.log(max(2, many)) and found[3] <= max_epochs * (1 + 1e-12)

    (z, *first), = tried([0.0])
    if fits((z, *first)):
        return 0.0, first[1], z
    low, high, best = 0.0, 1.0, None
    while high - low > 1e-13:
        grid = [low + (high - low) * (i + 1) / GRID for i in range(GRID - 1)] + [high]
        found = tried(grid)
        at = next((i for i, x in enumerate(found) if fits(x)), len(grid) - 1)
        low, high, best = grid[at - 1] if at else low, grid[at], found[at]
    return high, best[2], best[0]


def _joined(rows: DataFrame, table: DataFrame, few: bool, on: list[str]) -> DataFrame:
    """``rows`` joined with a table keyed by ``on``; a large one is copied over salts."""
    if few:
        return rows.join(F.broadcast(table), on)
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    return (rows.withColumn("_salt", salt).join(
        table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]).drop("_salt"))


def _shuffled(rows: DataFrame, sources: DataFrame, few: bool, seed: int) -> DataFrame:
    """One row per document and epoch, with its place in the permutation of that epoch."""
    rows = (_joined(rows, sources, few, ["_src"])
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_last")))))
    key = F.shiftrightunsigned(F.xxhash64("_id", "epoch", F.lit(seed)), 64 - KEY_BITS)
    return rows.withColumn("_key", key).withColumn("_cell", F.shiftright(F.col("_key") * F.col("_cells"), KEY_BITS))


def _summed(cells: DataFrame) -> DataFrame:
    """``cells`` with the tokens ``before`` a cell in its source and ``upto`` its end in
    its epoch: by runs of cells first, so that no window holds a whole source."""
    cells = stored(cells.withColumn("_run", F.floor(F.col("_cell") / RUN)))
    runs = cells.groupBy("_src", "epoch", "_run").agg(F.sum("t").alias("rt"))
    inside = Window.partitionBy("_src", "epoch").orderBy("_run")
    source = Window.partitionBy("_src").orderBy("epoch", "_run")
    runs = runs.select("_src", "epoch", "_run", (F.sum("rt").over(source) - F.col("rt")).alias("run_before"),
                       (F.sum("rt").over(inside) - F.col("rt")).alias("run_inside"))
    here = F.sum("t").over(Window.partitionBy("_src", "epoch", "_run").orderBy("_cell"))
    return (cells.withColumn("here", here).join(runs, ["_src", "epoch", "_run"])
            .withColumn("before", F.col("run_before") + F.col("here") - F.col("t"))
            .withColumn("upto", F.col("run_inside") + F.col("here")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        target_entropy: float = 0.92, max_epochs: float = 2.0, budget: float | None = None,
        rows_per_block: int = 20_000, seed: int = 17, tokens: Column | None = None, few: int = FEW) -> DataFrame:
    """``docs`` repeated or thinned to the mixture, with ``epoch``, ``block`` and
    ``slot``.  ``tokens`` counts a document's tokens (by default, words plus one);
    tables of up to ``few`` rows are broadcast."""
    counted = token_count(F.col(text_col)) if tokens is None else tokens.cast("long")
    narrow = stored(docs.select(_source_key(F.col(source_col)).alias("_src"), F.col(id_col).alias("_id"), counted.alias("_tokens")))
    own = Neutral(docs)
    keyed = own.df.withColumns({"_src": _source_key(F.col(own[source_col])), "_id": F.col(own[id_col])})
    sources = stored(narrow.groupBy("_src").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    many = sources.count()
    if not many:
        return own.shown(own.df.withColumns({"epoch": F.lit(0), "block": F.lit(0), "slot": F.lit(0).cast("long")}),
                         "epoch", "block", "slot")
    few_sources = many <= few
    exponent, size, raised = exponent_for(sources, target_entropy, max_epochs, budget)
    total = sources.agg(F.sum("tokens")).first()[0]
    passes = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(raised) * F.lit(float(size)) / F.col("tokens")
    sources = sources.withColumn("_passes", passes)
    out_rows = sources.agg(F.sum(F.col("rows") * F.col("_passes"))).first()[0]
    blocks = max(16, math.ceil(out_rows / rows_per_block))
    whole = F.floor(F.col("_passes") + 1e-9)
    part = F.greatest(F.lit(0.0), F.col("_passes") - whole) * F.col("tokens")
    sources = stored(sources.select(
        "_src", F.when(part >= 1, whole).otherwise(F.greatest(F.lit(0), whole - 1)).cast("int").alias("_last"),
        whole.alias("_whole"), part.alias("_part"), (F.col("_passes") * F.col("tokens")).alias("_budget"),
        F.greatest(F.lit(1), F.least("rows", F.ceil(CELLS * blocks / F.col("_passes")))).alias("_cells")))

    sums = _summed(_shuffled(narrow, sources, few_sources, seed)
                   .groupBy("_src", "epoch", "_cell", "_whole", "_part", "_budget").agg(F.sum("_tokens").alias("t")))
    partial = F.col("epoch") >= F.col("_whole")
    cells = stored(sums.filter(~partial | (F.col("upto") - F.col("t") < F.col("_part"))).select(
        "_src", "epoch", "_cell",
        F.least(F.lit(blocks - 1), F.floor(F.col("before") / F.col("_budget") * blocks)).cast("int").alias("block"),
        F.when(partial & (F.col("upto") > F.col("_part")), F.col("_part") - F.col("upto") + F.col("t")).alias("_room")))
    small = F.broadcast if cells.limit(few + 1).count() <= few else (lambda df: df)
    # the one cell per source in which a partial epoch ends: its last document that fits
    edge = cells.filter("_room IS NOT NULL").select("_src", "epoch", "_cell", "_room")
    run = Window.partitionBy("_src").orderBy("_key", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (_shuffled(narrow, sources, few_sources, seed).join(small(edge), ["_src", "epoch", "_cell"])
            .withColumn("_sum", F.sum("_tokens").over(run)).filter("_sum <= _room")
            .groupBy("_src").agg(F.max(F.struct("_key", "_id")).alias("_end")))
    # the end of a source's partial epoch goes with the cell that holds it
    cells = stored(cells.join(edge.select("_src", F.col("epoch"), F.col("_cell"), F.lit(True).alias("_edge"))
                              .join(ends, "_src", "left"), ["_src", "epoch", "_cell"], "left"))
    out = _shuffled(keyed, sources, few_sources, seed).join(small(cells), ["_src", "epoch", "_cell"])
    fits = F.col("_room").isNull() | F.coalesce(F.struct("_key", "_id") <= F.col("_end"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("_id", "epoch", F.lit(seed + 1)), "_id", "epoch"))
    return own.shown(out.filter(fits).withColumn("slot", place.cast("long") - 1), "epoch", "block", "slot")
