"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks of bounded size; each (query block,
candidate block) tile is one group.  In a tile, int8 codes are multiplied as a
matrix, which gives every inner product up to a bound that follows from the two
quantisation errors (Cauchy-Schwarz).  A candidate survives when its upper
bound reaches the k-th best lower bound of the query; survivors are computed in
double precision and kept in a heap of k.  Heaps of all tiles are merged in levels of
bounded fan-in.  Vectors travel in the precision they came in.  The result is exact.

Defined results: vectors that are null, empty, all zero, or hold a null or a
non-finite component take no part, nor do rows without id.  Rows that share an
id count once (the greatest vector).  Vectors are compared within equal length.
Ties go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score double, tile long"
#: Sums of int8 products are exact in float32 up to this many dimensions.
EXACT_DIMS = 1024


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): one row per id, usable vectors only."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return (vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(ok)
            .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(v).alias("v")))


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32 for the matrix product), scale, norm of the
    decoded vector, norm of the error."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = code * scale[:, None]
    return code.astype(np.float32), scale, np.sqrt((decoded ** 2).sum(1)), np.sqrt(((x - decoded) ** 2).sum(1))


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products summed from the first component to the last, the same for equal vectors."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += q[j] * x[:, j]
    return out


def _tile(queries: pd.DataFrame, cands: pd.DataFrame, k: int) -> Iterator[tuple[int, int, float]]:
    qid, cid = queries["qid"].to_numpy(), cands["id"].to_numpy()
    q, x = np.stack(queries["qv"].to_numpy()).astype(float), np.stack(cands["v"].to_numpy()).astype(float)
    qc, qs, qn, qe = _codes(q)
    xc, xs, _, xe = _codes(x)
    xn_full = np.sqrt((x ** 2).sum(1))
    for i in range(len(q)):
        part = sum((xc[:, a:a + EXACT_DIMS] @ qc[i, a:a + EXACT_DIMS]).astype(float)
                   for a in range(0, x.shape[1], EXACT_DIMS))
        about = part * xs * qs[i]
        # |<q,x> - <q',x'>| <= |q - q'| |x| + |q'| |x - x'|
        bound = (qe[i] * xn_full + qn[i] * xe) * (1 + 1e-9) + 1e-12 * (qn[i] + qe[i]) * xn_full
        other = cid != qid[i]
        low = np.where(other, about - bound, -np.inf)
        cut = np.partition(low, -k)[-k] if len(low) > k else -np.inf
        alive = np.flatnonzero(other & (about + bound >= cut))
        scores = _dot(q[i], x[alive])
        best = heapq.nsmallest(k, zip((-scores).tolist(), cid[alive].tolist()))
        for s, c in best:
            yield int(qid[i]), int(c), -s


#: Heaps of so many tiles (or merged heaps) meet in one group, for about so many queries.
FAN_IN, MERGED_QUERIES = 64, 128


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            query_block: int = 1024, cand_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products per query.

    ``is_query`` is a condition on ``id``.  Block sizes bound the memory of a
    task: two blocks of vectors and one row of products.  Heaps are merged level by
    level, so a group holds about ``FAN_IN * MERGED_QUERIES * k`` rows at any number of tiles.
    """
    single = dict(vectors.dtypes)[vec_col] == "array<float>"   # then 32-bit values are exact
    clean = clean_vectors(vectors, id_col, vec_col)
    n, nq = clean.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    cb, qb = max(1, -(-n // cand_block)), max(1, -(-nq // query_block))
    slot = lambda name, m: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(m)).cast("int")
    dims = F.size("v").alias("dims")
    sent = F.col("v").cast("array<float>" if single else "array<double>")
    cands = clean.select("id", sent.alias("v"), dims, slot("c", cb).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    # new column names: the two sides of a cogroup must not share attributes
    queries = clean.filter(is_query).select(
        F.col("id").alias("qid"), sent.alias("qv"), dims, slot("q", qb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = list(_tile(q, c, k)) if len(q) and len(c) else []
        of = int(c["cb"].iloc[0]) if len(c) else 0
        return _frame([(*r, of) for r in rows])

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[int, list] = {}
        for q, c, s in zip(found["query_id"].tolist(), found["vec_id"].tolist(), found["score"].tolist()):
            heap = heaps.setdefault(q, [])
            if len(heap) < k:
                heapq.heappush(heap, (s, -c))
            elif (s, -c) > heap[0]:
                heapq.heapreplace(heap, (s, -c))
        of = int(found["tile"].iloc[0]) // FAN_IN
        return _frame([(q, -c, s, of) for q, heap in heaps.items() for s, c in sorted(heap, reverse=True)])

    keys = ["qb", "cb", "dims"]
    tops = queries.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(tile, FOUND)
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-nq // MERGED_QUERIES))))
    left = cb
    while True:
        tops = tops.groupBy(group, F.floor(F.col("tile") / FAN_IN)).applyInPandas(merge, FOUND)
        left = -(-left // FAN_IN)
        if left == 1:
            break
    # at most k rows a query are left
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tops.select("query_id", place.alias("rank"), "vec_id", "score")


def _frame(rows: list[tuple[int, int, float, int]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "tile"]).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64", "tile": "int64"})
