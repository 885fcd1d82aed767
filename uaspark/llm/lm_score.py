"""Language-model scores by stupid backoff, computed with count tables.

Documents are dealt into chunks by a hash of id and text.  Each chunk explodes its
n-grams of every order and counts them, so an n-gram is one entry per chunk,
however often it occurs.  The count table is partitioned by the hash of the
n-gram into shards: there the counts of all chunks are summed and joined to the
entries, and what other chunks add to an n-gram returns to the chunk, which
scores its documents and sums per document.  The entries that one chunk and one
shard exchange travel as one row: sorted hashes and counts, stored byte plane by
byte plane, which the shuffle compresses to half the size of single rows.

The score of a word is c(context, word) / c(context) at the longest order seen,
times ``alpha`` for each order backed off from; below unigrams it is
alpha^order / N.  With ``exclude_own`` the counts leave out the document that is
scored, so a text isn't predicted from itself; copies of it still count.

Words are runs of bytes other than white space, A-Z lower-cased, told apart by
64-bit hashes.  Orders are not joined across documents.

Defined results: null texts and texts without words have no tokens, log score 0
and null mean.  Rows that share an id are separate documents.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import chain, give_back, word_hashes

#: Words scored at a time, about; a longer document by itself.
WORDS_AT_ONCE = 1 << 18


def _ngrams(hashes: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``order`` words that end at each position, its document); 0
    where the document has fewer words before."""
    out = np.zeros(len(hashes), np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(hashes) >= order:
        runs = chain(hashes, order)
        runs[runs == 0] = 1
        whole = np.arange(len(hashes)) - offsets[doc] >= order - 1
        at = np.flatnonzero(whole)
        out[at] = runs[at - order + 1]
    return out, doc


def _pack(values: np.ndarray) -> bytes:
    """64-bit values as byte planes, so that like bytes are neighbours."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def _shard_bits(shards: int) -> int:
    return max(0, shards - 1).bit_length()


def _counted(hashes: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all orders, ascending, and their counts."""
    g = np.concatenate([_ngrams(hashes, offsets, k)[0] for k in range(1, order + 1)])
    g.sort()
    g = g[np.searchsorted(g, 1):]                 # 0 is no n-gram
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, int)
    return g[first], np.diff(np.append(first, len(g)))


def _count(table: pa.Table, order: int, shards: int) -> pa.Table:
    """(chunk, shard, g, n): the packed n-grams and counts of one chunk by shard
    (the top bits of the hash)."""
    give_back()                                   # what the group before has left
    g, n = _counted(*word_hashes(table.column("text")), order)
    bits = _shard_bits(shards)
    edges = np.searchsorted(g, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    chunk = table.column("chunk")[0].as_py()
    rows = [(chunk, i, _pack(a), _pack(b.astype(np.uint64)))
            for i, (a, b) in enumerate(zip(np.split(g, edges), np.split(n, edges))) if len(a)]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()),
                     "g": pa.array([r[2] for r in rows], pa.binary()), "n": pa.array([r[3] for r in rows], pa.binary())})


def _others(table: pa.Table) -> pa.Table:
    """(of, g, n): for each chunk of one shard, what the other chunks add."""
    give_back()
    gs, ns = ([_unpack(x) for x in table.column(c).to_pylist()] for c in ("g", "n"))
    kinds, inverse = np.unique(np.concatenate(gs), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(ns).astype(np.float64)).astype(np.uint64)[inverse]
    rows, at = [], 0
    for chunk, g, n in zip(table.column("chunk").to_pylist(), gs, ns):
        rest = total[at:at + len(g)] - n
        at += len(g)
        shared = rest > 0
        if shared.any():
            rows.append((chunk, _pack(g[shared]), _pack(rest[shared])))
    return pa.table({"of": pa.array([r[0] for r in rows], pa.int32()), "g": pa.array([r[1] for r in rows], pa.binary()),
                     "n": pa.array([r[2] for r in rows], pa.binary())})


def _own_counts(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, how often its document has its n-gram."""
    order = np.lexsort((doc, g))
    gs, ds = g[order], doc[order]
    new = np.append(True, (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1]))
    group = np.cumsum(new) - 1
    out = np.empty(len(g), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def _score(table: pa.Table, others: pa.Table, order: int, alpha: float, total: int, exclude_own: bool) -> pa.Table:
    give_back()
    hashes, offsets = word_hashes(table.column("text"))
    grams, total_of = _counted(hashes, offsets, order)
    # what the other chunks add, one shard at a time: each n-gram of theirs is one of this chunk
    for g, n in zip(others.column("g").to_pylist(), others.column("n").to_pylist()):
        total_of[np.searchsorted(grams, _unpack(g))] += _unpack(n).astype(np.int64)
    size = np.diff(offsets)
    sums, first = np.zeros(len(size)), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + WORDS_AT_ONCE, side="right")) - 1)
        sums[first:last] = _sums(hashes[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first],
                                 grams, total_of, order, alpha, total, exclude_own)
        first = last
    mean = [s / n if n else None for s, n in zip(sums.tolist(), size.tolist())]
    return pa.table({"doc_id": table.column("doc_id"), "n_tokens": pa.array(size, pa.int64()),
                     "log_score": pa.array(sums, pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})


def _sums(hashes: np.ndarray, offsets: np.ndarray, grams: np.ndarray, total_of: np.ndarray, order: int, alpha: float,
          total: int, exclude_own: bool) -> np.ndarray:
    """Log scores of some documents of a chunk."""
    size = np.diff(offsets)
    docs = len(size)
    if not len(hashes):
        return np.zeros(docs)
    log_alpha = math.log(alpha)

    def counts(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Corpus count of the n-gram of each position, 0 where there is none."""
        out = total_of[np.minimum(np.searchsorted(grams, g), len(grams) - 1)]
        if exclude_own:
            out = out - _own_counts(g, doc)
        return np.where(g == 0, 0, out)

    score = np.full(len(hashes), np.nan)
    doc = np.repeat(np.arange(docs), size)
    below = total - size[doc] if exclude_own else np.full(len(hashes), total)
    context = np.maximum(below, 1)
    for k in range(1, order + 1):
        g, _ = _ngrams(hashes, offsets, k)
        own = counts(g, doc)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = np.log(own) - np.log(context) + (order - k) * log_alpha
        score = np.where(own > 0, here, score)
        # the context of the next order at a position is this order's n-gram one word before,
        # counted where another word follows it or not, as in the count table
        context = np.append(0, own[:-1])
    score = np.where(np.isnan(score), order * log_alpha - np.log(np.maximum(below, 1)), score)
    return np.bincount(doc, weights=score, minlength=docs)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2,
                    alpha: float = 0.4, exclude_own: bool = True, docs_per_chunk: int = 4096,
                    words_per_chunk: int = 1 << 21, words_per_shard: int = 1 << 21) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every document.

    A chunk holds about ``docs_per_chunk`` documents, or ``words_per_chunk`` words if these
    are fewer documents, and a document of more words by itself."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    many, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(words.cast("long")), F.lit(0))).first()
    chunks = max(1, -(-many // docs_per_chunk), -(-total // words_per_chunk))
    # rows that share an id, or have none, are dealt by their texts
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition("chunk")
    # a shard sums some words_per_shard entries, and one row of any n-gram per chunk
    shards = 1 << _shard_bits(max(1, -(-total * order // words_per_shard)))
    grams = dealt.groupBy("chunk").applyInArrow(lambda t: _count(t, order, shards), "chunk int, shard int, g binary, n binary")
    others = grams.groupBy("shard").applyInArrow(_others, "of int, g binary, n binary")
    return dealt.groupBy("chunk").cogroup(others.groupBy("of")).applyInArrow(
        lambda t, o: _score(t, o, order, alpha, total, exclude_own) if len(t) else _score_none(),
        "doc_id long, n_tokens long, log_score double, mean_log_score double")


def _score_none() -> pa.Table:
    return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()),
                     "log_score": pa.array([], pa.float64()), "mean_log_score": pa.array([], pa.float64())})
