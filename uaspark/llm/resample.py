"""Target-distribution importance resampling over hashed n-grams.

Features are the runs of one and two words, told apart by the CRC-32 of their bytes
modulo ``buckets``.  One pass over the corpus and one over the target count the
buckets: an array per task, summed per bucket.  A bucket's gain is the logarithm of
its smoothed share of the target by its smoothed share of the corpus; a document's
weight is the mean gain of its features, looked up in that array.  Gumbel noise from
the hash of the id is added, so that taking the largest sums draws documents without
replacement in proportion to the exponentials of their weights.

The largest sums are found by a distributed radix sort from the least significant
digit (``radix_ranks``).  A pass takes one digit of the composite key (score falling,
then id): every part counts its digits, prefix sums over (digit, part) give where the
first row of each digit and part goes, and each part deals its rows out in their
present order, which keeps the pass stable.  Rows then move to the part that holds
their place.  All parts hold equally many rows whatever the key's distribution; a
task works on one part.

CRC-32 is linear, so the value of a two-word feature follows from those of its words
(shifted by the length of the second); words are hashed a byte column at a time.

Defined results: a null or wordless text has no features and weight 0.  A null id
draws its noise from the empty string and comes after all ids on ties; rows equal in
score and id take neighbouring ranks in no stated order.  An empty corpus gives an
empty result, an empty target gains from smoothing alone.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .texts import pieces

#: Bits of a digit of the radix sort.
DIGIT_BITS = 11
#: Words longer than this are hashed one by one.
LONG_WORD = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def _byte_steps() -> np.ndarray:
    """What CRC-32 does to each low byte (the reflected polynomial of zlib)."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


_STEP = _byte_steps()
_SHIFTS: dict[int, np.ndarray] = {}


def _shift(length: int) -> np.ndarray:
    """Tables (4 x 256) of the linear map by which ``length`` more bytes move a CRC."""
    if length not in _SHIFTS:
        table = (np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None])
        for _ in range(length):
            table = (table >> 8) ^ _STEP[table & 0xFF]
        if len(_SHIFTS) > 4096:
            _SHIFTS.clear()
        _SHIFTS[length] = table
    return _SHIFTS[length]


def _moved(crc: np.ndarray, length: int) -> np.ndarray:
    table = _shift(length)
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


def crc_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    length = ends - starts
    out = np.empty(len(starts), np.uint32)
    long = np.flatnonzero(length > LONG_WORD)
    for i in long:
        out[i] = zlib.crc32(data[starts[i]:ends[i]])
    order = np.argsort(-np.minimum(length, LONG_WORD + 1), kind="stable")[len(long):]
    at, size = starts[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(order)
    for i in range(int(size[0]) if live else 0):
        live = int(np.searchsorted(-size, -i, side="left"))   # spans longer than i come first
        head = crc[:live]
        crc[:live] = (head >> 8) ^ _STEP[(head ^ data[at[:live] + i]) & 0xFF]
    out[order] = ~crc
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, its text, words of each text); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.zeros(n + 1, np.int64)
    data = np.empty(0, np.uint8)
    if n:
        _, raw, bytes_ = texts.buffers()
        offsets = np.frombuffer(raw, np.int64)[texts.offset:texts.offset + n + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        if last > first:
            data = _FOLD[np.frombuffer(bytes_, np.uint8)[first:last]]
        offsets = offsets - first
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)                      # a row begins here
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    crc = crc_words(data, s, e)
    upto = np.searchsorted(s, offsets)
    words = np.diff(upto)
    doc = np.repeat(np.arange(n), words)
    # pairs: the CRC of "first " moved by the length of the second word, and the second's own
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.empty(0, int)
    with_space = _moved(crc[pair], 1) ^ np.uint32(zlib.crc32(b" "))
    size = (e - s)[pair + 1]
    joined = np.empty(len(pair), np.uint32)
    order = np.argsort(size, kind="stable")
    kinds, begin = np.unique(size[order], return_index=True)
    for length, rows in zip(kinds.tolist(), np.split(order, begin[1:])):
        joined[rows] = _moved(with_space[rows], length) ^ crc[pair[rows] + 1]
    every = np.concatenate([crc, joined]) % np.uint32(buckets)
    return every.astype(np.int64), np.concatenate([doc, doc[pair]]), words


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text"):
            total += np.bincount(features(batch.column("text"), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = (texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n"))).collect()       # ``buckets`` rows at most
    out = np.zeros(buckets, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, buckets: int) -> np.ndarray:
    all_corpus, all_target = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_corpus + buckets) / ((s + 1.0) * (all_target + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(ids: list[int | None], seed: int) -> list[int]:
    """Gumbel noise in thousandths, floored."""
    out = []
    for i in ids:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    return out


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    share = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = share.value
        for batch in pieces(batches, "text"):
            bucket, doc, words = features(batch.column("text"), len(gain))
            n = batch.num_rows
            many = np.bincount(doc, minlength=n)
            order = np.argsort(doc, kind="stable")
            total = np.append(0, np.cumsum(gain[bucket[order]]))
            last = np.cumsum(many)
            weight = (total[last] - total[last - many]) // np.maximum(many, 1)
            extra = np.array(noise(batch.column("doc_id").to_pylist(), seed), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, many, weight, weight + extra))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long"))


def _digit(key: Column, shift: int) -> Column:
    return F.shiftright(key, shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")


def _deal(rows: pa.Table, starts: pa.Table, per_part: int, key: str, shift: int) -> pa.Table:
    """One counting-sort pass over one part: the new place of each of its rows."""
    place = rows.column("place").to_numpy()
    order = np.empty(len(place), np.int64)
    order[place - place.min()] = np.arange(len(place))       # a part holds neighbouring places
    digit = ((rows.column(key).to_numpy()[order] >> shift) & ((1 << DIGIT_BITS) - 1)).astype(np.uint16)
    by_digit = np.argsort(digit, kind="stable")               # counting sort on 16-bit values
    many = np.bincount(digit, minlength=1 << DIGIT_BITS)
    first = np.zeros(1 << DIGIT_BITS, np.int64)
    first[starts.column("digit").to_numpy()] = starts.column("start").to_numpy()
    before = np.cumsum(many) - many
    sorted_digit = digit[by_digit]
    to = np.empty(len(place), np.int64)
    to[order[by_digit]] = first[sorted_digit] + np.arange(len(place)) - before[sorted_digit]
    at = rows.column_names
    return (rows.set_column(at.index("place"), "place", pa.array(to))
            .set_column(at.index("part"), "part", pa.array(to // per_part, pa.int32())))


def radix_ranks(rows: DataFrame, keys: list[tuple[str, int]], total: int, rows_per_part: int = 50_000,
                least_parts: int = 32) -> DataFrame:
    """``rows`` with ``place``, 0 to ``total`` - 1, in the order of ``keys``: (column,
    bits) from the most to the least significant, long values of 0 to 2**bits - 1.

    Parts hold ``rows_per_part`` rows, fewer where that would make less than
    ``least_parts`` of them."""
    if not total:
        return rows.withColumn("place", F.lit(None).cast("long"))
    per_part = max(1, min(rows_per_part, -(-total // least_parts)))
    # the first places: rows as they lie, numbered by the counts of the input's partitions
    lying = stored(rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    sizes = lying.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    base = stored(sizes.select("part", "least", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))
    place = F.col("base") + F.col("place") - F.col("least")   # gapless within a partition
    now = lying.join(F.broadcast(base), "part").withColumn("place", place).withColumn(
        "part", F.floor(F.col("place") / per_part).cast("int")).select(*rows.columns, "part", "place")
    for key, bits in reversed(keys):
        for shift in range(0, bits, DIGIT_BITS):
            now = stored(now)
            counts = now.groupBy(_digit(F.col(key), shift).alias("digit"), "part").agg(F.count(F.lit(1)).alias("n"))
            counts = stored(counts)
            of_digit = counts.groupBy("digit").agg(F.sum("n").alias("all"))           # 2**DIGIT_BITS rows
            first = of_digit.select("digit", (F.sum("all").over(Window.orderBy("digit")) - F.col("all")).alias("first"))
            upto = F.sum("n").over(Window.partitionBy("digit").orderBy("part"))
            starts = counts.withColumn("upto", upto).join(F.broadcast(first), "digit").select(
                "digit", "part", (F.col("first") + F.col("upto") - F.col("n")).alias("start"))
            now = now.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(
                partial(_deal, per_part=per_part, key=key, shift=shift), now.schema)
    return now.drop("part")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", percent: int = 25, least_words: int = 20, buckets: int = 10_000,
             seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank``
    counts the drawn rows from 1 and is null elsewhere."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets), buckets)
    scored = stored(weights(docs, gain, id_col, text_col, seed))
    able = scored.filter(F.col("n_words") >= least_words)
    n, low, high, first, last = able.agg(F.count(F.lit(1)), F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    keep = ["doc_id", "n_features", "weight", "score"]
    short = scored.filter(F.col("n_words") < least_words).select(*keep, F.lit(None).cast("long").alias("rank"))
    if not n:
        return short
    # ids are ranked by their distance from the least one; a null comes after them all
    span = (last - first if first is not None else 0) + 1
    fits = span < 1 << 62
    of_id = F.coalesce(F.col("doc_id") - F.lit(first or 0), F.lit(span)) if fits else None
    keys = [("_score", max(1, (high - low).bit_length()))]
    columns = {"_score": F.lit(high) - F.col("score")}
    if fits:
        columns["_id"] = of_id
        keys.append(("_id", max(1, span.bit_length())))
    else:                                                     # ids over the whole range of a long: two halves
        flipped = F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
        columns |= {"_none": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce(F.shiftrightunsigned(flipped, 32), F.lit(0)),
                    "_low": F.coalesce(flipped.bitwiseAND(0xFFFFFFFF), F.lit(0))}
        keys += [("_none", 1), ("_id", 32), ("_low", 32)]
    ranked = radix_ranks(able.select(*keep, *(c.cast("long").alias(k) for k, c in columns.items())), keys, n)
    drawn = percent * n // 100
    return ranked.select(*keep, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")).unionByName(short)
