"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted text.  Its count tables stay DataFrames, sharded
by the hash of the n-gram: raw bigram counts with the discounts D1, D2, D3+,
continuation counts for the unigram level, and a uniform floor for words never
seen.  With base(v, w) = gamma(v) * p1(w), the interpolated probability of a bigram
is base plus what its discounted count adds, so

    log p(w | v) = log gamma(v) + log p1(w) + delta(v, w)

where delta is a property of the bigram type (zero when unseen).  Each of the
three terms is one table keyed by a hash, and a document's log-probability is
the sum over its n-grams joined to these tables.

The pairs are dealt by their words, counted with the contexts of each word and stored;
dealt once more by their contexts, each row has what its three terms need, so no
table is joined.

Documents are scored by sharded count joins.  A task packs the lookups of some
``CHUNK_WORDS`` words of documents into a chunk: per shard (the leading bits of the
hash) the distinct entries, sorted and as differences, and the documents that ask for
them.  A shard of the model, packed alike, is joined with some ``SHARD_ASKS`` lookups at
a time and returns a sum per document; the sums of a chunk meet in one group.  So the
exchange carries an entry once per chunk, not once per document, and no text.  Before
that the most frequent entries, ``HOT`` at most, are scored where the document
is, so the shards never hold a frequent n-gram, and a Bloom filter of bounded size drops
what no shard has.  Large tables are scored in ``ROUNDS`` parts, one after the other, so
that the lookups of one part lie on disk at a time; the model is packed once for all of
them.  With ``max_trusted`` None the model learns from all trusted documents
of its fold, as the query does.  A number bounds it by a sample (a hash of the id picks
documents, language by language, so that a large language leaves a small one its rows).

A document is kept when its perplexity is at most its language's threshold times
exp(``short`` / sqrt(words)), since the mean over few words varies more.  The
threshold comes from the perplexities, less that factor, of all trusted documents that
the model was not trained on, short ones too: the logarithm of the language's
``quantile``, shrunk towards that of all languages by m / (m + ``shrink``), where m is
the number of such documents of the language.

Words are runs of bytes other than white space, case and punctuation included
(junk differs there), told apart by 64-bit hashes; each text starts from a
boundary mark.

Defined results: null texts and texts without words have no perplexity and are
not kept.  With no trusted text there is no model: perplexity is null and
nothing is kept; with none left to set a threshold it is infinite.  Rows that share an
id are separate documents.  Labels that repeat an id count once; nulls in them are not
trusted.  A null language is a language of its own.  An empty table gives an empty
result; columns other than id, text and language are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import bloom
from .store import Scratch, brief_shuffles, stored, write_table
from .texts import chain, give_back, mix, pieces, word_hashes

#: Frequent table entries scored where the documents are, at most (16 bytes each; 32 MB).
HOT = 1 << 21
#: Keys of the Bloom filter that a task takes, about: each task sends a filter of its own.
KEYS_PER_TASK = 8_000_000
#: Words whose lookups are packed together, about.
CHUNK_WORDS = 3 << 20
#: Entries of a shard of the model, and lookups that meet a shard at a time, about.
SHARD_ENTRIES, SHARD_ASKS = 1 << 19, 1 << 21
#: Characters of text for each lookup that the shards are asked for, about.
CHARS_PER_ASK = 16
#: Parts that documents of more than ``ROUND_CHARS`` characters are scored in.
ROUNDS, ROUND_CHARS = 3, 1 << 25
#: Bits of the Bloom filter for each key, before they are rounded up to a power of two.
BITS_PER_KEY = 8
#: Pairs that a task counts together before they travel, and model entries packed together, about.
COMBINED = 1 << 20
_START = np.uint64(0x5151515151515151)
_KINDS = (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x3C3C3C3C3C3C3C3C), np.uint64(0))


def _positions(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, preceding word or start mark, bigram) for each word."""
    hashes, offsets = word_hashes(texts, lower=False)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.append(_START, hashes[:-1]) if len(hashes) else hashes
    before[offsets[:-1][np.diff(offsets) > 0]] = _START
    joined = np.stack([before, hashes], 1).reshape(-1)
    return doc, hashes, before, chain(joined, 2)[::2] if len(hashes) else hashes


def _entry(values: np.ndarray, kind: int) -> np.ndarray:
    """One key space for words as targets (0), words as contexts (1) and bigrams (2)."""
    return mix(values ^ _KINDS[kind]) if kind < 2 else values


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of types seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


@dataclass
class KneserNey:
    """``table``: (g, value, n), what each entry adds to the log-probability of an
    unknown word in an unknown context, which is ``unknown_word``."""
    table: DataFrame
    entries: int
    unknown_word: float


def _combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(v, w, n) of each pair once."""
    bigram, v, w, n = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(bigram)
    new = np.flatnonzero(np.append(True, np.diff(bigram[order]) != 0)) if len(order) else order
    n = np.add.reduceat(n[order], new) if len(order) else n
    first = order[new]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (v[first], w[first], n)], ["v", "w", "n"])


def train(trusted: DataFrame, text_col: str = "text") -> KneserNey | None:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []               # (bigram, v, w, n) of some texts each
        for batch in pieces(batches, "text"):
            _, word, before, bigram = _positions(batch.column("text"))
            kinds, first, n = np.unique(bigram, return_index=True, return_counts=True)
            held.append((kinds, before[first], word[first], n))
            if sum(len(h[0]) for h in held) >= COMBINED:
                yield _combined(held)
                held = []
        if held:
            yield _combined(held)

    with Scratch(trusted.sparkSession) as scratch:        # the counts go once the model is written
        return _fitted(trusted.select(F.col(text_col).alias("text")).mapInArrow(pairs, "v long, w long, n long"), scratch)


def _fitted(found: DataFrame, scratch: Scratch) -> KneserNey | None:
    """The model of the pairs ``found`` (v, w, n); its table outlives ``scratch``."""
    # dealt by the word, so that its contexts are counted where its pairs are; one row of
    # a word holds how often it was seen
    of_word = Window.partitionBy("w")
    bigrams = stored(
        found.repartition("w").groupBy("v", "w").agg(F.sum("n").alias("n"))
        .select("v", "w", "n", F.count(F.lit(1)).over(of_word).alias("k"), F.sum("n").over(of_word).alias("nw"),
                F.row_number().over(of_word.orderBy("v")).alias("i"))
        .select("v", "w", "n", "k", F.when(F.col("i") == 1, F.col("nw")).alias("nw")))
    of_counts = {r[0]: r[1] for r in bigrams.filter("n <= 4").groupBy("n").count().collect()}
    types = bigrams.count()
    if not types:
        return None
    d = _discounts(of_counts)
    # unigram level: in how many contexts a word was seen, discounted alike
    follows = bigrams.filter("nw IS NOT NULL")
    k_counts = {r[0]: r[1] for r in follows.filter("k <= 4").groupBy("k").count().collect()}
    e = _discounts(k_counts)
    words, freed = follows.agg(F.count(F.lit(1)), F.sum(_discount(F.col("k"), e))).first()
    floor = freed / types / (words + 1)           # one share of the freed mass for all unknown words
    p1 = (F.col("k") - _discount(F.col("k"), e)) / types + floor
    # dealt by the context; one row of a context holds what it adds by itself
    of_context = Window.partitionBy("v")
    dealt = (bigrams.select("v", "w", "n", "k").repartition("v")
             .select("v", "w", "n", "k", F.sum("n").over(of_context).alias("c"),
                     (F.sum(_discount(F.col("n"), d)).over(of_context) / F.sum("n").over(of_context)).alias("gamma"),
                     F.row_number().over(of_context.orderBy("w")).alias("i")))
    delta = F.log1p((F.col("n") - _discount(F.col("n"), d)) / F.col("c") / (F.col("gamma") * p1))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entry(kind: int, values: np.ndarray, value: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_entry(values, kind).view(np.int64)), value, n], ["g", "value", "n"])

        for batch in batches:
            for kind, column in ((0, "word"), (1, "context")):    # null where the row isn't the one of its word or context
                rows = batch.filter(batch.column(column).is_valid())
                yield entry(kind, rows.column("wv"[kind]).to_numpy().view(np.uint64), rows.column(column), rows.column("seen"))
            rows = batch.filter(batch.column("delta").is_valid())
            v, w = (rows.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
            yield entry(2, chain(np.stack([v, w], 1).reshape(-1), 2)[::2] if len(v) else v, rows.column("delta"), rows.column("n"))

    # words and contexts relative to what an unknown one gets, so that a missing entry adds zero
    null = F.lit(None).cast("double")
    parts = (follows.select("v", "w", "n", F.col("nw").alias("seen"), (F.log(p1) - math.log(floor)).alias("word"),
                            null.alias("context"), null.alias("delta"))
             .unionByName(dealt.select("v", "w", "n", F.col("c").alias("seen"), null.alias("word"),
                                       F.when(F.col("i") == 1, F.log("gamma")).alias("context"), delta.alias("delta"))))
    entries = parts.mapInArrow(keys, "g long, value double, n long")
    table = entries.sparkSession.read.schema(entries.schema).parquet(scratch.hand_on(write_table(entries)))
    return KneserNey(table, table.count(), math.log(floor))


def _parted(model: KneserNey) -> tuple[DataFrame, DataFrame, int]:
    """The entries that are seen often, ``HOT`` at most, the other ones, and the number of these."""
    size = F.floor(F.log2("n") * 4).cast("int")
    total, least = 0, None
    for s, many in sorted(((r[0], r[1]) for r in model.table.groupBy(size.alias("s")).count().collect()), reverse=True):
        if total + many > HOT:
            break
        total, least = total + many, s
    often = F.lit(False) if least is None else size >= least
    return model.table.filter(often), model.table.filter(~often), model.entries - total


def _sorted_entries(entries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and values."""
    found = entries.select("g", "value").toArrow()
    g = found.column("g").to_numpy().view(np.uint64)
    order = np.argsort(g)
    return g[order], found.column("value").to_numpy()[order]


def _pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes, so that like bytes are neighbours, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as their differences."""
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(_unpack(data, kind), dtype=kind)


def _edges(g: np.ndarray, bits: int) -> np.ndarray:
    """Where the shards begin in ascending ``g``, but for the first."""
    return np.searchsorted(g, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, int)


def _packed_shards(cold: DataFrame, bits: int) -> DataFrame:
    """(of, g, value): the entries packed, one row per shard and some ``COMBINED`` entries of a task."""
    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        g, value = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(g)
        g, value = g[order], value[order]
        edges = _edges(g, bits)
        out = [(i, _pack_sorted(a), _pack(b)) for i, (a, b) in enumerate(zip(np.split(g, edges), np.split(value, edges))) if len(a)]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()),
                                           *(pa.array([o[i] for o in out], pa.binary()) for i in (1, 2))], ["of", "g", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column("g").to_numpy().view(np.uint64), batch.column("value").to_numpy()))
            if sum(len(h[0]) for h in held) >= COMBINED:
                yield rows(held)
        if held:
            yield rows(held)

    return cold.select("g", "value").mapInArrow(run, "of int, g binary, value binary")


class _Chunk:
    """Documents of one task whose lookups travel together."""

    def __init__(self) -> None:
        self.words = self.docs = 0
        self.whole: list[tuple] = []                          # batches of (row, doc_id, lang, words, known)
        self.asks: list[tuple[np.ndarray, np.ndarray]] = []   # (document of the chunk, entry)

    def rows(self, bits: int) -> Iterator[pa.RecordBatch]:
        """One row with the documents, and one row for each shard that is asked: its
        distinct entries, how many documents ask for each, and which, how often."""
        columns = [pa.concat_arrays(list(x)) for x in zip(*self.whole)]
        first = columns[0][0].as_py()
        where = int(mix(np.array([first], np.int64).view(np.uint64))[0] & np.uint64((1 << bits) - 1))
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
        nothing = [pa.nulls(1, pa.binary())] * 4
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([where], pa.int32()), *map(one, columns), *nothing], _ASKED)
        doc, g = (np.concatenate([a[i] for a in self.asks]) for i in (0, 1))
        order = np.lexsort((doc, g))
        doc, g = doc[order], g[order]
        new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))) if len(g) else np.empty(0, int)
        times = np.diff(np.append(new, len(g)))
        doc, g = doc[new].astype(np.uint32), g[new]
        edges = _edges(g, bits)
        out = []
        for shard, (gs, ds, ts) in enumerate(zip(np.split(g, edges), np.split(doc, edges), np.split(times, edges))):
            if len(gs):
                kinds, askers = np.unique(gs, return_counts=True)
                out.append((shard, _pack_sorted(kinds), *(_pack(x.astype(np.uint32)) for x in (askers, ds, ts))))
        if out:
            lists = [pa.nulls(len(out), pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first] * len(out)), pa.array([o[0] for o in out], pa.int32()), *lists,
                 *(pa.array([o[i] for o in out], pa.binary()) for i in range(1, 5))], _ASKED)


_ASKED = ["chunk", "shard", "rows", "doc_ids", "langs", "words", "known", "entries", "askers", "docs", "times"]
_ASKED_TYPE = ("chunk long, shard int, rows array<long>, doc_ids array<long>, langs array<string>, words array<long>, "
               "known array<double>, entries binary, askers binary, docs binary, times binary")


def _answered(asked: pa.Table, shard: pa.Table) -> pa.Table:
    """The asks of some chunks joined with one shard of the counts: per chunk, the sums of
    its documents.  Rows with documents pass through."""
    if not len(asked):
        return asked.select(["chunk", *_ASKED[2:7], "docs", "times"]).rename_columns(_SUMS)
    give_back()
    keys = np.concatenate([_unpack_sorted(x) for x in shard.column("g").to_pylist()] or [np.empty(0, np.uint64)])
    values = np.concatenate([_unpack(x, np.float64) for x in shard.column("value").to_pylist()] or [np.empty(0)])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    docs, sums = [], []
    for entries, askers, doc, times in zip(*(asked.column(c).to_pylist() for c in _ASKED[7:])):
        if entries is None:
            docs.append(None)
            sums.append(None)
            continue
        g = _unpack_sorted(entries)
        at = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
        value = np.where(keys[at] == g, values[at], 0.0) if len(keys) else np.zeros(len(g))
        own = np.repeat(value, _unpack(askers, np.uint32)) * _unpack(times, np.uint32)
        kinds, inverse = np.unique(_unpack(doc, np.uint32), return_inverse=True)
        docs.append(_pack_sorted(kinds))
        sums.append(_pack(np.bincount(inverse, weights=own, minlength=len(kinds))))
    return pa.Table.from_arrays([asked.column("chunk"), *(asked.column(c) for c in _ASKED[2:7]),
                                 pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], _SUMS)


_SUMS = ["chunk", "rows", "doc_ids", "langs", "words", "known", "docs", "sums"]
_SUMS_TYPE = ("chunk long, rows array<long>, doc_ids array<long>, langs array<string>, words array<long>, "
              "known array<double>, docs binary, sums binary")


def _totals(parts: pa.Table) -> pa.Table:
    """(row, doc_id, lang, n_words, log_p) of the documents of one chunk."""
    parts = parts.combine_chunks()
    whole = parts.filter(parts.column("rows").is_valid())
    flat = [whole.column(c).combine_chunks().flatten() for c in _SUMS[1:6]]
    total = flat[4].to_numpy(zero_copy_only=False).copy()
    # shards in a fixed order, so that sums don't depend on how parts arrive
    answers = sorted((d, s) for d, s in zip(parts.column("docs").to_pylist(), parts.column("sums").to_pylist()) if d is not None)
    for docs, sums in answers:
        total[_unpack_sorted(docs, np.uint32)] += _unpack(sums, np.float64)           # a document at most once
    return pa.Table.from_arrays([*flat[:4], pa.array(total, pa.float64())], ["row", "doc_id", "lang", "n_words", "log_p"])


@dataclass
class _Packed:
    """A model as the documents meet it: what each task has of it (the Bloom filter of the
    shards, the keys and values of the frequent entries), and the shards, stored at ``path``."""
    share: Broadcast
    shards: DataFrame
    path: str
    bits: int
    unknown_word: float


def _packed(model: KneserNey) -> _Packed:
    """Reads the model's table for the last time."""
    hot, cold, rare = _parted(model)
    bits = max(0, math.ceil(math.log2(max(1, rare / SHARD_ENTRIES))))
    known = bloom.build(cold.coalesce(max(2, -(-rare // KEYS_PER_TASK))), "g", rare, BITS_PER_KEY, whole=True)
    g, value = _sorted_entries(hot)
    share = model.table.sparkSession.sparkContext.broadcast((known, _pack_sorted(g), _pack(value)))
    shards = _packed_shards(cold, bits)
    path = write_table(shards)
    return _Packed(share, shards.sparkSession.read.schema(shards.schema).parquet(path), path, bits, model.unknown_word)


def perplexity(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(row, doc_id, lang, n_words, perplexity) of ``docs`` (doc_id, lang, text);
    ``row`` tells rows apart that share an id."""
    return _scored(docs, _packed(model))


def _scored(docs: DataFrame, model: _Packed) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))       # by the contents, so that no round loses a row
    chars = {r[0]: r[1] or 0 for r in rows.groupBy(part).agg(F.sum(F.length("text"))).collect()}
    if sum(chars.values()) <= ROUND_CHARS:
        return _round(rows, sum(chars.values()), model)
    # each part is written before the next one begins
    return reduce(DataFrame.unionByName, [
        stored(_round(rows.filter(part == i).withColumn("row", F.col("row") * ROUNDS + i), chars[i], model)) for i in sorted(chars)])


def _round(rows: DataFrame, chars: int, model: _Packed) -> DataFrame:
    share, floor, bits = model.share, model.unknown_word, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot_g, hot_value = share.value
        hot_g, hot_value = _unpack_sorted(hot_g), _unpack(hot_value, np.float64)
        chunk = _Chunk()
        for batch in pieces(batches, "text"):
            doc, word, before, bigram = _positions(batch.column("text"))
            n = batch.num_rows
            size = np.bincount(doc, minlength=n)
            total = size * floor
            for kind, values in enumerate((word, before, bigram)):
                g = _entry(values, kind)
                at = np.minimum(np.searchsorted(hot_g, g), max(0, len(hot_g) - 1))
                here = hot_g[at] == g if len(hot_g) else np.zeros(len(g), bool)
                if len(hot_g):
                    total = total + np.bincount(doc, weights=np.where(here, hot_value[at], 0.0), minlength=n)
                rest = np.flatnonzero(~here)
                rest = rest[bloom.may_have(known, g[rest])]
                chunk.asks.append((doc[rest] + chunk.docs, g[rest]))
            chunk.whole.append((batch.column("row"), batch.column("doc_id"), batch.column("lang"),
                                pa.array(size, pa.int64()), pa.array(total, pa.float64())))
            chunk.docs += n
            chunk.words += len(word)
            if chunk.words >= CHUNK_WORDS:
                yield from chunk.rows(bits)
                chunk = _Chunk()
        if chunk.docs:
            yield from chunk.rows(bits)

    # the model travels once, and a shard again for each further ``SHARD_ASKS`` of its lookups
    groups = max(1, -(-chars // (CHARS_PER_ASK * SHARD_ASKS << bits)))
    asked = rows.mapInArrow(run, _ASKED_TYPE).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    shards = model.shards.select("of", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("for"), "g", "value")
    answers = asked.groupBy("shard", "part").cogroup(shards.groupBy("of", "for")).applyInArrow(_answered, _SUMS_TYPE)
    sums = answers.groupBy("chunk").applyInArrow(_totals, "row long, doc_id long, lang string, n_words long, log_p double")
    return sums.select("row", "doc_id", "lang", "n_words", _perplexity(F.col("log_p"), F.col("n_words")))


def _perplexity(log_p: Column, words: Column) -> Column:
    return F.when(words > 0, F.exp(-log_p / words)).alias("perplexity")


def _quota(sizes: list[tuple[int, int]], most: int) -> float:
    """The q for which languages of the given sizes, cut to q, add up to ``most``;
    ``sizes`` holds (rows, number of languages of so many rows)."""
    left, languages = float(most), sum(k for _, k in sizes)
    for n, k in sorted(sizes):
        if n * languages >= left:
            return left / languages
        left -= n * k
        languages -= k
    return math.inf


def _shares(trusted: DataFrame, most: int) -> DataFrame:
    """(of, share): the share of each language's rows to sample for ``most`` rows in
    all.  Small languages are taken whole, the others get equal numbers of rows."""
    sizes = broadcast_if_small(trusted.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("m")))
    quota = _quota([(r[0], r[1]) for r in sizes.groupBy("m").count().collect()], most)
    return sizes.select("of", F.least(F.lit(1.0), F.lit(quota) / F.col("m")).alias("share"))


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", max_trusted: int | None = 10_000, quantile: float = 0.99, short: float = 4.0,
          shrink: float = 50.0) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) of every row.

    ``trusted_ids`` has a column ``id``.  Two thirds of the trusted documents (with
    ``max_trusted``, of those sampled) train the model; all other trusted documents set
    the thresholds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    ids = broadcast_if_small(trusted_ids.select(F.col("id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct())
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(3_000_000)) / 3_000_000.0
    in_fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) < 2
    if max_trusted is None:
        trains, with_share = in_fold, lambda df: df
        chosen = rows.filter(in_fold).join(ids, "doc_id", "left_semi")
    else:
        trains = in_fold & (dice < F.col("share"))
        trusted = rows.select("doc_id", "lang").join(ids, "doc_id", "left_semi")
        shares = _shares(trusted, max_trusted)
        with_share = lambda df: df.join(shares, df["lang"].eqNullSafe(shares["of"]))
        picked = with_share(trusted).filter(trains).select(F.col("doc_id").alias("picked"), F.col("lang").alias("of")).distinct()
        picked = F.broadcast(picked)              # max_trusted documents at most, about
        chosen = rows.join(picked, (F.col("doc_id") == F.col("picked")) & F.col("lang").eqNullSafe(F.col("of")), "left_semi")
    spark = docs.sparkSession
    with brief_shuffles(spark), Scratch(spark) as scratch:
        with Scratch(spark) as training:              # the model's table goes once it is packed
            model = train(chosen.filter("text IS NOT NULL"))
            if model is None:
                return rows.select("doc_id", "lang", F.lit(0).cast("long").alias("n_words"),
                                   F.lit(None).cast("double").alias("perplexity"),
                                   F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("kept"))
            packed = _packed(model)
            training.hand_on(packed.path)
        scored = _scored(rows, packed)
        scored = spark.read.schema(scored.schema).parquet(scratch.hand_on(write_table(scored)))
    slack = F.exp(short / F.sqrt(F.greatest("n_words", F.lit(1))))
    held = with_share(scored.join(ids, "doc_id", "left_semi").filter("n_words > 0")).filter(~trains)
    cut = lambda df: df.agg(F.percentile_approx(F.log(F.col("perplexity") / slack), quantile, 10_000).alias("own"),
                            F.count(F.lit(1)).alias("m"))
    overall = cut(held.groupBy()).first()["own"]
    if overall is None:                           # no trusted document is left to judge by: all with words stay
        limit = F.lit(math.inf)
        judged = scored
    else:
        by_lang = broadcast_if_small(cut(held.groupBy("lang")).select(F.col("lang").alias("of"), "own", "m"))
        judged = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["of"]), "left")
        m = F.coalesce("m", F.lit(0))
        # the fewer held-out documents a language has, the nearer it lies to the quantile over all
        limit = F.exp((m * F.coalesce("own", F.lit(0.0)) + F.lit(shrink * overall)) / (m + shrink)) * slack
    return judged.select("doc_id", "lang", "n_words", "perplexity", limit.alias("threshold"),
                         F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))
