"""N-gram Jaccard join with rare-first prefix filtering.

Texts become sets of 64-bit hashes of five-word shingles.  Rows with the same
set are one *node*.  Shingles are put in one global order, rare first: by the
logarithm of their document frequency, counted over all documents into a fixed
number of hash buckets (a shared bucket only makes a shingle look more frequent;
any common order gives exact results), then by hash.  Two sets with Jaccard
similarity of at least t share a shingle among the first n - ceil(t n) + 1 of
each, so only these prefixes are shuffled and joined.  Pairs pass

* the length filter: t * larger <= smaller;
* the positional filter: what stands from the shared shingle on must suffice (in the
  linear rounds, what could be shared before it counts too);
* the suffix filter: the numbers of shingles of the two sets in equal ranges of
  the hash bound the overlap (first 128 ranges, then about two a shingle);

and are then verified once on the whole sets.  Whole sets are read again from
the texts, for documents of pairs that passed all filters only (a Bloom filter
of bounded size names them, by id or, without one, by set, so texts are never
shuffled).

Groups of a shingle are never expanded into all pairs.  Each member is first
paired with the first and the preceding member of its group, in the order of the
shingle's place: a set with few shingles of its own comes first, and is near many.
Verified links give components.  Only members of groups that still span several
components are paired further: every member outside a group's largest component
meets the members of other components, in lists of bounded size, and only pairs
that can be linked by size and place go on.  Two linked sets meet at the first
shingle they share; nothing before it is common, so the test there may be strict
and leaves copies with many changes out of a frequent shingle's group.  A pair
inside one component can't change the result.
A frequent shingle's group is cut into subgroups by node, whose first members
meet in a group of their own.

Defined results: null texts, texts without words and empty texts have no
shingles and are linked with nothing.  Rows that share an id are judged by their
own texts.  A null id never names a component unless its whole component has
no id.  Extra columns are ignored.  An empty table gives an empty result.
Shingles are told apart by 64-bit hashes and sets by a 64-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .columns import Neutral
from .store import brief_shuffles, components, stored
from .texts import chain, mix, pieces, word_hashes

#: A set of n shingles is counted in COARSE ranges of the hash and, finer, in 2 n to
#: 4 n, within these bounds.
COARSE, MIN_RANGES, MAX_RANGES = 128, 16, 1 << 17
#: Members of a list; sets and pairs of a tile, about.
MEMBERS, TILE_SETS, TILE_PAIRS = 512, 8192, 1 << 18
#: Bits of the hash that name a bucket of the count, and the buckets that travel in one row.
BUCKET_BITS, BLOCK = 21, 1 << 14
FACT_DOC, FACT_BUCKET = 0, 1
#: Bytes of text shingled at a time.
PIECE = 1 << 20


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, offsets = word_hashes(texts)
    runs = chain(hashes, words)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(np.unique(runs[a:b - words + 1]) if b - a >= words else chain(hashes[a:b], b - a) if b > a
                   else np.empty(0, np.uint64))
    return out


def _node(items: np.ndarray) -> int:
    """Digest of a set, as a signed 64-bit value."""
    return int(mix(np.array([mix(items).sum() + np.uint64(len(items))], np.uint64)).view(np.int64)[0])


_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _ranges(items: np.ndarray, many: int = 0) -> bytes:
    """Numbers of items in equal ranges of the hash (a power of two of them); the
    last byte tells the width of a number."""
    many = many or min(MAX_RANGES, max(MIN_RANGES, 1 << (2 * len(items)).bit_length()))
    counts = np.bincount((items >> np.uint64(64 - many.bit_length() + 1)).astype(np.int64), minlength=many)
    width = int(np.searchsorted([0xFF, 0xFFFF], counts.max()))
    return counts.astype(_WIDTHS[width]).tobytes() + bytes([width])


def _read_ranges(ranges: bytes) -> np.ndarray:
    return np.frombuffer(ranges[:-1], _WIDTHS[ranges[-1]])


def _most_common(a: np.ndarray, b: np.ndarray) -> int:
    """The overlap that two sets can have by their ranges."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        b = b.reshape(len(a), -1).sum(1)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def _facts(docs: DataFrame, words: int) -> DataFrame:
    """Rows (kind, doc_id, tag, a, b, coarse, ranges): per document its set size, node
    and ranges; per task the shingle occurrences in each block of buckets, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "tag", "a", "b", "coarse", "ranges"]
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in pieces(batches, "text", PIECE):
            sets = shingle_sets(batch.column("text"), words)
            at, many = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
            counts[at] += many.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sets), FACT_DOC, np.int8)), batch.column("doc_id"), batch.column("tag"),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_node(s) for s in sets], pa.int64()),
                 pa.array([_ranges(s, COARSE) for s in sets], pa.binary()),
                 pa.array([_ranges(s) for s in sets], pa.binary())], names)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), FACT_BUCKET, np.int8)), *[pa.nulls(len(used), pa.int64())] * 2,
             pa.array(used), pa.nulls(len(used), pa.int64()), pa.array([_pack(blocks[i]) for i in used], pa.binary()),
             pa.nulls(len(used), pa.binary())], names)

    return docs.mapInArrow(run, "kind byte, doc_id long, tag long, a long, b long, coarse binary, ranges binary")


def _pack(counts: np.ndarray) -> bytes:
    """The counts of a block: all of them or, where most are 0, the others behind their places."""
    at = np.flatnonzero(counts).astype(np.uint16)
    few = len(at) * 3 < len(counts)
    width = int(np.searchsorted([0xFF, 0xFFFF], counts.max()))
    return ((at.tobytes() if few else b"") + (counts[at] if few else counts).astype(_WIDTHS[width]).tobytes()
            + len(at).to_bytes(4, "little") + bytes([few, width]))


def _unpacked(packed: bytes) -> np.ndarray:
    many, few, width = int.from_bytes(packed[-6:-2], "little"), packed[-2], _WIDTHS[packed[-1]]
    if not few:
        return np.frombuffer(packed[:-6], width).astype(np.int64)
    counts = np.zeros(BLOCK, np.int64)
    counts[np.frombuffer(packed[:2 * many], np.uint16)] = np.frombuffer(packed[2 * many:-6], width)
    return counts


def _bucket_counts(facts: DataFrame) -> np.ndarray:
    """Shingle occurrences in each bucket; the tasks' blocks are added up where they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column("a").to_pylist(), batch.column("coarse").to_pylist()):
                total[i] = total.get(i, 0) + _unpacked(packed)
        for i, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["a", "counts"])

    packed = facts.filter(F.col("kind") == FACT_BUCKET).select("a", "coarse")
    found = packed.repartition("a").mapInArrow(run, "a long, counts binary").toArrow()
    counts = np.zeros((1 << BUCKET_BITS) // BLOCK * BLOCK, np.int64).reshape(-1, BLOCK)
    for i, block in zip(found.column("a").to_pylist(), found.column("counts").to_pylist()):
        counts[i] = np.frombuffer(block, np.int64)
    return counts.ravel()


@dataclass
class Order:
    """Which shingles are frequent: a function of the hash, alike in all tasks."""
    buckets: np.ndarray                 # level of each hash bucket, 0 unless far above the mean
    parts: np.ndarray | None            # subgroups of each bucket's shingles, if any has several

    @staticmethod
    def of_counts(counts: np.ndarray, hot_rows: int) -> Order:
        middle = np.median(counts)
        usual = middle + 2 * np.sqrt(middle) + 1        # most buckets of rare shingles hold less
        parts = (1 + np.maximum(0, counts - usual) // hot_rows).astype(np.int32)
        return Order(np.where(counts > usual, _level(counts), 0).astype(np.uint8), parts if parts.max(initial=1) > 1 else None)

    def level(self, items: np.ndarray) -> np.ndarray:
        return self.buckets[_bucket(items)]


def _bucket(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)


def _prefixes(docs: DataFrame, words: int, percent: int, order: Order) -> DataFrame:
    """Rows (h, salt, node, n, pos): the prefix shingles of every document."""
    share = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = share.value
        seen: set[int] = set()        # copies in one task add nothing; others are dropped when they meet
        for batch in pieces(batches, "text", PIECE):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for items in shingle_sets(batch.column("text"), words):
                n = len(items)
                node = _node(items)
                if not n or node in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(node)
                first = items[np.argsort(rare.level(items), kind="stable")[:n - -(-percent * n // 100) + 1]]
                salt = np.zeros(len(first), np.int32)
                if rare.parts is not None:
                    parts = rare.parts[_bucket(first)]
                    salt = ((node & 0x7FFFFFFF) % parts + (parts > 1)).astype(np.int32)
                for col, values in zip(cols, (first.view(np.int64), salt, np.full(len(first), node),
                                              np.full(len(first), n, np.int32),
                                              np.arange(len(first), dtype=np.int32))):
                    col.append(values)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 ["h", "salt", "node", "n", "pos"])

    return docs.mapInArrow(run, "h long, salt int, node long, n int, pos int")


def _fits(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and positional filter for a shared shingle at positions p1 and p2, be it
    the first that they share or not."""
    n1, p1, n2, p2 = (c.cast("long") for c in (n1, p1, n2, p2))
    most = F.least(p1, p2) + 1 + F.least(n1 - p1, n2 - p2) - 1
    return ((F.greatest(n1, n2) * percent <= F.least(n1, n2) * 100)
            & (most * (100 + percent) >= (n1 + n2) * percent))


MEMBER = ("node", "n", "pos")
PASSED = ("a", "b", "n_a", "n_b", "id_a", "id_b")


def _grouped(prefixes: DataFrame) -> DataFrame:
    """The rows of groups with two nodes or more, and of all salted groups."""
    w = Window.partitionBy("h", "salt").orderBy("node")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (prefixes.withColumn("before", F.lag("node").over(w))
            .withColumn("lo", F.first("node").over(whole)).withColumn("hi", F.last("node").over(whole)))
    return (rows.filter(F.col("before").isNull() | (F.col("before") != F.col("node")))
            .filter((F.col("lo") != F.col("hi")) | (F.col("salt") > 0)).select("h", "salt", *MEMBER))


def _linear_pairs(members: DataFrame, percent: int, order: Column, keys: tuple[str, ...]) -> DataFrame:
    """Candidate pairs (a, b) of each member with the first and the preceding member of
    its group in ``order``."""
    w = Window.partitionBy(*keys).orderBy(order, "node")
    own = F.struct(*MEMBER)
    rows = members.select(*MEMBER, F.first(own).over(w).alias("x"), F.lag(own).over(w).alias("y"))
    rows = rows.select(*MEMBER, F.explode(F.array("x", "y")).alias("o"))
    good = F.col("o").isNotNull() & (F.col("o.node") != F.col("node")) & _fits(
        F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent)
    return rows.filter(good).select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int, *kinds: str) -> DataFrame:
    """(a, b, n_a, n_b, id_a, id_b) of the pairs whose ranges allow a link, tried
    on each kind of ranges in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = [_most_common(_read_ranges(x.as_py()), _read_ranges(y.as_py()))
                    for x, y in zip(batch.column("ranges_a"), batch.column("ranges_b"))]
            keep = np.array(most, np.int64) * (100 + percent) >= total * percent
            yield batch.select(list(PASSED)).filter(pa.array(keep))

    for kind in kinds:
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"),  # noqa: B023, E731
                                      F.col("least_id").alias(f"id_{s}"), F.col(kind).alias(f"ranges_{s}"))
        pairs = (pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(*PASSED, "ranges_a", "ranges_b")
                 .mapInArrow(run, ", ".join(f"{c} long" for c in PASSED)))
    return pairs


def _sets(docs: DataFrame, passed: DataFrame, words: int) -> DataFrame:
    """(node, items) of the documents named in ``passed`` (and of a few others):
    by id, and by node where no row of a set has an id."""
    named = passed.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("a").alias("node")),
                                            F.struct(F.col("id_b").alias("id"), F.col("b").alias("node")))).alias("x")).select("x.*")
    ids = named.filter("id IS NOT NULL").select("id").distinct()
    bare = named.filter("id IS NULL").select("node").distinct()
    many = bare.count()
    share = docs.sparkSession.sparkContext.broadcast(
        (bloom.build(ids, "id", ids.count()), bloom.build(bare, "node", many) if many else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text", PIECE):
            by_id, by_node = share.value
            known = batch.filter(batch.column("doc_id").is_valid())
            known = known.filter(pa.array(bloom.may_have(by_id, known.column("doc_id").to_numpy().view(np.uint64))))
            found = {_node(s): s for s in shingle_sets(known.column("text"), words) if len(s)}
            if by_node is not None and batch.column("doc_id").null_count:
                rest = batch.filter(batch.column("doc_id").is_null())
                rest = {_node(s): s for s in shingle_sets(rest.column("text"), words) if len(s)}
                hit = bloom.may_have(by_node, np.array(list(rest), np.int64).view(np.uint64))
                found |= {k: s for (k, s), x in zip(rest.items(), hit) if x}
            found = {k: s for k, s in found.items() if k not in seen}
            seen.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.int64()),
                 pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64()))], ["node", "items"])

    return docs.mapInArrow(run, "node long, items array<long>")


def _verified(docs: DataFrame, passed: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link on their whole sets."""
    passed = stored(passed)
    sets = stored(_sets(docs, passed, words))
    side = lambda s: sets.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}"))
    overlap = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    return stored(passed.join(side("a"), "a").join(side("b"), "b")
                  .filter(overlap * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
                  .select("a", "b").distinct())


def _rest(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their component, of the shingle groups that span several."""
    rows = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the first round has paired groups of up to three members in full, unless they were cut
    mixed = (rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"),
                                   F.max("salt").alias("cut")).filter("lo != hi AND (size > 3 OR cut > 0)").select("h"))
    return rows.join(mixed, "h", "left_semi").select("h", *MEMBER, "root")


def _rest_pairs(rest: DataFrame, tried: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair across components, not ``tried`` yet, that passes the filters up
    to the coarse ranges.

    1. Members that no other of their group can reach by size and position go.
    2. A group's members lie in lists of about MEMBERS; each member outside the
       group's largest component meets the lists of its group.
    3. Pairs meet the coarse ranges of their sets in tiles of about TILE_SETS sets and
       TILE_PAIRS pairs, as many as there are sets and pairs.
    """
    # a shared shingle that isn't the first one may fail the test at its place: the pair meets at the first
    far = lambda a, b: (F.least(F.col(f"n{a}") - F.col(f"pos{a}"), F.col(f"n{b}") - F.col(f"pos{b}")).cast("long")
                        * (100 + percent) >= (F.col(f"n{a}") + F.col(f"n{b}")).cast("long") * percent)
    least = rest.groupBy("h").agg(F.min("n").alias("least"))
    shortest = F.greatest("least", F.ceil(F.col("n").cast("long") * percent / 100))
    rows = (rest.join(least, "h").filter((F.col("n") - F.col("pos")).cast("long") * (100 + percent) >= (F.col("n") + shortest) * percent)
            .select("h", *MEMBER, "root"))
    biggest = (rows.groupBy("h", "root").count().groupBy("h")
               .agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("inside"),
                    F.sum("count").alias("size"))
               .filter("inside < size").select("h", "main", "size"))
    rows = rows.join(biggest, "h").withColumn("lists", (F.col("size") / MEMBERS).cast("int") + 1)
    others = rows.select("h", F.pmod(F.xxhash64("node"), F.col("lists")).alias("list"), F.col("node").alias("y"),
                         F.col("n").alias("n_y"), F.col("pos").alias("pos_y"), F.col("root").alias("root_y"),
                         (F.col("root") == F.col("main")).alias("inside"))
    seekers = rows.filter("root != main").select(
        "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists").cast("long") - 1)).alias("list"),
        F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"), F.col("root").alias("root_x"))
    reach = F.least("n_x", "n_y").cast("long") * 100 >= F.greatest("n_x", "n_y").cast("long") * percent
    met = (seekers.join(others, ["h", "list"])
           .filter((F.col("root_x") != F.col("root_y")) & (F.col("inside") | (F.col("x") < F.col("y"))) & reach & far("_x", "_y"))
           .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    pairs = stored(met.join(tried, ["a", "b"], "left_anti"))

    many = pairs.count()
    blocks = max(1, -(-min(many, nodes.count()) // TILE_SETS))
    parts = max(1, -(-many // (blocks * TILE_PAIRS)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    shape = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("coarse").alias(f"ranges_{c}"))
    left = (pairs.groupBy("a", dealt("b", blocks).alias("block")).agg(F.collect_list("b").alias("bs")).join(shape("a"), "a")
            .withColumn("part", dealt("a", parts)))
    right = (pairs.select("b", dealt("b", blocks).alias("block"), dealt("a", parts).alias("part")).distinct()
             .join(shape("b"), "b"))

    def tile(x: pa.Table, y: pa.Table) -> pa.Table:
        sets = y.column("b").to_numpy()
        sort = np.argsort(sets)
        sets, sizes = sets[sort], y.column("n_b").to_numpy()[sort]
        ranges = _matrix(y.column("ranges_b"))[sort] if len(sets) else None
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        many = np.diff(x.column("bs").combine_chunks().offsets.to_numpy()) if x.num_rows else ()
        every = np.searchsorted(sets, x.column("bs").combine_chunks().flatten().to_numpy()) if x.num_rows else ()
        end = 0
        for a, n, own, k in zip(*(x.column(c).to_pylist() for c in ("a", "n_a", "ranges_a")), many):
            at, end = every[end:end + k], end + k
            for i in range(0, k, PIECE // COARSE):
                some = at[i:i + PIECE // COARSE]
                most = np.minimum(ranges[some], _read_ranges(own)).sum(1, dtype=np.int64)
                good = sets[some[most * (100 + percent) >= (n + sizes[some]) * percent]]
                found[0].append(np.full(len(good), a, np.int64))
                found[1].append(good)
        return pa.table([pa.array(np.concatenate(f)) for f in found], names=["a", "b"])

    return (left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
            .applyInArrow(tile, "a long, b long"))


def _matrix(ranges: pa.ChunkedArray) -> np.ndarray:
    """Coarse ranges of many sets, a row for each."""
    rows = [_read_ranges(r) for r in ranges.to_pylist()]
    return np.stack([r.astype(np.uint32) for r in rows]) if any(r.itemsize > 1 for r in rows) else np.stack(rows)


def _linked(docs: DataFrame, words: int, percent: int, hot_rows: int) -> DataFrame:
    """(doc_id, tag, n_shingles, root, component_id) for each row of ``docs`` (doc_id,
    tag, text); ``root`` names the component (null for rows without shingles)."""
    facts = stored(_facts(docs, words))
    own = facts.filter(F.col("kind") == FACT_DOC).select(
        "doc_id", "tag", F.col("a").alias("n_shingles"), F.col("b").alias("node"), "coarse", "ranges")
    full, empty = own.filter("n_shingles > 0"), own.filter("n_shingles = 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("least_id"))

    order = Order.of_counts(_bucket_counts(facts), hot_rows)
    members = stored(_grouped(_prefixes(docs, words, percent, order)))
    shapes = stored(full.join(members.select("node").distinct(), "node").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n"),
        F.any_value("coarse").alias("coarse"), F.any_value("ranges").alias("ranges")))

    salted = members.filter("salt > 0")
    heads = salted.groupBy("h", "salt").agg(F.min_by(F.struct(*MEMBER), F.struct("pos", "node")).alias("m")).select("h", "m.*")
    pairs = _linear_pairs(members, percent, F.col("pos"), ("h", "salt")).unionByName(
        _linear_pairs(heads, percent, F.col("pos"), ("h",))).distinct()
    tried = stored(pairs)
    links = _verified(docs, _suffix_filter(tried, shapes, percent, "coarse", "ranges"), words, percent)
    roots = stored(components(links))
    rest = stored(_rest(members, roots))
    passed = _rest_pairs(rest, tried, shapes, percent)
    links = links.unionByName(_verified(docs, _suffix_filter(passed, shapes, percent, "ranges"), words, percent))
    roots = components(links)

    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(ids, "root").select("node", "root", "component_id")
    return (full.join(classes, "node").select("doc_id", "tag", "n_shingles", "root", "component_id")
            .unionByName(empty.select("doc_id", "tag", "n_shingles", F.lit(None).cast("long").alias("root"),
                                      F.col("doc_id").alias("component_id"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80, hot_rows: int = 10_000) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tag"), F.col(text_col).alias("text"))
    with brief_shuffles(docs.sparkSession):
        return _linked(narrow, words, percent, hot_rows).select("doc_id", "n_shingles", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
              percent: int = 80, hot_rows: int = 10_000) -> DataFrame:
    """One row of ``docs`` for each component, and all rows without shingles.

    The row with the smallest id stays (one without an id only where no row has one; of
    rows that share it, the one whose text has the least hash; of rows alike in both,
    any).  Rows are judged by their own component: id and a hash of the text name them."""
    own = Neutral(docs)
    tagged = own.df.select("*", F.col(own[id_col]).cast("long").alias("id"), F.xxhash64(own[text_col]).alias("tag"))
    narrow = tagged.select(F.col("id").alias("doc_id"), "tag", F.col(own[text_col]).alias("text"))
    with brief_shuffles(docs.sparkSession):
        found = stored(_linked(narrow, words, percent, hot_rows).filter("n_shingles > 0").select("doc_id", "tag", "root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("m")
    first = found.groupBy("root").agg(least).select("m.doc_id", "m.tag")
    copies = found.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("copies"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["first_id"]) & (a["tag"] == b["first_tag"])
    named = first.toDF("first_id", "first_tag")
    stay = stored(copies.join(named, same(copies, named)).select("first_id", "first_tag", "copies"))
    rows = tagged.filter(F.coalesce(F.col(own[text_col]), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    kept = rows.join(stay, rows["id"].eqNullSafe(stay["first_id"]) & (rows["tag"] == stay["first_tag"]))
    out = kept.filter("copies = 1").select(*own.names)
    if not stay.filter("copies > 1").isEmpty():
        alike = kept.filter("copies > 1").groupBy("id", "tag").agg(F.any_value(F.struct(*own.names)).alias("row"))
        out = out.unionByName(alike.select("row.*"))
    blank = tagged.filter(~F.coalesce(F.col(own[text_col]), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return own.shown(out.unionByName(blank.select(*own.names)))
