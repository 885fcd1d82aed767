"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a partition's texts are laid out as one array of
symbols.  An index maps each adjacent pair that has a merge rank to all its
positions.  Active ranks are taken in ascending order; all positions of the
rank are merged at once, and the two neighbouring pairs of each merge leave and
enter the lists of their own ranks.  A merge only makes pairs of higher rank
(checked when the vocabulary is read), so every rank is taken once.  Texts are
then spelled with the ids of their pre-tokens.

The vocabulary is read on the driver from a path and sent to the tasks; its
size (some 50,000 merges) doesn't depend on the data.

Defined results: a null text is encoded as the empty text (no ids).  Special
tokens written in a text become their own id, as the tokenizers library does
unless told otherwise.  Texts may have any length; a pre-token may, too.  Every row is
coded on its own, repeated rows and ids too; an empty table gives an empty result.
Other columns pass through; one that bears the name of a result is renamed
(``columns.set_apart``).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .columns import fresh, renamed, set_apart
from .texts import pieces

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points that the regex module counts as letters or numbers
#: and the Unicode 16 tables of the tokenizers library don't know yet.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")

#: Symbols of pre-tokens held in one task before its memory of them is dropped.
MAX_SYMBOLS = 2_000_000
#: Pairs looked up, and pre-tokens spelled, at a time.
SLICE = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the other bytes, in order, for the
    characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """``merges[r]``: (left id, right id, new id) of rank r."""
    byte_ids: np.ndarray
    merges: list[tuple[int, int, int]]
    spelled: list[bytes]
    special: dict[str, int]

    @staticmethod
    def from_file(spark: SparkSession, path: str) -> Vocabulary:
        """Read a tokenizers JSON file through Spark, from any store that it reads."""
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if "://" in path \
            else open(path, encoding="utf-8").read()
        return Vocabulary.from_json(json.loads(text))

    @staticmethod
    def from_json(file: dict) -> Vocabulary:
        model, letters = file["model"], byte_letters()
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        spelled = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            spelled[i] = token.encode()
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        made = {left + right: rank for rank, (left, right) in enumerate(pairs)}
        merges = []
        for rank, (left, right) in enumerate(pairs):
            if max(made.get(left, -1), made.get(right, -1)) >= rank or made[left + right] != rank:
                raise ValueError(f"merge {rank} uses a token made later or makes one twice")
            merges.append((ids[left], ids[right], ids[left + right]))
        byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            byte_ids[b] = ids[c]
        return Vocabulary(byte_ids, merges, spelled, special)


@dataclass
class PairIndex:
    """Encodes many pre-tokens at once; see the module text."""
    vocabulary: Vocabulary
    keys: np.ndarray = field(init=False)
    ranks: np.ndarray = field(init=False)

    def __post_init__(self):
        m = np.array(self.vocabulary.merges, np.int64).reshape(-1, 3)
        key = m[:, 0] << 32 | m[:, 1]
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 for none; a right symbol of -1 is an end."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        if len(left) > SLICE:
            return np.concatenate([self._rank(left[i:i + SLICE], right[i:i + SLICE]) for i in range(0, len(left), SLICE)])
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, offsets of the words into them)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        n = int(offsets[-1])
        symbol = _closed(self.vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)], -1)
        at = np.arange(n)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = offsets[1:][sizes > 0]
        after[ends - 1] = before[ends - sizes[sizes > 0]] = n      # no symbol there
        after[n] = before[n] = n
        rank = _closed(self._rank(symbol[:-1], symbol[after[:-1]]), -1)     # of the pair that starts here

        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            positions = positions[rank[positions] >= 0]
            if not len(positions):
                return
            own = rank[positions]
            order = np.argsort(own, kind="stable")
            own, positions = own[order], positions[order]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, part in zip(own[np.append(0, cut)].tolist(), np.split(positions, cut)):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(part)

        add(at)
        del at
        while heap:
            r = heapq.heappop(heap)
            left, right, new = self.vocabulary.merges[r]
            found = lists.pop(r)
            p = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            p = p[rank[p] == r]
            if left == right:
                p = _alternate(p, after)
            if not len(p):
                continue
            q = after[p]                       # the right halves go
            symbol[p] = new
            symbol[q] = -2
            rank[q] = -1
            nxt = after[q]
            after[p] = nxt
            inner = nxt < n
            before[nxt[inner]] = p[inner]
            prev = before[p]
            prev = prev[prev < n]
            touched = np.concatenate([p, prev])
            rank[touched] = self._rank(symbol[touched], symbol[after[touched]])
            add(np.unique(touched))
        keep = symbol[:n] >= 0
        return symbol[:n][keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _closed(values: np.ndarray, end: int) -> np.ndarray:
    """``values`` and ``end``, in their type."""
    return np.append(values, values.dtype.type(end))


def _alternate(p: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs of one symbol with itself, those that merge: in a run of pairs
    that overlap, the first, third, fifth ..."""
    if len(p) < 2:
        return p
    linked = np.append(False, after[p[:-1]] == p[1:])
    start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(p))))
    return p[(np.arange(len(p)) - start) % 2 == 0]


class Encoder:
    """Encodes texts; remembers the pre-tokens it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.index = PairIndex(vocabulary)
        self.special = vocabulary.special
        self.split = regex.compile(SPLIT)
        self.newer = regex.compile(f"[{NEWER}]")
        self.strict = regex.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", f"(?:[{NEWER}]|[^\\s\\p{{L}}\\p{{N}}])")
                                    .replace(r"?\p{L}+", f"?(?:(?![{NEWER}])\\p{{L}})+")
                                    .replace(r"?\p{N}+", f"?(?:(?![{NEWER}])\\p{{N}})+"))
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {s: i for i, s in enumerate(self.special)}
        # pre-tokens never equal a special token: those are cut out before the split
        self.ids = np.fromiter(self.special.values(), np.int32, len(self.special))
        self.offsets = np.arange(len(self.special) + 1)

    def _words(self, text: str) -> list[str]:
        split = self.split if text.isascii() or not self.newer.search(text) else self.strict
        if self.parts is None or not any(s in text for s in self.special):
            return split.findall(text)
        out = []
        for i, part in enumerate(self.parts.split(text)):
            out.extend([part] if i % 2 else split.findall(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts into them)."""
        if len(self.ids) > MAX_SYMBOLS:
            self._forget()
        rows, fresh = [], []
        for text in texts:
            words = self._words(text)
            try:
                rows.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
            except KeyError:
                for w in words:
                    if w not in self.known:
                        self.known[w] = len(self.known)
                        fresh.append(w.encode())
                rows.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        if fresh:
            ids, offsets = self.index.encode(fresh)
            fresh = None
            self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        words = np.concatenate(rows) if rows else np.empty(0, np.int32)
        bounds = np.cumsum([0, *map(len, rows)])
        ends = np.append(0, np.cumsum((self.offsets[1:] - self.offsets[:-1])[words]))
        ids = np.empty(ends[-1], np.int32)
        for i in range(0, len(words), SLICE):
            own, to = words[i:i + SLICE], ends[i:i + SLICE + 1]
            sizes = np.diff(to)
            ids[to[0]:to[-1]] = self.ids[np.arange(to[0], to[-1]) + np.repeat(self.offsets[own] - to[:-1], sizes)]
        return ids, ends[bounds]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.spelled = vocabulary.spelled

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` plus ``ids_col`` array<int>."""
    docs, text_col = renamed(docs, text_col, ids_col)
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(share.value)
        for batch in pieces(batches, text_col):
            ids, offsets = encoder.encode([t or "" for t in batch.column(text_col).to_pylist()])
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` plus ``text_col``, the text of ``ids_col`` (null: empty)."""
    rows, ids_col = renamed(rows, ids_col, text_col)
    share = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(share.value)
        for batch in batches:
            column = batch.column(ids_col)
            texts = pa.array([decoder.decode(column[i].values.to_pylist() if column[i].is_valid else [])
                              for i in range(len(column))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))


DIGESTS = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
           StructField("decoded_sha256", StringType())]


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every column of ``docs`` but the text, and the digests of its ids and of
    the text decoded from them: ``n_tokens``, ``ids_sha256`` (decimal ids joined
    by commas) and ``decoded_sha256``; with ``keep_ids`` also ``ids`` array<int>."""
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ids_field = [StructField("ids", ArrayType(IntegerType()))] if keep_ids else []
    results = [f.name for f in (*ids_field, *DIGESTS)]
    own_text = fresh([*docs.columns, *results], "_text")
    docs = set_apart(docs.withColumnRenamed(text_col, own_text), *results)
    rest = [f for f in docs.schema.fields if f.name != own_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(share.value), Decoder(share.value)
        decimal = list(map(str, range(len(share.value.spelled))))
        for batch in pieces(batches, own_text):
            ids, offsets = encoder.encode([t or "" for t in batch.column(own_text).to_pylist()])
            spelled, back = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = ids[a:b].tolist()
                spelled.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                back.append(hashlib.sha256(decoder.decode(own).encode()).hexdigest())
            columns = [batch.column(f.name) for f in rest]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(
                [*columns, *lists, pa.array(np.diff(offsets), pa.int64()), pa.array(spelled), pa.array(back)],
                [*(f.name for f in rest), *results])

    return docs.mapInArrow(run, StructType([*rest, *ids_field, *DIGESTS]))
