"""Language ID by word-first backoff.

A known word scores its log frequency in each language.  An unseen word falls
back to its character n-grams (word ends marked), from ``MAX_N`` down to single
characters: the longest length of which any n-gram is known gives the mean log
frequency of the known ones.  A word of which nothing is known says nothing.
The scores of all words of the whole text are added; ``score`` is the posterior
of the best language under equal priors.

A word is a letter (Unicode category L) with the letters and combining marks that
follow it, so numerals such as ``½`` or ``Ⅳ`` are none.

Training counts words per language with Spark over at most about
``rows_per_lang`` labelled rows of each language (a hash of the id picks them;
this bound is the only sampling, and a parameter).  The model keeps the
``max_words`` most frequent words and the ``max_grams`` most frequent n-grams of
each language, whatever the number of languages, so neither a large language nor a
dirty label pushes others out.  It is stored sparsely: per item, the languages that
have it and what they add to the score of one that has it not (14 bytes each, 8 to
16 bytes an item), so its size follows what was learned and not items times
languages.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is everything when no row is labelled.  Languages that tie go to the first
in alphabetical order; a text of which no word says anything gets equal scores.
Rows with a null label or id are not learned from; rows that share an id are all
learned from, and predicted on their own.  An empty table gives an empty result.
Columns of ``docs`` pass through; one that bears the name of a result is renamed
(``columns.set_apart``).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import broadcast_if_small
from .columns import fresh, renamed, set_apart
from .store import stored
from .texts import chain, pieces

MAX_N = 5
#: Words remembered by a task before it starts afresh.
MAX_KNOWN = 200_000
#: Bytes of text scored at a time.
PIECE = 1 << 20


@cache
def _word_pattern() -> re.Pattern:
    """A letter, then letters and combining marks, from the categories of Unicode."""
    def ranges(kinds: str) -> str:
        out, begin = [], None
        for c in range(sys.maxunicode + 2):
            inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
            if inside and begin is None:
                begin = c
            elif not inside and begin is not None:
                out.append(f"{chr(begin)}-{chr(c - 1)}")
                begin = None
        return "".join(out)
    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str) -> list[str]:
    return _word_pattern().findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of all words, the word of each).  Word ends are marked
    with < and >, but single characters come without the marks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes + (n == 1)
    many = np.maximum(sizes - (2 if n == 1 else n - 1), 0)
    word = np.repeat(np.arange(len(words)), many)
    place = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + begins[word]
    return chain(codes, n)[place] if len(word) else np.empty(0, np.uint64), word


def _segments(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all entries of the given rows, index into ``rows`` of each)."""
    many = starts[rows + 1] - starts[rows]
    of = np.repeat(np.arange(len(rows)), many)
    return np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + starts[rows][of], of


@dataclass
class Items:
    """Sorted hashes; entries ``starts[i]`` to ``starts[i + 1]`` tell what item i adds to
    ``base``, the score of an item in a language that doesn't have it."""
    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    deltas: np.ndarray
    base: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 for an unknown one."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def items_of(found: list[tuple[int, int, int]], totals: list[int]) -> Items:
    """``found``: (hash, language, count); add-half smoothing against the totals."""
    h = np.array([f[0] for f in found], np.uint64)
    lang, n = (np.array([f[i] for f in found], t) for i, t in ((1, np.int32), (2, np.int64)))
    return _items(h, lang, n, np.array(totals, np.float64))


def _items(h: np.ndarray, lang: np.ndarray, n: np.ndarray, totals: np.ndarray) -> Items:
    order = np.lexsort((lang, h))
    keys, first = np.unique(h[order], return_index=True)
    base = np.log(0.5 / (np.maximum(1.0, totals) + 0.5 * len(keys)))
    return Items(keys, np.append(first, len(h)), lang[order].astype(np.uint16 if len(totals) < 1 << 16 else np.int32),
                 np.log((n[order] + 0.5) / 0.5), base)


@dataclass
class LanguageModel:
    """Languages in order, and their words and n-grams."""
    languages: list[str]
    words: Items
    grams: Items

    @staticmethod
    def empty() -> LanguageModel:
        return LanguageModel([], items_of([], []), items_of([], []))

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word: 0 if known, 1 if n-grams of it are, else 2; where its entries
        start; and the languages and deltas of all entries."""
        many = len(self.languages)
        row = self.words.find(word_hashes(words))
        kind = np.where(row >= 0, 0, 2)
        known = np.flatnonzero(row >= 0)
        place, of = _segments(self.words.starts, row[known])
        word, lang, delta = [known[of]], [self.words.langs[place].astype(np.int64)], [self.words.deltas[place]]
        left = np.flatnonzero(row < 0)
        for n in range(MAX_N, 0, -1):
            if not len(left):
                break
            hashes, gram_word = gram_hashes([words[i] for i in left.tolist()], n)
            at = self.grams.find(hashes)
            at, gram_word = at[at >= 0], gram_word[at >= 0]
            hits = np.bincount(gram_word, minlength=len(left))
            place, of = _segments(self.grams.starts, at)
            # entries of one word and language are added up: the mean over its known n-grams
            key, inverse = np.unique(gram_word[of] * many + self.grams.langs[place], return_inverse=True)
            own = key // many
            word.append(left[own])
            lang.append(key % many)
            delta.append(np.bincount(inverse, weights=self.grams.deltas[place], minlength=len(key)) / hits[own])
            kind[left[hits > 0]] = 1
            left = left[hits == 0]
        word, lang, delta = (np.concatenate(x) for x in (word, lang, delta))
        order = np.argsort(word, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))
        return kind, starts, lang[order], delta[order]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_lang: int = 5_000, max_words: int = 60_000, max_grams: int = 60_000) -> LanguageModel:
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()) \
        .select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shares = broadcast_if_small(rows.groupBy("lang").agg((F.lit(rows_per_lang) / F.count(F.lit(1))).alias("share")))
    languages = sorted(r[0] for r in shares.select("lang").collect())        # the model has a place for each
    if not languages:
        return LanguageModel.empty()
    dice = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    rows = rows.join(shares, "lang").filter(dice < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(words_of(text)).items():
                    found[lang, word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                 pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words (kind 0) and n-grams (kind 1) by their hashes, added up per batch."""
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lang = batch.column("lang").dictionary_encode()
            code = lang.indices.to_numpy()
            for kind, parts in ((0, [(word_hashes(words), np.arange(len(words)))]),
                                (1, [gram_hashes(words, size) for size in range(1, MAX_N + 1)])):
                h, of = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((h, code[of]))
                h, of = h[order], of[order]
                new = np.append(True, (h[1:] != h[:-1]) | (code[of[1:]] != code[of[:-1]])) if len(h) else np.empty(0, bool)
                first = np.flatnonzero(new)
                total = np.add.reduceat(n[of], first) if len(first) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), kind, np.int32)), lang.dictionary.take(pa.array(code[of[first]])),
                     pa.array(h[first].view(np.int64)), pa.array(total, pa.int64())], ["kind", "lang", "h", "n"])

    words = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    items = stored(words.mapInArrow(spell, "kind int, lang string, h long, n long")
                   .groupBy("kind", "lang", "h").agg(F.sum("n").alias("n")))
    # per language, the count above which all items stay, and the share of those that have it
    most = F.when(F.col("kind") == 0, max_words).otherwise(max_grams)
    upto = F.sum("items").over(Window.partitionBy("kind", "lang").orderBy(F.desc("n")))      # a row per distinct count
    sizes = items.groupBy("kind", "lang", "n").agg(F.count(F.lit(1)).alias("items")).withColumn("upto", upto)
    cut = sizes.filter(F.col("upto") > most).groupBy("kind", "lang").agg(
        F.max("n").alias("least"), F.max_by((most - F.col("upto") + F.col("items")) / F.col("items"), "n").alias("part"))
    tie = F.pmod(F.xxhash64("h"), F.lit(1_000_003)) / 1_000_003.0
    keep = F.col("least").isNull() | (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (tie < F.col("part")))
    best = items.join(broadcast_if_small(cut), ["kind", "lang"], "left").filter(keep).select("kind", "h").distinct()
    found = items.join(best, ["kind", "h"], "left_semi").toArrow()
    totals = {(r[0], r[1]): r[2] for r in items.groupBy("kind", "lang").agg(F.sum("n")).collect()}
    kinds = found.column("kind").to_numpy()
    of_lang = {lang: i for i, lang in enumerate(languages)}
    named = found.column("lang").combine_chunks().dictionary_encode()
    place = np.array([of_lang[x] for x in named.dictionary.to_pylist()], np.int32)
    lang = place[named.indices.to_numpy()] if len(found) else np.empty(0, np.int32)
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    return LanguageModel(languages, *(
        _items(h[kinds == kind], lang[kinds == kind], n[kinds == kind],
               np.array([totals.get((kind, x), 0) for x in languages], np.float64)) for kind in (0, 1)))


class Scorer:
    """Predicts texts; remembers the entries of the words it has met, up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.kind = np.empty(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.langs = np.empty(0, np.int32)
        self.deltas = np.empty(0)

    def _meet(self, words: list[str]) -> None:
        kind, starts, langs, deltas = self.model.rows(words)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.kind = np.append(self.kind, kind)
        self.starts = np.append(self.starts, starts[1:] + self.starts[-1])
        self.langs, self.deltas = np.append(self.langs, langs.astype(np.int32)), np.append(self.deltas, deltas)

    def totals(self, found: list[list[str]]) -> np.ndarray:
        """Scores (texts x languages) of texts given as words."""
        if len(self.place) > MAX_KNOWN:
            self._forget()
        new = [w for w in dict.fromkeys(chained.from_iterable(found)) if w not in self.place]
        if new:
            self._meet(new)
        many, place = len(self.model.languages), self.place.__getitem__
        doc = np.repeat(np.arange(len(found)), [len(w) for w in found])
        row = np.fromiter(map(place, chained.from_iterable(found)), np.int64, len(doc))
        key, times = np.unique(doc * max(1, len(self.place)) + row, return_counts=True)
        doc, row = key // max(1, len(self.place)), key % max(1, len(self.place))
        at, of = _segments(self.starts, row)
        total = np.bincount(doc[of] * many + self.langs[at], weights=self.deltas[at] * times[of],
                            minlength=len(found) * many).astype(float).reshape(len(found), many)
        for kind, items in enumerate((self.model.words, self.model.grams)):
            mine = self.kind[row] == kind
            total += np.bincount(doc[mine], weights=times[mine], minlength=len(found))[:, None] * items.base
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model.languages
        found = [words_of(text or "") for text in texts]
        if not languages or not texts:
            return [("und", 0.0)] * len(texts)
        total = self.totals(found)
        best = total.argmax(1)
        share = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(1)
        return [(languages[b], s) if words else ("und", 0.0) for words, b, s in zip(found, best.tolist(), share.tolist())]


PREDICTED = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, if not ``keep_text``) plus ``lang_pred`` and ``score``."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    if keep_text:
        work, own = renamed(docs, text_col, *(f.name for f in PREDICTED))
    else:
        own = fresh([*docs.columns, *(f.name for f in PREDICTED)], "_text")
        work = set_apart(docs.withColumnRenamed(text_col, own), *(f.name for f in PREDICTED))
    rest = [f for f in work.schema.fields if keep_text or f.name != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(share.value)
        for batch in pieces(batches, own, PIECE):
            found = scorer.predict(batch.column(own).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                [*(f.name for f in rest), *(f.name for f in PREDICTED)])

    return work.mapInArrow(run, StructType([*rest, *PREDICTED]))


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % folds
