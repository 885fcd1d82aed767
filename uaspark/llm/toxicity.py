"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Folding comes first, in training and in scoring: compatibility forms and case, look-
alike letters of other scripts in words that mix scripts, invisible characters, and
digits or signs that stand for letters inside a word (``1d10t``).  A text becomes its
words with one space around each, so a pattern with spaces at both ends is a word or
a phrase and one with a space in front only is the beginning of words.

The lexicon is learned from labelled rows (at most about ``rows_per_label`` of each
label, picked by a hash of the id: the only sampling).  Word beginnings are counted by
documents; those at least half as much heavier in toxic documents as an entry must be
become candidates.  Their occurrences
are then counted by distinct surroundings (the words before and after), so that copies of a
document count once.  The weight is the logarithm of the rates in toxic and clean
text.  Of candidates that cover the same occurrences the longest stays; a beginning of
many words stays in their place if it weighs as much as they do.

Exception phrases take the matches inside them away: those given, and phrases of a
candidate and a neighbour that clean training texts hold in ``least_excused``
surroundings and toxic ones never; the weights are taken without them.

A document's load is the sum of the weights of its matches per hundred words (plus
``calm`` words, so that a short text needs more than one weak match).  A logistic curve
of the logarithm of the load, fitted on the same labelled rows with equal say of both
labels, gives the score.

Defined results: null, empty and wordless texts have load 0, which gets the score of
a text without a match.  With no toxic or no clean labelled row, or none that shares a
word with another, the lexicon is empty and every score is 0.  Rows without an id or a
label are not learned from; labels that repeat an id count once, as toxic if any is;
rows that share an id are scored on their own.  Columns of ``docs`` pass through; one
that bears the name of a result is renamed (``columns.set_apart``).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .columns import renamed
from .store import stored
from .texts import pieces

#: Letters of word beginnings that may enter the lexicon, besides whole words.
SHORTEST, LONGEST = 3, 12

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ɡ": "g", "ɑ": "a", "ı": "i", "ⅼ": "l",
})
# Digits and signs written for letters.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
# Phrases in which a harsh word is harmless.
HARMLESS = ("trash can", "trash bag", "trash bin", "recycling and trash", "clown fish", "circus clown", "class clown",
            "sore loser", "loser bracket", "worthless check", "stupid simple")

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]+")
_RUN = re.compile(r"[\w@$!']+")
_LATIN = re.compile("[a-z]")
_OTHER = re.compile("[Ͱ-ԯıɑɡ]")
_DIGIT = re.compile("[0-9@$!]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _word(run: str) -> list[str]:
    """The words of one run of letters, digits and signs, digits and signs folded."""
    run = run.strip("!'")
    if _LATIN.search(run):
        if _DIGIT.search(run):
            run = run.translate(STAND_INS)
        if _OTHER.search(run):
            run = run.translate(LOOKALIKES)
    return _LETTERS.findall(run)


_ODD = re.compile("[0-9@$!Ͱ-ԯıɑɡ]")


def words_of(text: str) -> list[str]:
    """Folded words of a text, in order."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if not _ODD.search(text):
        return _LETTERS.findall(text)
    return [w for run in _RUN.findall(text) for w in (_word(run) if _ODD.search(run) else _LETTERS.findall(run))]


def beginnings(word: str) -> list[str]:
    """Patterns that a word has: its beginnings, and itself with a space at the end."""
    return [f" {word[:n]}" for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f" {word} "]


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % folds


@dataclass
class Lexicon:
    """Patterns with weights, phrases that excuse matches, and the curve of the score."""
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    offset: float = -math.inf
    calm: float = 25.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            # a 1 may stand for an i or an l: folding takes the i, the pattern takes both
            for way in {pattern, pattern.replace("l", "i")}:
                if way == pattern or way not in self.weights:
                    found.add_word(way, (len(way), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase.strip()} ", (len(phrase.strip()) + 2, 0.0))
        if len(found):
            found.make_automaton()
        return found

    def load(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
        """(weight of the matches per hundred words, number of matches)."""
        words = words_of(text)
        if not words or not len(automaton):
            return 0.0, 0
        best: dict[int, float] = {}                           # heaviest match of each word, by its place
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight == 0.0:
                excused.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        for start, end in excused:
            for at in [x for x in best if start <= x < end]:
                del best[at]
        return 100 * math.fsum(best.values()) / (len(words) + self.calm), len(best)

    def score(self, load: float) -> float:
        if self.offset == -math.inf:
            return 0.0
        x = self.offset + self.slope * math.log1p(load)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_label: int) -> DataFrame:
    """(text, toxic) of at most about ``rows_per_label`` labelled ids of each label."""
    ids = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic")))
    have = {r[0]: r[1] for r in ids.groupBy("toxic").count().collect()}
    if len(have) < 2:
        return docs.select(F.col(text_col).alias("text"), F.lit(False).alias("toxic")).filter("false")
    dice = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("toxic"), rows_per_label / have[True]).otherwise(rows_per_label / have[False])
    picked = F.broadcast(ids.filter(dice < share))            # about 2 * rows_per_label rows at most
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
            .join(picked, "id").select("text", "toxic"))


def _leaning(rows: DataFrame, totals: dict[bool, int], least_docs: int, least_lean: float) -> tuple[list[str], float]:
    """Patterns that lean to toxic documents, counted by documents, and the bar they passed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found[toxic].update({b for w in set(words_of(text)) for b in beginnings(w)})
            for toxic, counts in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(counts.keys(), pa.string()), pa.array([toxic] * len(counts), pa.bool_()),
                     pa.array(counts.values(), pa.int64())], ["pattern", "toxic", "n"])

    counts = stored(rows.mapInArrow(run, "pattern string, toxic boolean, n long").groupBy("pattern")
                    .agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"),
                         F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("b"))
                    .filter(F.col("a") >= least_docs))
    bar = _bar(counts.count())
    both, share = F.col("a") + F.col("b"), totals[True] / (totals[True] + totals[False])
    toxic_part = F.col("a") * F.log(F.col("a") / both / share)
    clean_part = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / both / (1 - share))).otherwise(0.0)
    lean = F.log((F.col("a") + 0.5) / (totals[True] + 1.0)) - F.log((F.col("b") + 0.5) / (totals[False] + 1.0))
    passed = counts.filter((lean >= least_lean) & (F.col("a") / both > share) & (toxic_part + clean_part >= bar))
    return [r[0] for r in passed.select("pattern").collect()], bar


def _bar(tests: int) -> float:
    """Half the likelihood ratio that one of so many patterns reaches by chance in ten runs."""
    return math.log(10 * max(1, tests))


def _ratio(a: int, b: int, share: float) -> float:
    """Half the likelihood ratio of ``a`` toxic and ``b`` clean cases, below zero when
    they lean to clean."""
    n = a + b
    if not n or a / n <= share:
        return -1.0
    return a * math.log(a / n / share) + (b * math.log(b / n / (1 - share)) if b else 0.0)


def _occurrences(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """(word, before, after, toxic): the distinct surroundings of the words that have a
    pattern, and one row (null word) per label with the number of its words."""
    share = rows.sparkSession.sparkContext.broadcast(set(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = share.value
        for batch in pieces(batches, "text"):
            seen, size = set(), Counter()
            hits: dict[str, bool] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = words_of(text)
                size[toxic] += len(words)
                for i, w in enumerate(words):
                    hit = hits.get(w)
                    if hit is None:
                        hit = hits[w] = not wanted.isdisjoint(beginnings(w))
                    if hit:
                        seen.add((w, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "", toxic))
            out = [(*k, 1) for k in seen] + [(None, "", "", toxic, n) for toxic, n in size.items()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                                             ["word", "before", "after", "toxic", "n"])

    return rows.mapInArrow(run, "word string, before string, after string, toxic boolean, n long").groupBy(
        "word", "before", "after", "toxic").agg(F.sum("n").alias("n"))


def choose(counts: dict[str, tuple[int, int]], sizes: dict[bool, int], least: int, least_weight: float, bar: float,
           cover: float = 0.8) -> dict[str, float]:
    """Weights of the chosen patterns; ``counts`` has the (toxic, clean) surroundings of
    each pattern.  A pattern gives way to a longer one that has ``cover`` of its toxic
    occurrences, or more weight; the longer ones of a chosen pattern add nothing."""
    longer: dict[str, list[str]] = defaultdict(list)
    for pattern in counts:
        bare = pattern.rstrip(" ")
        for n in range(SHORTEST + 1, len(bare) + (pattern != bare)):
            if bare[:n] in counts:
                longer[bare[:n]].append(pattern)

    fit: dict[str, float] = {}
    share = sizes[True] / max(1, sizes[True] + sizes[False])
    for pattern, (a, b) in counts.items():
        weight = math.log((a + 0.5) / (sizes[True] + 1)) - math.log((b + 0.5) / (sizes[False] + 1))
        if (a >= least and weight >= least_weight and _ratio(a, b, share) >= bar
                and all(counts[x][0] < cover * a for x in longer[pattern])):
            fit[pattern] = weight
    chosen: dict[str, float] = {}
    covered: set[str] = set()
    for pattern in sorted(fit, key=lambda p: (len(p), p)):
        if pattern not in covered and fit[pattern] >= max((fit[x] for x in longer[pattern] if x in fit), default=-math.inf):
            chosen[pattern] = fit[pattern]
            covered.update(longer[pattern])
    return chosen


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Slope and offset of the logistic curve over log(1 + load), by Newton's method on
    the binned loads of the labelled rows; both labels weigh alike."""
    share = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = share.value
        automaton = lexicon.automaton()
        for batch in pieces(batches, "text"):
            x = [round(50 * math.log1p(lexicon.load(t, automaton)[0])) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), batch.column("toxic")], ["x", "toxic"])

    bins = rows.mapInArrow(run, "x int, toxic boolean").groupBy("x", "toxic").count().collect()    # some hundred bins
    x = np.array([r[0] / 50 for r in bins])
    y = np.array([float(r[1]) for r in bins])
    n = np.array([float(r[2]) for r in bins])
    n /= np.where(y == 1, n[y == 1].sum(), n[y == 0].sum())
    design = np.stack([np.ones(len(x)), x], 1)
    beta = np.zeros(2)
    ridge = np.diag([1e-6, 1e-4])                             # keeps the curve finite where the labels part cleanly
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -60, 60)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (n * (y - p)) - ridge @ beta)
        beta += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[1]), float(beta[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows_per_label: int = 10_000, least_docs: int = 3, least_surroundings: int = 3,
          least_weight: float = 3.0, least_excused: int = 5, exceptions: tuple[str, ...] = HARMLESS) -> Lexicon:
    """The lexicon of ``labels`` (id, label above 0 for toxic) on the texts of ``docs``."""
    rows = _sample(docs, labels, id_col, text_col, label_col, rows_per_label)
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Lexicon({})
    patterns, bar = _leaning(rows, totals, least_docs, least_weight / 2)
    if not patterns:
        return Lexicon({})
    found = stored(_occurrences(rows, patterns))
    sizes = {True: 0, False: 0} | {r[0]: r[1] for r in found.filter("word IS NULL").select("toxic", "n").collect()}
    hits = found.filter("word IS NOT NULL")
    pair = {"left": F.concat_ws(" ", "before", "word"), "right": F.concat_ws(" ", "word", "after")}
    excused = stored(hits.select(F.explode(F.array(*pair.values())).alias("phrase"), "toxic").groupBy("phrase").agg(
        F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).filter((F.col("b") >= least_excused) & (F.col("a") == 0))
        .select("phrase").filter("phrase RLIKE '[^ ] [^ ]'"))
    for side in pair.values():                                # the rest is judged without its harmless uses
        hits = hits.join(excused, side == F.col("phrase"), "left_anti")
    by_word = hits.groupBy("word").agg(
        F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).collect()      # words of the bounded sample
    wanted, counts = set(patterns), {}
    for word, a, b in by_word:
        for pattern in beginnings(word):
            if pattern in wanted:
                x, y = counts.get(pattern, (0, 0))
                counts[pattern] = x + a, y + b
    lexicon = Lexicon(choose(counts, sizes, least_surroundings, least_weight, bar))
    if not lexicon.weights:
        return lexicon
    harsh = lambda phrase: any(not set(lexicon.weights).isdisjoint(beginnings(w)) for w in phrase.split())
    learned = [r[0] for r in excused.collect()]
    lexicon.exceptions = sorted({" ".join(words_of(p)) for p in exceptions} | set(filter(harsh, learned)))
    lexicon.slope, lexicon.offset = _curve(rows, lexicon)
    return lexicon


RESULTS = [StructField("load", DoubleType()), StructField("matches", LongType()), StructField("score", DoubleType()),
           StructField("predicted", IntegerType())]


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` plus ``load``, ``matches``, ``score`` and ``predicted`` (1 from
    ``threshold`` on)."""
    work, own = renamed(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, *(f.name for f in RESULTS))
    rest = work.schema.fields
    share = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = share.value
        automaton = lexicon.automaton()
        for batch in pieces(batches, own):
            found = [lexicon.load(t or "", automaton) for t in batch.column(own).to_pylist()]
            scores = [lexicon.score(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.int64()), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())],
                [*(f.name for f in rest), *(f.name for f in RESULTS)])

    return work.mapInArrow(run, StructType([*rest, *RESULTS]))
