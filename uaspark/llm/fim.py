"""Fill-in-middle: a document cut at two ranks and put together in another order.

A text is a row of units (a word with the white space before it; white space that
ends the text is a unit of its own).  Its ``SkipList`` holds the units in order.
Lane 0 has a node for every unit; each lane above holds about one in ``STRIDE``
nodes of the lane below, picked by a hash of the rank.  A step on any lane carries
two widths: the units and the code points it passes.  A search starts on the top
lane and goes right while the units passed stay within the rank, then down; the
code points it has added up on the way are the place of the cut.  Both cuts of a
document are searched in the same list, in a number of steps that grows with the
logarithm of its units.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``, ``plain`` the text as it is.  All choices come from
the SHA-256 of ``seed:id``: its first two 8-digit groups modulo units + 1 are the
cuts, the third and fourth modulo 100 choose whether and how to transform.

Defined results: a null text is empty; texts that are empty or hold one of the
marks stay plain.  A null id counts as an empty one.  Rows that repeat an id are cut
by the same draws, each at its own ranks.  An empty table gives an empty result.
Columns of ``docs`` pass through; one that bears the name of a result is renamed
(``columns.set_apart``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .columns import fresh, renamed
from .texts import mix, pieces

#: One node in so many is lifted to the next lane.
STRIDE = 8
#: A lane this short gets no lane above it.
TOP = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class SkipList:
    """Units in order, indexed by rank; ``widths`` are their lengths in code points."""

    def __init__(self, widths: np.ndarray):
        rank = np.arange(len(widths) + 1)                     # node r stands before unit r
        place = np.append(0, np.cumsum(widths, dtype=np.int64))
        # per lane: unit width and code-point width of each step, and the node below each node
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below = rank
        level = 0
        while True:
            self.lanes.append((np.diff(rank), np.diff(place), below))
            if len(rank) <= TOP:
                break
            level += 1
            lifted = mix(rank.astype(np.uint64) + (np.uint64(level) << np.uint64(40))) % np.uint64(STRIDE) == 0
            lifted[0] = True
            if lifted.all():
                break
            below = np.flatnonzero(lifted)
            rank, place = rank[lifted], place[lifted]

    def __len__(self) -> int:
        return int(self.lanes[0][0].sum())

    def place(self, rank: int) -> int:
        """Code points before the unit of the given rank (0 to the number of units)."""
        node = units = chars = 0
        for unit_width, char_width, below in reversed(self.lanes):
            while node < len(unit_width) and units + unit_width[node] <= rank:
                units += int(unit_width[node])
                chars += int(char_width[node])
                node += 1
            node = int(below[node])
        if units != rank:
            raise IndexError(rank)
        return chars


def unit_widths(texts: pa.Array) -> list[np.ndarray]:
    """Code points of each unit of each text; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return []
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    offsets = offsets - first
    space = _SPACE[data]
    stop = np.ones(len(data), bool)                           # the last byte of a row
    stop[:-1] = False
    stop[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = ~space
    ends[:-1] &= space[1:]
    ends |= stop                                              # a word's end, or white space that ends a row
    at = np.flatnonzero(ends) + 1
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
    cuts = np.searchsorted(at, offsets, side="right")
    return [np.diff(chars[np.append(a, at[i:j])]) for a, i, j in zip(offsets[:-1], cuts[:-1], cuts[1:])]


def _arranged(text: str, form: str, first: int, second: int) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
              percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` plus ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and
    ``output``.  ``percent`` of the documents are transformed, ``spm_percent`` of
    those into the form that begins with the suffix."""
    ids, texts = docs[id_col], docs[text_col]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    own = fresh([*docs.columns, *RESULTS], "_draws")
    work, source = renamed(docs.withColumns({text_col: texts.cast("string"), own: draws}), text_col, *RESULTS)
    rest = [f for f in work.schema.fields if f.name != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, source):
            column = batch.column(source)
            out = []
            for text, widths, (h1, h2, h3, h4) in zip(column.to_pylist(), unit_widths(column), batch.column(own).to_pylist()):
                text, n = text or "", len(widths)
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= percent:
                    out.append((n, "plain", None, None, text))
                    continue
                units = SkipList(widths)
                first, second = (units.place(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                form = "spm" if h4 % 100 < spm_percent else "psm"
                out.append((n, form, first, second - first, _arranged(text, form, first, second)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))],
                [*(f.name for f in rest), *RESULTS])

    types = [LongType(), StringType(), LongType(), LongType(), StringType()]
    return work.mapInArrow(run, StructType([*rest, *(StructField(n, t) for n, t in zip(RESULTS, types))]))


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from, read off the marks alone."""
    def between(start: Column, mark: str) -> tuple[Column, Column]:
        """What lies between a place and the next mark, and the place after the mark."""
        at = F.locate(mark, output)
        return F.substring(output, start, at - start), at + len(mark)

    def last(start: Column) -> Column:
        return F.substring(output, start, F.char_length(output))

    begin = F.lit(1 + len(PREFIX))
    prefix, after_prefix = between(begin, SUFFIX)
    suffix, after_suffix = between(after_prefix, MIDDLE)
    psm = F.concat(prefix, last(after_suffix), suffix)
    suffix, after_suffix = between(begin, PREFIX)
    prefix, after_prefix = between(after_suffix, MIDDLE)
    spm = F.concat(prefix, last(after_prefix), suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
