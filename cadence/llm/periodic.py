"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) that is at least ``max(min_length, min_exponent * q)`` long and
that no neighbouring word extends.  Whole texts are worked off in tasks of
their own; many short texts share one pass.

Words get whole numbers as names, equal exactly where the words are.  Level by
level the dictionary names the stretches of ``b = 1, 2, 4, ...`` words: a stretch
of 2b words is named by the pair of names of its halves.  Only stretches that
return in their document no further off than a run's period can be are named on,
which leaves little of ordinary text after a few levels.  On each level a
stretch's successor is its next equal one; successors within ``2 * b`` words
propose their distance as a period.  In a run with period q <= b the successor of
every stretch lies exactly q on, so a run shows as neighbouring stretches with
the same distance: an arithmetic progression of occurrences.  Proposals are
extended to both sides as far as the period holds and taken once.

Collapsing drops a run's words after its first q.

Edge cases: a null, empty or wordless text has no runs and an empty collapsed
text; a document of any length is one row (about 40 bytes of memory a word);
rows that repeat an id are judged by their own text; a null id is an id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import textkernels as tk
from cadence.llm._common import text_or_empty

MIN_LENGTH, MIN_EXPONENT = 6, 4
BLOCK_BYTES = 1 << 20
JOIN_WORDS = 1 << 16


def _ranks(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Ranks of ``values``, which ``order`` sorts."""
    rank = np.empty(len(values), np.int64)
    if len(values):
        line = values[order]
        rank[order] = np.cumsum(np.concatenate([[0], line[1:] != line[:-1]]))
    return rank


def periodic_runs(
    names: np.ndarray, at: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (in the document), length and period of all runs, in
    this order; ``names`` are the words of all documents in a row, ``at`` the
    documents' borders."""
    n = len(names)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][doc] if n else np.empty(0, np.int64)
    farthest = (np.diff(at) // min_exponent)[doc] if n else end  # a run's largest period
    where, name = np.arange(n), names
    proposed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    b = 1
    while len(where) and b < 2 * farthest.max(initial=0) + 1:
        order = np.argsort(name, kind="stable")  # equal names by position
        i, rank = where[order], _ranks(order, name)
        same = (rank[order][1:] == rank[order][:-1]) & (doc[i][1:] == doc[i][:-1])
        gap = i[1:] - i[:-1]
        near = same & (gap <= farthest[i[:-1]])
        take = near & (gap <= 2 * b)
        first, d = i[:-1][take], gap[take]
        line = np.argsort(first)
        first, d = first[line], d[line]
        if len(first):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(d) != 0)]))
            last = np.append(new[1:], len(first)) - 1
            proposed.append((first[new], first[last] + b + d[last], d[new]))
        # the next level: stretches whose halves both return near by
        alive = np.zeros(n, bool)
        alive[i[:-1][near]] = True
        alive[i[1:][near]] = True
        named = np.full(n, -1, np.int64)
        named[where] = rank
        named[~alive] = -1
        left = np.flatnonzero(alive)
        left = left[left + 2 * b <= end[left]]
        left = left[named[left + b] >= 0]
        where, name = left, named[left] * (int(rank.max(initial=0)) + 1) + named[left + b]
        b *= 2
    if not proposed:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    s, e, q = (np.concatenate(x) for x in zip(*proposed))
    enough = e - s >= 3 * q  # of a period beyond b, a level may show only pieces shorter than that
    s, e, q = s[enough], e[enough], q[enough]
    begin = at[:-1][doc[s]]
    while len(s):
        more = (s > begin) & (names[s - 1] == names[np.minimum(s - 1 + q, n - 1)])
        if not more.any():
            break
        s = s - more
    while len(s):
        more = (e < end[s]) & (names[np.minimum(e, n - 1)] == names[e - q])
        if not more.any():
            break
        e = e + more
    length = e - s
    keep = length >= np.maximum(min_length, min_exponent * q)
    s, length, q = s[keep], length[keep], q[keep]
    order = np.lexsort((q, length, s))  # of equal stretches the smallest period
    s, length, q = s[order], length[order], q[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (length[1:] != length[:-1])]) if len(s) else np.empty(0, bool)
    s, length, q = s[first], length[first], q[first]
    order = np.lexsort((q, s))
    s, length, q = s[order], length[order], q[order]
    return doc[s], s - at[:-1][doc[s]], length, q


def _joined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> str:
    """The picked words joined by one space, neighbours in one go."""
    if not len(picks):
        return ""
    cuts = np.flatnonzero(np.diff(picks) != 1) + 1
    parts = []
    for stretch in np.split(picks, cuts):
        for a in range(0, len(stretch), JOIN_WORDS):
            some = stretch[a : a + JOIN_WORDS]
            parts.append(b" ".join(data[starts[some[0]] : starts[some[-1]] + sizes[some[-1]]].tobytes().split()))
    return b" ".join(parts).decode()


def _runs_of_blocks(rewrite: Callable | None, min_length: int, min_exponent: int, collapse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.text_blocks(batches, 1, BLOCK_BYTES):
            data, borders = tk.text_bytes(block.column(1))
            starts, sizes, names, at = tk.word_names(data, borders)
            picks = np.arange(len(names))
            if rewrite is not None:
                for r, i in enumerate(block.column(0).to_pylist()):
                    own = rewrite(i, int(at[r + 1] - at[r]))
                    if own is not None:
                        picks[at[r] : at[r + 1]] = at[r] + own
            doc, s, length, q = periodic_runs(names[picks], at, min_length, min_exponent)
            offsets = pa.array(np.searchsorted(doc, np.arange(block.num_rows + 1)), pa.int32())
            runs = pa.ListArray.from_arrays(
                offsets, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s, length, q)], ["start", "length", "period"])
            )
            columns, fields = [block.column(0), runs], ["id", "runs"]
            if collapse:
                # words that a run drops: +1 where its tail begins, -1 behind it
                depth = np.zeros(len(names) + 1, np.int64)
                np.add.at(depth, at[doc] + s + q, 1)
                np.add.at(depth, at[doc] + s + length, -1)
                kept = np.cumsum(depth)[:-1] == 0
                texts = [_joined(data, starts, sizes, picks[a:e][kept[a:e]]) for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
                columns.append(pa.array(texts, pa.string()))
                fields.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, fields)

    return run


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    rewrite: Callable[[object, int], np.ndarray | None] | None = None,
    collapse: bool = True,
) -> DataFrame:
    """Id, ``runs`` (array of ``start``, ``length``, ``period``, by start, then
    period) and ``collapsed`` (the words that stay, joined by one space) per row.

    ``rewrite(id, n)`` may give, for a document of ``n`` words, the number of
    the word that stands in each place instead of its own (null: as it is).
    ``min_exponent`` is at least 3: below, a run need not show on its level."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be at least 3")
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    schema = f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>" + (", collapsed string" if collapse else "")
    return slim.mapInArrow(_runs_of_blocks(rewrite, min_length, min_exponent, collapse), schema).withColumnRenamed("id", id_col)
