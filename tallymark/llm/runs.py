"""Maximal periodic runs of words, by the runs theorem.

Every run has a root that is the longest Lyndon word at its place under an order of the words or under the inverse
order. The longest Lyndon word at a place ends before the next smaller suffix, that is at the next smaller value of the
inverse suffix array. Roots are extended to both sides by longest common extensions: minima of the LCP array between
two ranks, from a sparse table over blocks, for the texts and for the texts reversed. There are fewer runs than words.

Many texts are worked on side by side: they stand in one array, with a border of its own value, smaller than any word
under either order, before and behind each, so that no root and no extension crosses a border.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

LEAST = 12  # words of the shortest run
BLOCK = 16  # entries of a block of the sparse table
GATHER = 1 << 20  # entries that one step of a direct comparison looks at
SLICE_BYTES = 1 << 20
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Rearrange = Callable[[int | None, list[bytes]], list[bytes]]


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by doubling: only suffixes that are not told apart yet are sorted again.

    The last entry must occur once.
    """
    n = len(s)
    bits = int(s.max()).bit_length() or 1
    known = max(1, min(6, n, 62 // bits))  # entries that fit into the first key
    key = s.astype(np.int64)
    for k in range(1, known):
        key <<= bits
        key[: n - k] |= s[k:]
    sa = np.argsort(key, kind="stable")
    at = key[sa]
    heads = np.ones(n + 1, bool)
    heads[1:-1] = at[1:] != at[:-1]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(heads[:-1], slots, 0))
    open_ = slots[~(heads[:-1] & heads[1:])]
    while len(open_):
        which = sa[open_]
        key = rank[which] * n + rank[which + known]
        order = np.argsort(key, kind="stable")
        which, at = which[order], key[order]
        sa[open_] = which
        heads = np.ones(len(open_) + 1, bool)
        heads[1:-1] = at[1:] != at[:-1]
        rank[which] = np.maximum.accumulate(np.where(heads[:-1], open_, 0))
        open_ = open_[~(heads[:-1] & heads[1:])]
        known *= 2
    return sa, rank


def common_prefixes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many entries the suffixes at a and at b share, compared side by side in growing steps. No a equals its b."""
    out, live, width, last = np.zeros(len(a), np.int64), np.arange(len(a)), 1, len(s) - 1
    while len(live):
        step = np.arange(max(1, min(width, GATHER // len(live))))
        x, y = (np.minimum((p[live] + out[live])[:, None] + step, last) for p in (a, b))
        differs = s[x] != s[y]
        ended = differs.any(axis=1)
        out[live] += np.where(ended, differs.argmax(axis=1), len(step))
        live, width = live[~ended], width * 2
    return out


def neighbour_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """LCP of each suffix with its predecessor in the suffix array.

    Where the entries before a suffix and before its predecessor are equal, the value is that of the place before less
    one. The others are compared directly; their sum is within n log n.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    first = sa[0]
    before[first] = 0
    follows = np.zeros(n, bool)
    follows[1:] = (s[:-1] == s[before[1:] - 1]) & (before[1:] > 0)
    follows[first] = False
    direct = np.flatnonzero(~follows)
    direct = direct[direct != first]
    value = np.zeros(n, np.int64)
    value[direct] = common_prefixes(s, direct, before[direct])
    places = np.arange(n)
    source = np.maximum.accumulate(np.where(follows, 0, places))
    return (value[source] - (places - source))[sa].astype(np.int32)


class Minima:
    """Range minima: a sparse table over blocks, running minima inside them."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = np.full(-(-n // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[:n] = values
        blocks = self.values.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of each low..high, both included."""
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.behind[low], self.ahead[high])
        inner = last - first - 1
        for level in range(len(self.table)):
            at = np.flatnonzero((inner >= 1 << level) & (inner < 2 << level))
            if len(at):
                t = self.table[level]
                out[at] = np.minimum(out[at], np.minimum(t[first[at] + 1], t[last[at] - (1 << level)]))
        same = np.flatnonzero(inner < 0)  # within one block
        for part in np.array_split(same, max(1, len(same) * BLOCK // GATHER)):
            step = low[part][:, None] + np.arange(BLOCK)
            seen = np.where(step <= high[part][:, None], self.values[np.minimum(step, len(self.values) - 1)], np.iinfo(np.int32).max)
            out[part] = seen.min(axis=1) if len(part) else 0
        return out


class Extensions:
    """Longest common prefix of any two suffixes of one array."""

    def __init__(self, s: np.ndarray, sa: np.ndarray, rank: np.ndarray):
        self.rank, self.minima = rank, Minima(neighbour_prefixes(s, sa))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.minima.between(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the length where there is none.

    Most are a few places ahead and are found side by side; the rest follow from right to left along those known.
    """
    n = len(rank)
    out = np.full(n, n, np.int64)
    live = np.arange(n)
    for ahead in range(1, 25):
        live = live[live + ahead < n]
        smaller = rank[live + ahead] < rank[live]
        out[live[smaller]] = live[smaller] + ahead
        live = live[~smaller]
    if len(live):
        values, found = rank.tolist(), out.tolist()
        for i in reversed(live.tolist()):
            v, j = values[i], i + 25
            while j < n and values[j] > v:
                j = found[j]
            found[i] = min(j, n)
        out = np.array(found, np.int64)
    return out


def runs_of(texts: list[list[int]], least: int = LEAST) -> list[np.ndarray]:
    """Per text of word numbers (from 0) its runs as rows of start, length, period, by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    borders = np.concatenate([[0], np.cumsum(sizes + 1)])  # places of the borders
    n = int(borders[-1]) + 1
    is_word = np.ones(n, bool)
    is_word[borders] = False
    words = np.fromiter(itertools.chain.from_iterable(texts), np.int64, int(sizes.sum()))
    if not len(words):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    s = np.empty(n, np.int64)
    s[borders] = np.arange(len(borders))
    s[is_word] = words + len(borders)
    other = s.copy()  # the inverse order of the words; borders stay smallest
    other[is_word] = int(words.max()) - words + len(borders)
    sa, rank = suffix_order(s)
    roots = []
    for r in (rank, suffix_order(other)[1]):
        start = np.flatnonzero(is_word)
        period = next_smaller(r)[start] - start
        grows = (s[start] == s[start + period]) | (s[start - 1] == s[start + period - 1])  # else it has one period only
        roots.append(np.stack([start[grows], period[grows]]))
    start, period = np.concatenate(roots, axis=1)
    right = Extensions(s, sa, rank).shared(start, start + period)
    mirror = np.ascontiguousarray(s[::-1])
    left = Extensions(mirror, *suffix_order(mirror)).shared(n - start, n - start - period)
    begin, length = start - left, left + period + right
    runs = np.stack([begin, length, period], axis=1)[(length >= 2 * period) & (length >= least)]
    runs = np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
    cuts = np.searchsorted(runs[:, 0], borders)
    out = [runs[a:b].copy() for a, b in itertools.pairwise(cuts)]
    for k, r in enumerate(out):
        r[:, 0] -= borders[k] + 1
    return out


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside all runs and in the first period of every run that holds them."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return list(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, least: int = LEAST, rearrange: Rearrange | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period in words, by start then period), collapsed (the kept words, spaced).

    A run is a stretch with smallest period q of at least ``least`` and 2q words that no neighbour extends. Its words
    after the first q go. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; ``rearrange`` may give other words for a row
    before they are searched (it gets doc_id and the words). Null text counts as empty: no words, no runs, an empty
    collapsed text. Repeated rows give repeated results and columns other than doc_id and text are not read. There is
    no shuffle: memory is an Arrow batch and, for a text of n words, some hundred bytes a word.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                texts = [data[a:b].tobytes().split() for a, b in itertools.pairwise(offsets.tolist())]
                if rearrange:
                    texts = [rearrange(i, t) for i, t in zip(ids[first:end], texts, strict=True)]
                number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
                found = runs_of([list(map(number.__getitem__, t)) for t in texts], least)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first:end], pa.int64()),
                        pa.array(list(map(len, texts)), pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in found], pa.list_(RUN)),
                        pa.array([b" ".join(kept_words(t, x)) for t, x in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, RESULT)
