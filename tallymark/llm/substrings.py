"""Substring dedup: suffix automata of reference shards give the matching statistics of what streams past them.

Every window of ``WINDOW`` consecutive words has an anchor, the 5-word gram of least hash in it (the first such), so equal
windows have equal anchors. The consecutive windows of a document with one anchor form a segment. An anchor that occurs once
in the corpus cannot hold a repeated window. The segments of each other anchor are a reference shard: its suffix automaton
knows where each of its strings began first. All segments of that anchor, of all documents, stream past it in the order of the
corpus; where the matching statistic reaches ``WINDOW`` words, the state of the last ``WINDOW`` words tells where they occurred
first, and a window goes that did not begin there. Nothing else decides.

A broadcast of all automata would grow with the corpus, and every text would pass all of them; so the shards, which no anchor
shares, are routed to the text that can match them. What bounds a shard: an anchor with more than ``MOST_SEGMENTS`` segments is
dealt out window by window, each window of it a shard of its own. Segments of equal words are sent once by each task with the
list of their places, so a passage that a third of all documents share is a few rows, and an automaton holds its words once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, range_hashes, rolling, text_slices, word_ranges

WINDOW = 20
GRAM = 5
MOST_SEGMENTS = 4000
HELD_PIECES = 50_000  # that a task gathers the places of before it sends them on
PIECES = "anchor long, first_doc long, first_start int, words binary, docs array<long>, starts array<int>"
REPEATS = "doc_id long, start int, windows int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts' segments: text, first window, number of windows and anchor."""
    starts, ends, first = word_ranges(data, offsets)
    words = range_hashes(data, starts, ends)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    grams = rolling(words, GRAM)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, WINDOW - GRAM + 1):
        less = grams[k : k + n] < least
        least[less] = grams[k : k + n][less]
        at[less] = k
    at += np.arange(n)
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(whole), bool)
    new[1:] = (at[whole[1:]] != at[whole[:-1]]) | (whole[1:] != whole[:-1] + 1)
    begin = whole[new]
    count = np.diff(np.append(np.flatnonzero(new), len(whole)))
    return doc[begin], begin - first[doc[begin]], count, least[begin]


def anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> anchors and their segments, summed within a slice."""
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            anchor, n = np.unique(segments(data, offsets)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> the distinct anchors of each document."""
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column(1)):
            doc, _, _, anchor = segments(data, offsets)
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            ids = batch.column(0).slice(row, end - row).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[new])), pa.array(anchor[new].view(np.int64))], names=["doc_id", "anchor"])


def marked(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One number for an anchor of a text."""
    return mix(anchor ^ mix(doc.astype(np.uint64)))


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, its shared anchors, its crowded anchors -> the words of their segments, or of the windows of crowded ones, with places."""
    held: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}

    def out() -> pa.RecordBatch:
        rows = [(a, docs[0], starts[0], w, docs, starts) for (a, w), (docs, starts) in held.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    def put(anchor: int, words: bytes, doc_id: int, start: int) -> None:
        places = held.get((anchor, words))
        if places is None:
            held[anchor, words] = [doc_id], [start]
            return
        docs, starts = places
        docs.append(doc_id)
        starts.append(start)
        if (doc_id, start) < (docs[0], starts[0]):  # the first place comes first
            docs[0], docs[-1], starts[0], starts[-1] = docs[-1], docs[0], starts[-1], starts[0]

    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column(1)):
            doc, start, count, anchor = segments(data, offsets)
            part = batch.slice(row, end - row)
            own = marked(doc, anchor)
            wanted = []
            for c in (2, 3):
                lists = part.column(c)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                wanted.append(np.isin(own, marked(owner, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))))
            ids, texts, at = part.column(0).to_pylist(), part.column(1), -1
            for k in np.flatnonzero(wanted[0] | wanted[1]).tolist():
                if doc[k] != at:
                    at = int(doc[k])
                    words = texts[at].as_py().encode().split()
                first, windows = int(start[k]), int(count[k])
                if not wanted[1][k]:
                    put(int(anchor[k].view(np.int64)), b" ".join(words[first : first + windows + WINDOW - 1]), ids[at], first)
                    continue
                for s in range(first, first + windows):
                    piece = b" ".join(words[s : s + WINDOW])
                    put(int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big", signed=True), piece, ids[at], s)
            if len(held) > HELD_PIECES:
                yield out()
    yield out()


class SuffixAutomaton:
    """Of several word sequences, added one after another; each state knows where its strings ended when they first came."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [(0, 0)]

    def _state(self, length: int, moves: dict[bytes, int], link: int, first: tuple[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for p's strings followed by word alone, taken out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc: int = 0, start: int = 0) -> None:
        last = 0
        for at, word in enumerate(words, start):
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0, (doc, at)), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """At each word the length of the longest known string that ends there, and its state."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            yield size, state

    def first_places(self, words: list[bytes]) -> list[tuple[int, int] | None]:
        """Of each window of the words, where it began first; none where the automaton does not know it."""
        out: list[tuple[int, int] | None] = []
        for at, (size, state) in enumerate(self.matches(words)):
            if at + 1 < WINDOW:
                continue
            if size < WINDOW:
                out.append(None)
                continue
            while self.length[self.link[state]] >= WINDOW:
                state = self.link[state]
            doc, end = self.first[state]
            out.append((doc, end - WINDOW + 1))
        return out


class Shard:
    """One anchor's automaton, and what is known of the pieces that it holds."""

    def __init__(self) -> None:
        self.known = SuffixAutomaton()
        self.places: dict[bytes, tuple[list[tuple[int, int]], bool]] = {}

    def repeats(self, words: bytes, docs: list[int], starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """A piece at its places, the first one first -> (doc_id, first window, windows) that began earlier somewhere.

        Pieces come by their first place, so what the automaton holds of a window when the piece is added is its first of all.
        """
        if words not in self.places:
            text = words.split()
            self.known.add(text, docs[0], starts[0])
            first = self.known.first_places(text)
            self.places[words] = first, all(p == (docs[0], starts[0] + k) for k, p in enumerate(first))
        first, whole = self.places[words]
        for doc, start in zip(docs, starts, strict=True):
            if whole:  # all windows of the piece came first with it
                if first[0] < (doc, start):
                    yield doc, start, len(first)
                continue
            run = 0
            for k, place in enumerate(first):
                if place < (doc, start + k):
                    run += 1
                elif run:
                    yield doc, start + k - run, run
                    run = 0
            if run:
                yield doc, start + len(first) - run, run


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor and first place -> the windows that repeat."""

    def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "start", "windows"])

    anchor, shard, waiting, found = None, Shard(), None, []
    for batch in batches:
        for a, words, docs, starts in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
            if a != anchor:
                anchor, shard, waiting = a, Shard(), (words, docs, starts)
                if len(docs) == 1:  # a piece at one place needs no automaton before another comes
                    continue
            if waiting is not None and waiting[0] is not words:
                found += shard.repeats(*waiting)
            waiting = None
            found += shard.repeats(words, docs, starts)
            if len(found) > 20_000:
                yield out(found)
                found = []
    yield out(found)


def removed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(batch.column(k) for k in range(3)), strict=True):
            words, spans = (text.as_py() or "").encode().split(), spans.as_py() or ()
            removed = 0
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["start"] + s["windows"] + WINDOW - 1] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                removed = len(words) - int(keep.sum())
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            else:
                kept = words
            rows.append((doc_id.as_py(), len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, windows): runs of windows whose words start earlier too. ``docs`` holds doc_id and text, neither null."""
    counts = docs.select("text").mapInArrow(anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    anchors = materialize(counts.select("anchor", (F.col("n") > MOST_SEGMENTS).alias("crowded")), "anchors")
    shared = docs.mapInArrow(anchor_rows, "doc_id long, anchor long").join(anchors, "anchor")
    lists = [F.collect_list(F.when(c, F.col("anchor"))).alias(n) for n, c in (("shared", ~F.col("crowded")), ("crowds", F.col("crowded")))]
    wanted = shared.groupBy("doc_id").agg(*lists)
    pieces = docs.join(wanted, "doc_id").select("doc_id", "text", "shared", "crowds").mapInArrow(piece_rows, PIECES)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "anchor").sortWithinPartitions("anchor", "first_doc", "first_start").mapInArrow(shard_rows, REPEATS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A word goes if a window of ``WINDOW`` words that covers it starts earlier as well, in a smaller doc_id or earlier in its own
    document; windows are those of the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, of whole texts; a null text has none.
    Rows that repeat a doc_id and text are one document and give equal results; a row without doc_id takes no part and keeps all.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    told = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    own = rows.where(told)
    spans = repeated_windows(own).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    others = rows.where(~told).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return own.join(spans, "doc_id", "left").select("doc_id", "text", "spans").unionByName(others).mapInArrow(removed_rows, RESULT)
