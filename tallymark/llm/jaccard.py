"""N-gram Jaccard join: count-vector R-trees over lists of documents that share a rare shingle.

A document is the set of its 5-word shingles. Its shingles are hashed into groups, and the counts by group are a point;
the overlap of two sets is at most the sum over the groups of the smaller count, and for two boxes of points at most
that sum over their upper corners. An R-tree over all documents cannot prune by such boxes (unrelated texts of one length
have much the same counts), so the trees stand on lists that a link cannot avoid: both ends of a link share one of the
first shingles of their sets in one global order (prefix filter). That order puts shingles that are common in a sample last.

Per list, first every member is tried against one head of the list only, which joins groups of near copies in as many
trials as they have members. Then each list's tree gives the pairs of members that are not yet in one component and whose bound
allows a link. A list with many of those gives for each member that of greatest bound first, and what is still open once
those are verified. Equal sets are one node throughout. All of it is exact up to equal 64-bit hashes of different shingles.

Prefixes are whole: n - ceil(0.75 n) + 1 of the n shingles of a set. One shuffle brings the rare ones together, and lists of one
document end there. A list is named by its members, so the many lists of one passage or one group of copies are one list.
A list of more than ``CROWD`` members is dealt out by bands of set sizes and, within a band, by pairs of blocks.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, mix, range_hashes, rolling, text_slices, word_ranges
from .components import components
from .exact_dedup import tree_merge, with_runs

WIDTH = 5
SIMILARITY = 75  # per cent
GROUP_BITS = (9, 16)  # log2 of the fewest and most groups of a count vector: 2 to 4 groups a shingle
COARSE = 64  # groups of the boxes
LEAF = 32
CROWD = 2048  # members of a list that one task compares
BAND = 1.35  # ratio of set sizes of a band; sizes of sets that link differ by less
OPEN_PAIRS = 1  # open pairs by member up to which a list gives them all at once
PACKED_BITS = 22  # of the hashes in packed sets
SEEN_LISTS = 200_000  # names of lists that a task remembers, so as to write equal ones once
SET_ROWS = "doc_id long, n int, d1 long, d2 long, commons array<long>, vector binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another, and where each text's begin.

    With fewer than ``WIDTH`` words the whole sequence is one shingle; without words there is none.
    """
    data = lower_ascii(data)
    starts, ends, first = word_ranges(data, offsets)
    words = range_hashes(data, starts, ends)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = rolling(words, WIDTH)
    whole = doc[: len(grams)] == doc[WIDTH - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    hashes = np.concatenate([grams[whole], range_hashes(words, first[short], first[short + 1], which=1)])
    owner = np.concatenate([doc[: len(grams)][whole], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def count_vector(hashes: np.ndarray) -> bytes:
    """Counts by group in bit planes: log2 of the groups, what counts exceed 2 by, the groups counted once or more, twice or more."""
    bits = min(GROUP_BITS[1], max(GROUP_BITS[0], math.ceil(math.log2(max(2 * len(hashes), 1)))))
    counts = np.bincount((hashes >> np.uint64(20) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return struct.pack("<BI", bits, int(np.maximum(counts - 2, 0).sum())) + np.packbits(counts > 0).tobytes() + np.packbits(counts > 1).tobytes()


class CountVectors:
    """Count vectors over one number of groups, the least of theirs: equal places of larger ones are added up."""

    def __init__(self, vectors: list[bytes]):
        heads = np.frombuffer(b"".join(v[:5] for v in vectors), np.dtype([("bits", "u1"), ("excess", "<u4")]))
        bits = int(heads["bits"].min())
        self.excess = heads["excess"].astype(np.int64)
        half = (1 << bits) // 8
        self.once, self.twice = np.zeros((len(vectors), half), np.uint8), np.zeros((len(vectors), half), np.uint8)
        for own in np.unique(heads["bits"]).tolist():
            at = np.flatnonzero(heads["bits"] == own)
            planes = np.frombuffer(b"".join(vectors[k][5:] for k in at), np.uint8).reshape(len(at), 2, -1)
            if own > bits:
                counts = np.unpackbits(planes, axis=2).sum(axis=1, dtype=np.uint8).reshape(len(at), -1, 1 << bits).sum(axis=1, dtype=np.int32)
                self.excess[at] += np.maximum(counts - 2, 0).sum(axis=1)
                planes = np.stack([np.packbits(counts > 0, axis=1), np.packbits(counts > 1, axis=1)], axis=1)
            self.once[at], self.twice[at] = planes[:, 0], planes[:, 1]
        self.planes = np.concatenate([self.once, self.twice], axis=1).view(np.uint64)

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At least the overlap of the sets a and b: summed minima of their counts."""
        both = np.bitwise_count(self.planes[a] & self.planes[b]).sum(axis=1, dtype=np.int64)
        return both + np.minimum(self.excess[a], self.excess[b])

    def coarse(self) -> np.ndarray:
        """Counts over COARSE groups, for boxes; what counts exceed 2 by is left out."""
        counts = np.unpackbits(self.once, axis=1).astype(np.int32) + np.unpackbits(self.twice, axis=1)
        return counts.reshape(len(counts), -1, COARSE).sum(axis=1)


def prefix(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order (common last, then by hash), as many as a link needs: the rare and the common ones."""
    n = len(hashes)
    full = n - -(-SIMILARITY * n // 100) + (n > 0)
    is_common = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(n, bool)
    rare = hashes[~is_common][:full]
    return rare, hashes[is_common][: full - len(rare)]


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat))


def set_rows(docs: DataFrame, common: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                hashes, at = shingle_sets(data, offsets)
                spread = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                digests = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in spread]
                sets = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                lists = list_array([prefix(s, shared.value)[1] for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start).cast(pa.int64()), pa.array(np.diff(at).astype(np.int32)), pa.array(digests[0]), pa.array(digests[1]), lists, pa.array([count_vector(s) for s in sets], pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "commons", "vector"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, SET_ROWS)


def rare_postings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """key and doc_id for the rare shingles of each prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                hashes, at = shingle_sets(data, offsets)
                keys = [prefix(hashes[a:b], shared.value)[0] for a, b in zip(at[:-1], at[1:], strict=True)]
                doc = np.repeat(batch.column(0).slice(start, end - start).cast(pa.int64()).to_numpy(), [len(k) for k in keys])
                flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(doc, pa.int64())], names=["key", "doc_id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(rows, "key long, doc_id long")


def repeated_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and doc_id -> the lists of two or more documents, each under a key made of its members.

    Two lists under one key are one longer list, so nothing is lost by it.
    """
    held_key, held_doc, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), set()

    def lists(keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[new], docs[new]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        members = np.diff(np.append(first, len(keys)))
        names = (np.add.reduceat(mix(docs.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)).view(np.int64)
        take = members > 1
        for k in np.flatnonzero(take):
            name = int(names[k])
            take[k] = name not in seen
            seen.add(name)
        if len(seen) > SEEN_LISTS:
            seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names[take], members[take])), pa.array(docs[np.repeat(take, members)])], names=["key", "doc_id"])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column(0).to_numpy()])
        docs = np.concatenate([held_doc, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on
        held_key, held_doc = keys[cut:], docs[cut:]
        if cut:
            yield lists(keys[:cut], docs[:cut])
    yield lists(held_key, held_doc)


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and all shingle hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                hashes, at = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, shingles array<long>")


def pack(hashes: np.ndarray) -> bytes:
    """The distinct upper PACKED_BITS of sorted hashes as steps from one to the next: two bytes each where they fit, else four."""
    values = np.unique(hashes >> np.uint64(64 - PACKED_BITS)).astype(np.uint32)
    steps = np.diff(values, prepend=np.uint32(0))
    kind = np.uint16 if steps.max(initial=0) < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint16 if packed[0] == 2 else np.uint32, offset=1), dtype=np.int64)


def packed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, number of shingles and the packed set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                hashes, at = shingle_sets(data, offsets)
                sets = [pack(hashes[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).cast(pa.int64()), pa.array(np.diff(at).astype(np.int32)), pa.array(sets, pa.binary())], names=["doc_id", "n", "packed"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n int, packed binary")


def common_shingles(docs: DataFrame, sample_docs: int = 4096, in_docs: int = 8, most: int = 65_536) -> np.ndarray:
    """Shingles of ``in_docs`` or more documents of a sample of about ``sample_docs``; at most ``most`` of them.

    They only shape the order of the index: whatever it is, no link is lost.
    """
    n = docs.count()
    draw = F.xxhash64("doc_id", F.lit("shingle-sample")) / F.lit(2.0**64) + 0.5
    sample = full_sets(docs.where(draw < sample_docs / max(n, 1)))
    counted = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= in_docs)
    return np.sort(np.array([r["s"] for r in counted.orderBy(F.desc("n"), "s").limit(most).collect()], np.int64).view(np.uint64))


class CountTree:
    """An R-tree of count vectors: points sorted by set size and then by their most varying group, packed into leaves.

    Boxes are bounded over coarse groups, pairs of points by their whole vectors.
    """

    def __init__(self, sizes: np.ndarray, vectors: CountVectors):
        points = vectors.coarse()
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * max(1, math.isqrt(len(sizes) // LEAF))
        for a in range(0, len(order), slab):
            part = order[a : a + slab]
            order[a : a + slab] = part[np.argsort(points[part, points[part].var(axis=0).argmax()], kind="stable")]
        self.sizes, self.order, self.vectors = sizes, order, vectors
        self.slack, self.levels = int(vectors.excess.max()), []
        low, high, top = sizes[order], sizes[order], points[order]
        while True:
            self.levels.append((low, high, top))
            if len(low) == 1:
                break
            at = np.arange(0, len(low), LEAF)
            low, high, top = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at, axis=0)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points whose sizes and bound allow a link, each once, with the bound in thousandths of the sizes' sum."""
        work = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, a, b = work.pop()
            low, high, top = self.levels[level]
            near = (100 * high[a] >= SIMILARITY * low[b]) & (100 * high[b] >= SIMILARITY * low[a])
            a, b = a[near], b[near]
            if level == 0:
                a, b = self.order[a], self.order[b]
                bound, need = self.vectors.bound(a, b), self.sizes[a] + self.sizes[b]
            else:
                bound, need = np.minimum(top[a], top[b]).sum(axis=1) + self.slack, low[a] + low[b]
            near = (100 + SIMILARITY) * bound >= SIMILARITY * need
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level == 0:
                yield a, b, 1000 * bound[near] // need[near]
                continue
            below = len(self.levels[level - 1][0])
            steps = np.arange(LEAF)
            for at in range(0, len(a), 32):
                x, y = np.broadcast_arrays((a[at : at + 32, None] * LEAF + steps)[:, :, None], (b[at : at + 32, None] * LEAF + steps)[:, None, :])
                x, y = x.ravel(), y.ravel()
                ok = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
                work.append((level - 1, x[ok], y[ok]))


def list_pairs(part: np.ndarray, sizes: np.ndarray, vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of places of one list, in different components, that may link, with their bound.

    Sizes of sets that link differ by a third at most, and so the logarithms of their groups by one: each such band has its own
    tree, or a small set would fold the vectors of large ones to its few groups.
    """
    bits = np.array([v[0] for v in vectors])
    for least in np.unique(bits):
        at = np.flatnonzero((bits == least) | (bits == least + 1))
        for a, b, bound in band_pairs(part[at], sizes[at], [vectors[k] for k in at]):
            a, b = at[a], at[b]
            own = (bits[a] == least) | (bits[b] == least)  # the others belong to the next band
            yield a[own], b[own], bound[own]


def band_pairs(part: np.ndarray, sizes: np.ndarray, vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of one band of a list."""
    if len(sizes) < 2:
        return
    sizes, points = sizes.astype(np.int64), CountVectors(vectors)
    if len(sizes) > LEAF:
        for a, b, bound in CountTree(sizes, points).pairs():
            other = part[a] != part[b]
            yield a[other], b[other], bound[other]
        return
    a, b = np.triu_indices(len(sizes), 1)  # a single leaf: no tree above it
    near = np.flatnonzero((part[a] != part[b]) & (100 * sizes[a] >= SIMILARITY * sizes[b]) & (100 * sizes[b] >= SIMILARITY * sizes[a]))
    if len(near):
        a, b = a[near], b[near]
        bound, total = points.bound(a, b), sizes[a] + sizes[b]
        near = (100 + SIMILARITY) * bound >= SIMILARITY * total
        yield a[near], b[near], 1000 * bound[near] // total[near]


def best_partners(best: np.ndarray, partner: np.ndarray, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> None:
    """Enter the pairs (a, b) where they exceed the best bound of either end so far."""
    for x, y in ((a, b), (b, a)):
        order = np.lexsort((y, bound, x))  # the last of each x has the greatest bound
        last = order[np.append(np.flatnonzero(np.diff(x[order])), len(order) - 1)] if len(order) else order
        last = last[bound[last] > best[x[last]]]
        best[x[last]], partner[x[last]] = bound[last], y[last]


def group_pairs(rows: pa.Table, crossing: bool, most: int | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """Open pairs (doc_id, doc_id) of one group of a list, and whether these are only the best ones of each member.

    That is so with more than ``most`` open pairs by member; without ``most`` all are given.
    """
    doc, part, sizes, block, own = (rows[c].to_numpy() for c in ("doc_id", "part", "n", "block", "own"))
    best, partner = np.full(len(doc), -1), np.zeros(len(doc), np.int64)
    found, count, cut = [], 0, False
    for a, b, bound in list_pairs(part, sizes, rows["vector"].to_pylist()):
        belongs = own[a] | own[b]
        if crossing:
            belongs &= block[a] != block[b]
        a, b = a[belongs], b[belongs]
        if most is not None:
            best_partners(best, partner, a, b, bound[belongs])
        count += len(a)
        cut |= most is not None and count > most * len(doc)
        found = [] if cut else [*found, (a, b)]
    if cut:
        a = np.flatnonzero(best >= 0)
        found = [(a, partner[a])]
    return [(np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])) for a, b in found], cut


def tree_rows(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, band, i, j -> pairs (a, b), each once a batch, and (key, null) for lists with more open pairs than given."""
    pairs, unfinished = [], set()

    def out() -> Iterator[pa.RecordBatch]:
        once = np.unique(np.array([np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*pairs, strict=True)] if pairs else [[], []], np.int64), axis=1)
        left = np.array(sorted(unfinished), np.int64)
        pairs.clear()
        unfinished.clear()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([once[0], left])), pa.array(np.concatenate([once[1], left]), mask=np.arange(once.shape[1] + len(left)) >= once.shape[1])], names=["a", "b"])

    def flush(held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held)
        key, _, i, j = (rows[k][0].as_py() for k in range(4))
        found, cut = group_pairs(rows, i != j, most)
        pairs.extend(found)
        if cut:
            unfinished.add(key)

    held, group = [], None
    for batch in batches:
        keys = np.array([batch.column(k).to_numpy() for k in range(4)], np.int64)
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = tuple(keys[:, a].tolist())
            if held and group != own:
                flush(held)
                held = []
            group = own
            held.append(batch.slice(a, b - a))
        if sum(len(a) for a, _ in pairs) > 50_000:
            yield from out()
    if held:
        flush(held)
    yield from out()


def concerned(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents in the pairs."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return docs.select("doc_id", "text").join(ends, "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by whole sets made anew from the texts of the documents concerned."""
    sets = materialize(full_sets(concerned(pairs, docs)).dropDuplicates(["doc_id"]), "shingles")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where((100 + SIMILARITY) * F.size(F.array_intersect("x", "y")) >= SIMILARITY * (F.size("x") + F.size("y"))).select("a", "b")


def nearly(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link by packed sets, which overlap no less than the whole ones; worth it where most pairs do not link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                x, y = unpack(x), unpack(y)
                overlap = len(np.intersect1d(x, y, assume_unique=True)) + (n - len(x)) + (m - len(y))
                keep.append((100 + SIMILARITY) * overlap >= SIMILARITY * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = materialize(packed_sets(concerned(pairs, docs)).dropDuplicates(["doc_id"]), "packed")
    side = lambda end, n, x: sets.select(F.col("doc_id").alias(end), F.col("n").alias(n), F.col("packed").alias(x))
    both = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    return materialize(both.mapInArrow(rows, "a long, b long"), "near-pairs")


def tree_pairs(listed: DataFrame, nodes: DataFrame, linked: DataFrame, most: int | None) -> DataFrame:
    """Rows of the trees of all lists whose members are in more than one component, as ``tree_rows`` gives them."""
    placed = listed.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", F.col("doc_id")).alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("key", "members")
    rows = placed.join(split, "key")
    needed = nodes.select("doc_id", "n", "vector").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.join(needed, "doc_id")
    zero = F.lit(0)
    small = rows.where(F.col("members") <= CROWD).select("key", zero.alias("band"), zero.alias("i"), zero.alias("j"), "doc_id", "part", "n", zero.alias("block"), F.lit(True).alias("own"), "vector")
    # A member of a crowded list stands in its own band and, as one of the larger sets, in the one below.
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    crowded = rows.where(F.col("members") > CROWD).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band - F.col("step"))
    sizes = crowded.groupBy("key", "band").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("blocks"))
    crowded = crowded.join(sizes, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    crowded = crowded.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    crowded = crowded.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "part", "n", "block", (F.col("step") == 0).alias("own"), "vector")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["key", "band", "i", "j"]
    return small.unionByName(crowded).repartition(n, *group).sortWithinPartitions(*group).mapInArrow(lambda b: tree_rows(b, most), "a long, b long").distinct()


def may_link(n: str, m: str) -> Column:
    return (100 * F.col(n) >= SIMILARITY * F.col(m)) & (100 * F.col(m) >= SIMILARITY * F.col(n))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, over whole texts. Null, empty and blank texts have no shingle and
    link with nothing. Rows that repeat a doc_id are one node; a row without doc_id links with nothing and its component is
    null. Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    common = common_shingles(docs)
    sets = materialize(with_runs(set_rows(docs, common)), "sets")
    named = sets.where("doc_id IS NOT NULL AND n > 0")
    groups = materialize(tree_merge(named.select("doc_id", "n", "d1", "d2", "row", "run"), ["n", "d1", "d2"], F.bitwise_not("doc_id").alias("best")).select("doc_id", F.bitwise_not("best").alias("same")), "equal-sets")
    nodes = named.join(groups.where("doc_id = same").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nodes = materialize(nodes.select("doc_id", "n", "commons", "vector"), "nodes")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = rare_postings(docs, common).repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(repeated_lists, "key long, doc_id long")
    rare = rare.join(nodes.select("doc_id"), "doc_id", "left_semi").select("key", "doc_id").distinct()
    postings = materialize(rare.unionByName(nodes.select(F.explode("commons").alias("key"), "doc_id")), "postings")
    lists = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    listed = materialize(postings.join(lists, "key"), "lists")
    # Whose keys the most others share heads its lists: what copies were made of, rather than one of the copies.
    weight = listed.groupBy("doc_id").agg(F.sum("members").alias("weight")).join(nodes.select("doc_id", "n"), "doc_id")
    weighed = listed.join(weight, "doc_id")
    heads = weighed.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("doc_id").alias("not_id"), "n")).alias("head"))
    tries = weighed.select("key", "doc_id", "n").join(heads.select("key", F.bitwise_not("head.not_id").alias("head"), F.col("head.n").alias("head_n")), "key")
    tries = tries.where((F.col("doc_id") != F.col("head")) & may_link("n", "head_n")).select(F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b")).distinct()
    tried = materialize(bounded(tries, nodes), "tries")
    linked = components(verified(tried, docs))

    # Then the trees; a second round sees only lists that had more open pairs than they gave.
    open_lists = listed.select("key", "doc_id")
    for most in (OPEN_PAIRS, None):
        given = materialize(tree_pairs(open_lists, nodes, linked, most), "pairs")
        pairs = materialize(given.where("b IS NOT NULL").join(tried, ["a", "b"], "left_anti"), "new-pairs")
        if not pairs.isEmpty():
            links = linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(nearly(pairs, docs), docs))
            linked, tried = components(links), tried.unionByName(pairs)
        unfinished = given.where("b IS NULL").select(F.col("a").alias("key"))
        if unfinished.isEmpty():
            break
        open_lists = open_lists.join(unfinished, "key", "left_semi")

    final = groups.distinct().join(linked.withColumnRenamed("node", "same"), "same", "left").select("doc_id", F.coalesce("component", "same").alias("component_id"))
    # A doc_id whose rows hold different sets joins their components.
    twice = final.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    if not twice.isEmpty():
        joined = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(twice.select("a", "b")))
        final = groups.distinct().join(joined.withColumnRenamed("node", "same"), "same", "left").select("doc_id", F.coalesce("component", "same").alias("component_id"))
    final = final.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sets.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def pair_bounds(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """The bound of each pair of count vectors, worked out together for pairs of the same numbers of groups."""
    out = np.zeros(len(x), np.int64)
    bits = np.array([(v[0], w[0]) for v, w in zip(x, y, strict=True)], np.uint8).reshape(-1, 2)
    for kind in np.unique(bits, axis=0):
        at = np.flatnonzero((bits == kind).all(axis=1))
        for some in np.array_split(at, -(-len(at) // 4096)):
            ends = CountVectors([x[k] for k in some] + [y[k] for k in some])
            out[some] = ends.bound(np.arange(len(some)), np.arange(len(some)) + len(some))
    return out


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose count vectors allow a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            keep = (100 + SIMILARITY) * pair_bounds(batch.column(4).to_pylist(), batch.column(5).to_pylist()) >= SIMILARITY * (n + m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = nodes.select("doc_id", "n", "vector")
    both = pairs.join(ends.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va")), "a").join(ends.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb")), "b")
    return both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(rows, "a long, b long")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is their component's smallest, and those without doc_id."""
    gone = jaccard_join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_tm_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_tm_gone"), "left_anti")
