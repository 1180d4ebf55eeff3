"""Embedding near-dedup: a pivot-permutation index with exact verification.

A vector is described by its ``NEAREST`` nearest reference points (pivots), ordered. Vectors that are near each other order the
pivots alike. Inverted lists by label and pivot hold the vectors that have the pivot among their ``LEAD`` first; in a list, the
vectors' other pivots are joined to count how many two vectors share, those with ``SHARED`` or more are candidates, and a
candidate counts in the list of its first common lead pivot only. Then the cosine is verified in double precision.

The pivots are vectors of the table that are not near each other, about ``PIVOTS_BY_ROOT`` times the root of the number of
distinct vectors, so lists grow with the root of the table, and a dense group has one pivot of its own at most, or its members
would order many equally near pivots by chance. Equal vectors are one entry with a count.

A list is worked on in pairs of blocks of at most ``BLOCK`` entries, each pair of blocks a group of its own, so a crowded list
spreads over the cluster. A pair of blocks yields, for each entry, a count of links and one edge to the smallest vector it is
connected to: pairs are never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

COSINE = 0.93
PIVOTS_BY_ROOT = 4
FEWEST_PIVOTS = 64
PIVOT_BYTES = 32 << 20  # of the broadcast: a table beyond that has longer lists, and the same links
APART = 0.8  # cosine that two pivots stay below
NEAREST = 12
LEAD = 4
SHARED = 3
BLOCK = 1024
UNITS = "vec_id long, label string, unit binary"
INDEX = "gid long, rep long, size long, label string, dim int, unit binary, nearest binary, lists array<int>"
LINKS = "gid long, rep long, links long, low long"


def units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a usable vector and those vectors at length 1, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    rows, out = [], []
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        x = flat[(np.cumsum(size) - size)[at][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            top = np.abs(x).max(axis=1, keepdims=True)
            x = x / top  # so that squares neither overflow nor vanish
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        good = np.isfinite(x).all(axis=1) & np.isfinite(top[:, 0])
        rows.append(at[good])
        out += list(x[good] + 0.0)  # no negative zeros
    order = np.argsort(np.concatenate([np.zeros(0, np.int64), *rows]), kind="stable")
    return np.concatenate([np.zeros(0, np.int64), *rows])[order], [out[k] for k in order]


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, unit = units(batch.column(2))
        kept = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([v.tobytes() for v in unit], pa.binary())], names=["vec_id", "label", "unit"])


def matrix(column: pa.Array | list[bytes]) -> np.ndarray:
    """Vectors of one dimension as rows."""
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values)).reshape(len(values), -1) if values else np.zeros((0, 0))


def choose_pivots(groups: DataFrame, distinct: int) -> np.ndarray:
    """Vectors of the commonest dimension among a bounded sample, in the order of a hash, that are not near an earlier one."""
    dims = groups.groupBy(F.octet_length("unit").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bytes").first()
    if dims is None:
        return np.zeros((0, 0))
    most = max(FEWEST_PIVOTS, min(math.ceil(PIVOTS_BY_ROOT * math.sqrt(distinct)), PIVOT_BYTES // dims["bytes"]))
    order = F.xxhash64("rep", "label", F.lit("pivot"))
    drawn = matrix([bytes(r["unit"]) for r in groups.where(F.octet_length("unit") == dims["bytes"]).orderBy(order, "rep", "gid").limit(2 * most).select("unit").collect()])
    chosen, n = np.zeros((most, drawn.shape[1])), 0
    for v in drawn:
        if n < most and (chosen[:n] @ v < APART).all():
            chosen[n] = v
            n += 1
    return chosen[:n]


def describe(groups: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Entries with their nearest pivots, in order, and the lists to stand in.

    Vectors of another dimension than the pivots' stand in one list of their own dimension, as all do with too few pivots.
    """
    shared = groups.sparkSession.sparkContext.broadcast(pivots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for batch in batches:
            sizes = np.array([len(v) // 8 for v in batch.column(4).to_pylist()], np.int32)
            nearest, lists = [b""] * batch.num_rows, [[-1]] * batch.num_rows
            at = np.flatnonzero(sizes == points.shape[1]) if len(points) > NEAREST else np.zeros(0, np.int64)
            for part in np.array_split(at, -(-len(at) // 1024)) if len(at) else ():
                likeness = matrix(batch.column(4).take(pa.array(part))) @ points.T
                near = np.argpartition(-likeness, NEAREST, axis=1)[:, :NEAREST]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)
                for k, own in zip(part, near, strict=True):
                    nearest[k], lists[k] = own.tobytes(), own[:LEAD].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes), batch.column(4), pa.array(nearest, pa.binary()), pa.array(lists, pa.list_(pa.int32()))], names=[f.split()[0] for f in INDEX.split(", ")])

    return groups.select("gid", "rep", "size", "label", "unit").mapInArrow(rows, INDEX)


def lowest_connected(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a square link matrix the smallest id connected to it."""
    low = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        near = np.where(links, low[None, :], big).min(axis=1, initial=big)
        new = np.minimum(low, near)
        if (new == low).all():
            return low
        low = new


def shared_counts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many pivots the rows of p and those of q have in common, found by joining their inverted lists."""
    counts = np.zeros(len(p) * len(q), np.int64)
    left, right = np.argsort(p.ravel(), kind="stable"), np.argsort(q.ravel(), kind="stable")
    keys, begin, size = np.unique(p.ravel()[left], return_index=True, return_counts=True)
    first, last = np.searchsorted(q.ravel()[right], keys), np.searchsorted(q.ravel()[right], keys, side="right")
    if (size * (last - first)).sum() > 4 * len(counts):  # most share most: one product is less work than the join
        columns = np.zeros(int(max(p.max(), q.max())) + 1, np.int64)
        columns[keys] = np.arange(len(keys))
        marks = [np.zeros((len(x), len(keys)), np.float32) for x in (p, q)]
        for m, x in zip(marks, (p, q), strict=True):
            known = np.isin(x, keys)
            m[np.nonzero(known)[0], columns[x[known]]] = 1
        return (marks[0] @ marks[1].T).astype(np.int64)
    for at, n, a, b in zip(begin, size, first, last, strict=True):
        if b > a:
            rows, others = left[at : at + n] // p.shape[1], right[a:b] // q.shape[1]
            counts[(rows[:, None] * len(q) + others).ravel()] += 1
    return counts.reshape(len(p), len(q))


def candidates(pivot: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which rows of p and q share enough pivots, and no lead pivot before this list's."""
    near = shared_counts(p, q) >= SHARED
    a, b = np.nonzero(near)
    for k in range(0, len(a), 1 << 18):
        x, y = p[a[k : k + (1 << 18)], :LEAD], q[b[k : k + (1 << 18)], :LEAD]
        before = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] < pivot)).any(axis=(1, 2))
        near[a[k : k + (1 << 18)][before], b[k : k + (1 << 18)][before]] = False
    return near


def block_links(pivot: int, left: tuple, right: tuple | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(gid, rep, links, low) of a pair of blocks, or of one block with itself; links of each pair once for either end.

    A block is (gid, rep, size, unit vectors, nearest pivots).
    """
    same = right is None
    (ids, reps, m, x, p), (jds, others, n, y, q) = left, left if same else right
    if not len(ids) or not len(jds):
        return
    near = candidates(pivot, p, q) if pivot >= 0 else np.ones((len(ids), len(jds)), bool)
    near &= ids[:, None] != jds[None, :]
    a, b = np.nonzero(near)
    if len(a) * 4 < near.size:
        good = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], y[b[k : k + 65536]]) >= COSINE for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
        near[a[~good], b[~good]] = False
    else:
        near &= x @ y.T >= COSINE
    h = near.any(axis=1)
    if same:
        yield ids[h], reps[h], near[h] @ n, lowest_connected(near[np.ix_(h, h)], reps[h])
        return
    g = near.any(axis=0)
    inner = near[np.ix_(h, g)]
    both = np.zeros((h.sum() + g.sum(),) * 2, bool)
    both[: h.sum(), h.sum() :] = inner
    both[h.sum() :, : h.sum()] = inner.T
    every = np.concatenate([reps[h], others[g]])
    yield np.concatenate([ids[h], jds[g]]), every, np.concatenate([near[h] @ n, m @ near[:, g]]), lowest_connected(both, every)


def link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, dim, pivot, i, j), each with its own block."""

    def unpack(rows: pa.Table, block: int) -> tuple:
        t = rows.filter(pa.compute.equal(rows["block"], block)).combine_chunks()
        packed = b"".join(t["nearest"].to_pylist())
        nearest = np.frombuffer(packed, np.int32).reshape(len(t), -1) if packed else np.zeros((len(t), 0), np.int32)
        return t["gid"].to_numpy(), t["rep"].to_numpy(), t["size"].to_numpy(), matrix(t["unit"]), nearest

    def flush(group: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        _, _, pivot, i, j = group
        for found in block_links(pivot, unpack(rows, i), None if i == j else unpack(rows, j)):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=["gid", "rep", "links", "low"])

    held, group = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        at = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                if held and group != keys[at]:
                    yield from flush(group, held)
                    held = []
                group = keys[at]
                held.append(batch.slice(at, k - at))
                at = k
    if held:
        yield from flush(group, held)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows with equal labels, of whatever type, link when their cosine is ``COSINE`` or more, in double precision. Null labels, null,
    empty or zero vectors, and vectors with null or non-finite components link with nothing, nor do vectors of different lengths or a
    row without vec_id. Rows that repeat a vec_id with the same vector never link with each other, count one by one as the others'
    partners, and share the sum of their counts and the component; with another vector they are rows like any others. The
    links found are exact; those missed are pairs with no common lead pivot or fewer than ``SHARED`` nearest pivots in common (recall
    is measured in the tests). Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["label"].dataType.typeName()
    label = F.col("label") + 0.0 if kind in ("float", "double") else F.col("label")  # one zero
    own = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    vector = ["label", "unit"]
    by_id = own.mapInArrow(unit_rows, UNITS).groupBy(*vector, "vec_id").agg(F.count("*").alias("times"))
    by_id = materialize(by_id, "unit-vectors")
    groups = materialize(by_id.groupBy(*vector).agg(F.min("vec_id").alias("rep"), F.sum("times").alias("size")).withColumn("gid", F.monotonically_increasing_id()), "vector-groups")
    index = materialize(describe(groups, choose_pivots(groups, groups.count())), "pivot-index").select("*", F.explode("lists").alias("pivot")).drop("lists")
    key = ["label", "dim", "pivot"]
    sizes = index.groupBy(*key).agg(F.count("*").alias("entries")).where("entries > 1").withColumn("blocks", F.ceil(F.col("entries") / BLOCK).cast("int"))
    listed = index.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    placed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*key, "i", "j"]
    placed = placed.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "gid", "rep", "size", "unit", "nearest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = materialize(placed.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(link_rows, LINKS), "vector-links")
    others = links.groupBy("gid").agg(F.sum("links").alias("links"))
    members = materialize(by_id.join(groups, vector).select("vec_id", "times", "rep", "size", "gid"), "vector-members")
    linked = members.join(others, "gid", "left").withColumn("links", F.col("times") * (F.col("size") - F.col("times") + F.coalesce("links", F.lit(0))))
    counts = linked.groupBy("vec_id").agg(F.sum("links").alias("links"))
    edges = links.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionByName(members.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    whole = components(edges)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left").join(whole.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
