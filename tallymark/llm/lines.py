"""Line dedup: exact copies and lines within one edit, by a deletion-neighbourhood join.

Lines are compared without white space at their ends. Equal lines are one, kept where it occurs first. Two lines within one edit
(a character replaced, put in or taken out) share a variant: with one character deleted at the same place, or one deleted
against the other whole. Every variant of a line is emitted as a hashed key; a key's lines with the same place deleted are
all within one edit of each other, so each key needs the earliest of its lines only, and no pairs of a group are formed. The
edit distance to that line is then verified on the texts.

A long line has as many variants as characters. Before, lines are dropped that cannot have a partner: of two lines of l and l or
l + 1 characters within one edit the first l // 2 or the last l // 2 characters are equal, so a line takes part only if another
distinct line has one of its four halves (both ends, for l its own length and one less). Of those left, the same is asked of the
line cut into ``SEGMENTS`` parts: some other one must equal it before and behind one part, and only characters of such parts are
deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, powers, range_hashes, text_slices

#: Where no other least length is asked for: in shorter lines one edit changes a good part of what they say.
LEAST_CHARS = 8
SEGMENTS = 16
BODY_BYTES = 1 << 18  # of line text that is cut into segments at once; a longer line alone
BLANKS = " \t\n\x0b\x0c\r"
LINES = "doc_id long, line int, chars int, h1 long, h2 long, halves array<long>"
VARIANTS = "h1 long, h2 long, v1 long, v2 long, place int"
TEXTS = "doc_id long, line int, h1 long, h2 long, body string"
RESULT = "doc_id long, n_lines long, n_removed long, kept_sha256 string"


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def digest(body: str) -> tuple[int, int]:
    d = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def half_hashes(body: str) -> list[int]:
    """Hashes of the halves that a line shares with a partner, tagged with side and reference length."""
    out = []
    for length in (len(body), len(body) - 1):
        m = length // 2
        for side, part in enumerate((body[:m], body[-m:])):
            d = hashlib.blake2b(f"{side} {length} {part}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out.append(int.from_bytes(d, "big", signed=True))
    return out


def line_rows(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    names = [f.split()[0] for f in LINES.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            doc_id = doc_id.as_py()
            for k, line in enumerate(lines_of(text.as_py())):
                if body := line.strip(BLANKS):
                    rows.append((doc_id, k, len(body), *digest(body), half_hashes(body) if len(body) >= least_chars else []))
            if len(rows) > 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, wanted lines -> their bodies."""
    for batch in batches:
        rows = []
        for doc_id, text, wanted in zip(*(batch.column(k) for k in range(3)), strict=True):
            doc_id, lines = doc_id.as_py(), lines_of(text.as_py())
            rows += [(doc_id, w["line"], w["h1"], w["h2"], lines[w["line"]].strip(BLANKS)) for w in wanted.as_py()]
        if rows:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in TEXTS.split(", ")])


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, h2, body -> a key for each of SEGMENTS segments: what stands before and behind it, for both reference lengths.

    The segment's number is its place plus SEGMENTS for the second length.
    """
    for batch in batches:
        for at, stop, _, _ in text_slices(batch.column(2), BODY_BYTES):
            part = batch.slice(at, stop - at)
            bodies = part.column(2).to_pylist()
            codes = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.array([len(b) for b in bodies])
            begin = np.cumsum(size) - size
            length = np.stack([size, size - 1], axis=1)
            cuts = length[:, :, None] * np.arange(SEGMENTS + 1) // SEGMENTS
            start = np.broadcast_to(begin[:, None, None], cuts.shape)[:, :, 1:]
            end = np.broadcast_to((begin + size)[:, None, None], cuts.shape)[:, :, 1:]
            before = range_hashes(codes, start.ravel(), (start + cuts[:, :, :-1]).ravel())
            behind = range_hashes(codes, (end - length[:, :, None] + cuts[:, :, 1:]).ravel(), end.ravel(), 1)
            tag = (length[:, :, None] * SEGMENTS + np.arange(SEGMENTS)).astype(np.uint64).ravel()
            keys = mix(before ^ mix(behind ^ mix(tag))).view(np.int64)
            owner = pa.array(np.repeat(np.arange(len(bodies)), 2 * SEGMENTS))
            number = pa.array(np.tile(np.arange(2 * SEGMENTS, dtype=np.int32), len(bodies)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(keys), number], names=["h1", "h2", "key", "segment"])


def places(length: int, segments: list[int]) -> np.ndarray:
    """The characters of a line in the segments where it may differ from another."""
    inside = np.zeros(length, bool)
    for s in segments:
        reference, j = length - s // SEGMENTS, s % SEGMENTS
        inside[reference * j // SEGMENTS : length - reference + reference * (j + 1) // SEGMENTS] = True
    return np.flatnonzero(inside)


def variant_hashes(body: str) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the body and of each of its variants: the whole first, then without character 0, 1, .."""
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = []
    for which in (0, 1):
        rise = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(len(codes), which))])
        step_back = powers(2, which, inverse=True)[1]
        raw = np.concatenate([rise[-1:], rise[:-1] + (rise[-1] - rise[1:]) * step_back])
        size = np.full(len(raw), len(codes) - 1, np.uint64)
        size[0] += np.uint64(1)
        out.append(range_hashes(raw ^ (size << np.uint64(44)), np.arange(len(raw)), np.arange(1, len(raw) + 1), which))
    return out[0].view(np.int64), out[1].view(np.int64)


def variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, h2, body, segments -> the body itself (place -1) and its variants without one character of those segments."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=[f.split()[0] for f in VARIANTS.split(", ")])

    for batch in batches:
        held, size = [], 0
        for h1, h2, body, segments in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            v1, v2 = variant_hashes(body)
            at = np.concatenate([[-1], places(len(body), segments)])
            held.append((np.full(len(at), h1), np.full(len(at), h2), v1[at + 1], v2[at + 1], at.astype(np.int32)))
            size += len(at)
            if size > 50_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, gone in zip(*(batch.column(k) for k in range(3)), strict=True):
            lines, gone = lines_of(text.as_py()), set(gone.as_py() or ())
            kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            rows.append((doc_id.as_py(), len(lines), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, line) of the lines that an earlier line equals or is within one edit of. ``docs`` has no null doc_id or text."""
    every = materialize(docs.mapInArrow(lambda b: line_rows(b, least_chars), LINES), "lines")
    key = ["h1", "h2"]
    firsts = every.groupBy(*key).agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("copies"), F.max("chars").alias("chars"), F.max("halves").alias("halves"))
    firsts = materialize(firsts, "first-lines")
    copies = every.join(firsts.where("copies > 1").select(*key, "first"), key).where(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line")

    halves = firsts.where(F.col("chars") >= least_chars).select(*key, "first", F.explode("halves").alias("half"))
    # A line's own two lengths never give one half twice, so a half that counts twice belongs to two lines.
    shared = materialize(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "halves")
    near = halves.join(shared, "half", "left_semi").select(*key, "first").distinct()
    wanted = near.groupBy("first.doc_id").agg(F.collect_list(F.struct(F.col("first.line").alias("line"), *key)).alias("wanted"))
    bodies = materialize(docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(text_rows, TEXTS), "bodies")

    # Of those only lines that another one equals but for a short segment can be within one edit of it.
    ends = materialize(bodies.select(*key, "body").mapInArrow(segment_rows, "h1 long, h2 long, key long, segment int"), "segments")
    alike = ends.groupBy("key").agg(F.count_distinct(*key).alias("n")).where("n > 1").select("key")
    near = ends.join(alike, "key", "left_semi").groupBy(*key).agg(F.collect_set("segment").alias("segments"))  # at most 2 * SEGMENTS
    bodies = materialize(bodies.join(near, key), "close-bodies")

    order = bodies.select(*key, F.struct("doc_id", "line").alias("first"))
    variants = bodies.select(*key, "body", "segments").mapInArrow(variant_rows, VARIANTS).join(order, key)
    variants = materialize(variants, "variants")
    variant = ["v1", "v2"]
    replaced = variants.where("place >= 0").groupBy(*variant, "place").agg(F.min(F.struct("first", *key)).alias("best"), F.count("*").alias("n")).where("n > 1")
    one = variants.where("place >= 0").join(replaced, [*variant, "place"])
    whole = variants.where("place < 0")
    taken_out = variants.where("place >= 0").join(whole.select(*variant), variant, "left_semi").groupBy(*variant).agg(F.min(F.struct("first", *key)).alias("best"))
    shorter = whole.join(taken_out, variant)  # the line with a character less looks at the earliest longer one
    longer = variants.where("place >= 0").join(whole.select(*variant, F.struct("first", *key).alias("best")), variant)
    tries = one.select(*key, "first", "best").unionByName(shorter.select(*key, "first", "best")).unionByName(longer.select(*key, "first", "best"))
    tries = tries.where(F.col("best.first") < F.col("first")).groupBy(*key, "first").agg(F.min("best").alias("best"))
    other = bodies.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("body").alias("other"))
    pairs = tries.select(*key, "first", F.col("best.h1").alias("o1"), F.col("best.h2").alias("o2")).join(bodies.select(*key, "body"), key).join(other, ["o1", "o2"])
    close = pairs.where(F.levenshtein("body", "other", 1).between(0, 1)).select("first.doc_id", "first.line")
    return copies.unionByName(close).distinct()


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by line feeds).

    Lines are separated by line feeds; blank lines stay. A line goes if an earlier one (smaller doc_id, or earlier in its document)
    is equal, white space at the ends aside, or within one edit of it, both of ``least_chars`` characters or more (1: all lines); whether
    that one stays itself does not matter. Null and empty texts have no lines. Rows that repeat a doc_id and text are one
    document with equal results; a row without doc_id takes no part and keeps all. Whole texts; columns other than doc_id and
    text are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    gone = repeated_lines(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), least_chars).groupBy("doc_id").agg(F.collect_list("line").alias("gone"))
    return rows.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(kept_rows, RESULT)
