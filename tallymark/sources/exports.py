"""Export documents of any size, read in splits: a file is one JSON document, but no task holds more than a row of it.

Spark's text reader cuts a file at every closing brace, so that files are read in splits by many tasks. What stands between two braces is a
piece. A task reads a split's pieces in their order, so whether a piece begins inside a string, how deep it lies and in which section are told
along the way, and the pieces of one row are put together where they are read: texts are not shuffled. A split that is not its file's first
starts from what the splits before it end with, one row a split; only rows that a split cuts are joined over splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ANCHOR, EXPORT_ROW, PAGE

SECTIONS = ("logs", "ledger")  # the first present wins
ESCAPED, QUOTED = re.compile(r"\\.", re.S), re.compile(r'"[^"]*(?:"|\Z)')
#: A key whose value is an array, a string (cut off at the end of a piece, perhaps), or a bracket.
TOKEN = re.compile(r'("[^"]*")\s*:\s*\[|"[^"]*(?:"|\Z)|[\[\]{]', re.A)


def _section(plain: str, depth: int) -> tuple[str | None, int] | None:
    """The array that a piece ends in, as far as the piece says: the key and depth of one that it opened, depth -1 where it closed one, else None."""
    name, at = None, None
    for m in TOKEN.finditer(plain):
        if m[1]:
            if depth <= 2:
                name, at = m[1][1:-1], depth
            depth += 1
        elif m[0] == "]":
            depth -= 1
            if depth <= 2 and (at is None or depth <= at):
                name, at = None, -1
        elif m[0] in "[{":
            depth += 1
    return None if at is None else (name, at)


FOUND = "file string, split long, unit long, whole boolean, ended boolean, section string, opened string, text string, delta long, own struct<name: string, at: long>"


def _found(file: str, split: int, unit: int, whole: bool, ended: bool, section: str | None, opened: str | None, pieces: list[str], delta: int, own: tuple | None) -> dict:
    return {"file": file, "split": split, "unit": unit, "whole": whole, "ended": ended, "section": section, "opened": opened, "text": "}".join(pieces) + "}", "delta": delta, "own": own and {"name": own[0], "at": own[1]}}


def scanner(states: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of pieces (file, split, alone, inside, depth, own, value), in their order, as units; with ``states`` one row a split that says how deep it goes and what section it ends in.

    A unit is ``whole`` where it neither may go on from a split before nor goes on in a split behind.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, []
        for b in batches:
            for file, split, alone, inside0, depth0, own0, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, split) != current:
                    if current is not None and (pieces or states):
                        out.append(_found(*current, unit, last and unit + first > 0, False, section, opened, pieces, depth - begun, own))
                    if inside0 is None:
                        raise ValueError(f"split {split} of {file} is not cut as it was when its start was looked for")
                    current, last, first = (file, split), alone, split == 0
                    inside, depth, begun, own = inside0, depth0, depth0, own0 and (own0["name"], own0["at"])
                    unit, pieces, section, opened = 0, [], None, None
                plain = ESCAPED.sub("", value) if "\\" in value else value
                if inside:
                    plain = '"' + plain
                ends = plain.count('"') % 2 == 0
                bare = QUOTED.sub("", plain)
                if depth <= 3 and ("[" in plain or "]" in plain) and (found := _section(plain, depth)):
                    own, opened = found, opened if found[0] is None else found[0]
                depth += bare.count("{") + bare.count("[") - bare.count("]") - ends
                inside = not ends
                if states:
                    continue
                at = own[1] if own else -1
                within = at >= 0 and depth > at
                section = own[0] if within else None
                pieces.append(value)
                if ends and depth <= (at + 1 if within else 1):
                    out.append(_found(*current, unit, first or unit > 0, True, section, opened, pieces, 0, None))
                    unit, pieces, section, opened = unit + 1, [], None, None
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if current is not None and (pieces or states):
            yield pa.RecordBatch.from_pylist([_found(*current, unit, last and unit + first > 0, False, section, opened, pieces, depth - begun, own)], schema)

    return scan


def _scanned(pieces: DataFrame, starts: DataFrame | None, states: bool = False) -> DataFrame:
    """Units of pieces, or states of splits, each split from its start; a file's first starts outside of all."""
    first = F.col("split") == 0
    rows = pieces
    if starts is not None:
        rows = pieces.join(F.broadcast(starts), ["file", "split"], "left")  # one row a split of files with several
    else:
        rows = pieces.withColumns({"inside": F.lit(None).cast("boolean"), "depth": F.lit(None).cast("long"), "own": F.lit(None).cast("struct<name: string, at: long>")})
    rows = rows.select("file", "split", "alone", F.when(first, F.lit(False)).otherwise(F.col("inside")).alias("inside"), F.when(first, F.lit(0)).otherwise(F.coalesce("depth", F.lit(0))).cast("long").alias("depth"), F.when(~first, F.col("own")).alias("own"), "value")
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("unit", pa.int64()), ("whole", pa.bool_()), ("ended", pa.bool_()), ("section", pa.string()), ("opened", pa.string()), ("text", pa.string()), ("delta", pa.int64()), ("own", pa.struct([("name", pa.string()), ("at", pa.int64())]))])
    return rows.mapInArrow(scanner(states, schema), FOUND)


def _starts(pieces: DataFrame) -> DataFrame:
    """file, split, inside, depth, own: how each split of a file with several begins. Each of the three is told by what the splits before end with."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    starts = pieces.groupBy("file", "split").agg(F.sum(quotes).alias("n"))
    nothing = F.lit(None).cast("struct<name: string, at: long>")
    starts = starts.select("file", "split", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2 == 1).alias("inside"), F.lit(0).cast("long").alias("depth"), nothing.alias("own"))
    ends = _scanned(pieces, starts, True)
    depths = ends.select("file", "split", F.coalesce(F.sum("delta").over(earlier), F.lit(0)).alias("depth"))
    starts = starts.drop("depth").join(depths, ["file", "split"])
    ends = _scanned(pieces, starts, True)
    sections = ends.select("file", "split", F.last("own", True).over(earlier).alias("own"))
    return starts.drop("own").join(sections, ["file", "split"])


def export_units(spark: SparkSession, *paths: str) -> DataFrame:
    """file, unit (its place), section, row, between: each row of a section, and what stands between the sections."""
    raw = spark.read.option("lineSep", "}").text(list(paths))
    alone = F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), alone.alias("alone"), "value")
    cut = pieces.where("NOT alone")
    starts = _starts(cut)
    whole = _scanned(pieces, starts).where("whole").select("file", "split", "unit", "section", "opened", "text")
    # rows that a split cuts: where they go on is told by how many pieces of this kind ended before, two a split at most
    before = Window.partitionBy("file").orderBy("split", "unit").rowsBetween(Window.unboundedPreceding, -1)
    parts = _scanned(cut, starts).where("NOT whole").withColumn("row", F.coalesce(F.sum(F.col("ended").cast("int")).over(before), F.lit(0)))
    place = F.struct("split", "unit")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "unit", "text"))), lambda p: p["text"]), "")
    joined = parts.groupBy("file", "row").agg(F.min(place).alias("at"), F.max_by("section", place).alias("section"), F.max_by("opened", F.when(F.col("opened").isNotNull(), place)).alias("opened"), text.alias("text"))
    units = whole.unionByName(joined.select("file", "at.split", "at.unit", "section", "opened", "text"))
    head = F.regexp_extract("text", r'(?s)^(.*?"(?:logs|ledger)"\s*:\s*\[)', 1)
    own = F.when(F.col("opened").isin(*SECTIONS), F.substring(F.col("text"), F.length(head) + 1, F.length("text"))).otherwise(F.regexp_replace("text", r"^\s*,?\s*", ""))
    return units.select("file", F.struct("split", "unit").alias("unit"), "section", F.when(F.col("section").isin(*SECTIONS), own).alias("row"), F.when(~F.coalesce(F.col("section").isin(*SECTIONS), F.lit(False)), F.col("text")).otherwise(head).alias("between"))


def export_headers(units: DataFrame) -> DataFrame:
    """file, org_id, page, anchor: what a document says beside its rows, wherever it stands in it."""
    block = lambda name, kind: F.from_json(F.nullif(F.regexp_extract("between", rf'(?s)"{name}"\s*:\s*(\{{.*)$', 1), F.lit("")), kind)
    org = F.regexp_extract("between", r'"org_id"\s*:\s*("(?:[^"\\]|\\.)*"|[0-9]+)', 1)
    org = F.from_json(F.when(org != "", F.concat(F.lit('{"v":'), org, F.lit("}"))), "v string")["v"]
    said = units.where("between <> ''").select("file", org.alias("org_id"), block("page", PAGE).alias("page"), block("anchor", ANCHOR).alias("anchor"))
    return said.groupBy("file").agg(F.first("org_id", True).alias("org_id"), F.first("page", True).alias("page"), F.first("anchor", True).alias("anchor"))


def export_rows(units: DataFrame, headers: DataFrame) -> DataFrame:
    """file, org_id and the rows of all files, whatever the files' order. Of a file's sections the first present wins."""
    rows = units.where("row IS NOT NULL").withColumn("rank", F.when(F.col("section") == "logs", 0).otherwise(1))
    best = rows.groupBy("file").agg(F.min("rank").alias("rank")).join(headers.select("file", "org_id"), "file", "left")
    parsed = rows.join(F.broadcast(best), ["file", "rank"])  # one row a file: rows stay where they are
    return parsed.select("file", "org_id", F.from_json("row", EXPORT_ROW).alias("r")).select("file", "org_id", "r.*")


def page_summaries(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """What verification needs of each file: its statement, and its first and last row."""
    ends = rows.groupBy("file").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("chain_hash", "seq").alias("last_hash"), F.min_by("prev_hash", "seq").alias("first_prev"))
    return headers.join(ends, "file")
