"""WARC: a deterministic sharded writer and its reader.

Records are range-sorted by page_id into shards of about equal bytes; a task writes one shard, rolling to the next
file at a compressed size. Headers and digests are made anew from the payload. A file appears under its final name
only when complete (temporary name, then rename), its bytes depend on the pages alone, and only files named in the
manifest count, which is written when all are there. A task that runs twice or dies leaves nothing that is read.

A payload that occurs again is stored once: the record with the smallest page_id is the response, others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices

MANIFEST = "file string, records long, file_bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
MOST_SHARDS = 100_000  # bounds of shards that are broadcast
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow knows; a bare ``file:/path``, as Hadoop writes it, too."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header_value(text: str) -> str:
    """A header field cannot hold control characters: they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    target = header_value(url) if url else f"urn:page:{page_id}"
    head = HTTP_HEAD % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Target-URI", target),
        ("WARC-Date", DATE),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {base32(digest)} {target}')}>"),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.insert(1, ("X-Page-Id", str(page_id)))
    if url is not None:
        fields.insert(1, ("X-Page-Url", header_value(url)))
    if refers_to is not None:
        fields[1:1] = [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ShardFile:
    """A file of a shard: written under a temporary name, renamed when closed."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, part: int):
        self.store, self.name = store, f"part-{shard:06d}-{part:04d}.warc.gz"
        self.final, self.temporary = f"{folder}/{self.name}", f"{folder}/_{self.name}.{uuid.uuid4().hex}"
        self.out, self.size, self.records, self.hash, self.ids = store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256(), []

    def add(self, member: bytes, page_id: int | None) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1
        self.ids = [self.ids[0] if self.ids else page_id, page_id]

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.store.move(self.temporary, self.final)
        row = (self.name, self.records, self.size, self.hash.hexdigest(), *self.ids)
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["file", "records", "file_bytes", "sha256", "first_id", "last_id"])


def write_shards(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, page_id, digest, with the notes on revisits before the pages they belong to.

    A page that was dealt out over shards is known in each by a note or, without an id, needs none.
    """
    store, path = file_system(folder)
    current: ShardFile | None = None
    shard = part = -1
    last, owner = None, None  # page_id and digest of the latest row; the page that holds its payload
    for batch in batches:
        for row in (r for a, b, _, _ in text_slices(batch["html"]) for r in batch.slice(a, b - a).to_pylist()):
            if row["shard"] != shard:
                if current:
                    yield current.close()
                current, shard, part = None, row["shard"], 0
            key = row["page_id"], row["digest"]
            if row["kind"]:
                last, owner = key, row["refers_to"]
                continue
            if last != key:
                last, owner = key, None
            payload, member, member_owner = (row["html"] or "").encode(), b"", -1
            for _ in range(row["copies"]):
                if current is None:
                    current = ShardFile(store, path, shard, part)
                if not member or member_owner != owner:
                    member, member_owner = gzip_member(record(row["page_id"], row["url"], payload, row["digest"], owner), level), owner
                current.add(member, row["page_id"])
                if owner is None and row["page_id"] is not None and len(payload) >= row["least"]:
                    owner = row["page_id"]  # a repeated row revisits the first
                if current.size >= roll_bytes:
                    yield current.close()
                    current, part = None, part + 1
    if current:
        yield current.close()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = 16 << 20, roll_bytes: int = 16 << 20, level: int = 6) -> DataFrame:
    """Write (page_id, url, html) as WARC files into ``folder`` and return the manifest, one row per file.

    A null html is an empty payload. Of equal payloads of ``least_bytes`` or more the smallest page_id's is the
    response. A row that repeats a page_id and its payload revisits the first; rows without a page_id are responses
    unless a page with an id holds the same payload. No page gives no file. Other columns are not written.
    The payloads are shuffled once, to their shards; digests and notes are small. Rows of one page and payload are spread over
    shards by their urls, and equal rows that would fill a shard by themselves travel once for each chunk of them.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("size"), url_hash(F.col("url")).alias("uh"))
    index = materialize(keyed.groupBy("page_id", "digest", "size", "uh").agg(F.count("*").alias("n")), "warc-index")
    width = shard_width(index, shard_bytes)
    hot = index.where((F.col("n") > 1) & (F.col("n") * F.col("size") > width))
    bounds = shard_bounds(index, width)
    owners = index.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.sum("n").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    notes = index.join(owners.drop("n"), ["digest", "size"]).groupBy("page_id", "digest", "refers_to").agg(F.sum("n").alias("n"), F.min("uh").alias("uh"))  # where its first record is
    own = F.col("page_id").eqNullSafe(F.col("refers_to"))
    notes = notes.withColumn("kind", F.when(~own, OTHERS).when(F.col("n") > 1, SAME)).where("kind IS NOT NULL").drop("n")
    records = keyed.withColumns({"chunk": F.lit(0), "copies": F.lit(1).cast("long")})
    if not hot.isEmpty():  # each holds a shard's bytes by itself: there are no more of them than shards
        same = [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in ("page_id", "digest", "uh")]
        keys = F.broadcast(hot.select(*[F.col(c).alias(f"hot_{c}") for c in ("page_id", "digest", "uh")]))
        equal = keyed.join(keys, same, "left_semi").groupBy("page_id", "url", "digest", "size", "uh").agg(F.first("html").alias("html"), F.count("*").alias("n"))
        records = records.join(keys, same, "left_anti").unionByName(in_chunks(equal, width))
    rows = notes.unionByName(records.drop("size").withColumn("kind", F.lit(0)), allowMissingColumns=True)
    rows = with_shard(rows.select(F.lit(0).alias("shard"), "page_id", "digest", F.coalesce("uh", F.lit(b"")).alias("uh"), F.coalesce("chunk", F.lit(0)).alias("chunk"), "kind", "refers_to", "url", "html", "copies", F.lit(least_bytes).alias("least")), bounds)
    sorted_rows = rows.repartitionById(len(bounds), F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.desc("kind"), "uh", "url", "chunk")
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    return materialize(sorted_rows.mapInArrow(lambda b: write_shards(b, folder, roll_bytes, level), MANIFEST), "warc-manifest")


OTHERS, SAME = 1, 2  # notes: a page's payload is another page's; a page's payload is in its own first record


def url_hash(url: Column) -> Column:
    """Eight bytes in whose order the rows of one page and payload are dealt out."""
    return F.substring(F.unhex(F.sha1(F.coalesce(url, F.lit("")))), 1, 8)


def in_chunks(equal: DataFrame, width: int) -> DataFrame:
    """Rows that stand for ``n`` equal ones as chunks of about ``width`` bytes: each travels once and is written ``copies`` times."""
    chunks = F.greatest(F.ceil(F.col("n") * F.col("size") / F.lit(width)), F.lit(1))
    rows = equal.withColumn("each", F.ceil(F.col("n") / chunks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)))
    rows = rows.withColumn("copies", F.least(F.col("each"), F.col("n") - F.col("chunk") * F.col("each")).cast("long"))
    return rows.where("copies > 0").drop("n", "each")


def sort_keys(page_ids: pa.Array, digests: pa.Array, url_hashes: list[bytes], chunks: np.ndarray) -> np.ndarray:
    """Bytes that order as (page_id, digest, url hash, chunk) does, null ids first."""
    known = page_ids.is_valid().to_numpy(zero_copy_only=False)
    ids = page_ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    keys = np.zeros((len(ids), 41), np.uint8)
    keys[:, 0] = known
    keys[:, 1:9] = np.where(known, ids, 0).astype(">u8").view(np.uint8).reshape(-1, 8)
    keys[:, 9:29] = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 20)
    keys[:, 29:37] = np.frombuffer(b"".join(h.ljust(8, b"\0") for h in url_hashes), np.uint8).reshape(-1, 8)
    keys[:, 37:] = chunks.astype(">u4").view(np.uint8).reshape(-1, 4)
    return keys.view("S41").ravel()


def shard_width(index: DataFrame, shard_bytes: int) -> int:
    """Bytes of a shard; over ``MOST_SHARDS`` of them they are larger."""
    total = index.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    return max(shard_bytes, -(-total // MOST_SHARDS), 1)


def shard_bounds(index: DataFrame, width: int) -> np.ndarray:
    """The sort key at which each shard begins: where the running total of bytes, over all pages in order, passes a multiple.

    The total is summed by ranges of pages side by side and then over the ranges, one row each, so the bounds depend on the
    pages alone, however ids are spread and rows repeat. There is one bound a shard.
    """
    order = ["page_id", "digest", "uh", "chunk"]
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = in_chunks(index, width).withColumn("size", F.col("size") * F.col("copies"))
    ranged = materialize(units.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "warc-ranges")
    before = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).withColumn("bytes", F.sum("bytes").over(Window.orderBy("range")) - F.col("bytes"))
    running = F.sum("size").over(Window.partitionBy("range").orderBy(*order)) - F.col("size") + F.col("bytes")
    placed = ranged.join(before, "range").withColumn("shard", F.floor(running / F.lit(width)))
    first = F.min(F.struct(F.col("page_id").isNotNull().alias("known"), *order)).alias("first")
    rows = placed.groupBy("shard").agg(first).select("first.*").toArrow()
    columns = [rows[c].combine_chunks() for c in order]
    bounds = np.sort(sort_keys(columns[0], columns[1], columns[2].to_pylist(), columns[3].to_numpy())) if rows.num_rows else np.zeros(0, "S41")
    return np.concatenate([np.zeros(1, "S41"), bounds[1:]])  # whatever comes before the second bound is in the first shard


def with_shard(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Rows (shard, page_id, digest, uh, chunk, kind, ..) with the number of the shard that they belong to.

    A note goes to every shard that rows of its page and payload can be in, one of kind ``SAME`` to all but the first of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch["kind"].to_numpy()
            shard = lambda hashes, chunks: np.searchsorted(shared.value, sort_keys(batch["page_id"], batch["digest"], hashes, chunks), side="right") - 1  # noqa: B023, E731
            first = shard(batch["uh"].to_pylist(), batch["chunk"].to_numpy())
            last = first if not kind.any() else np.where(kind > 0, shard([b"\xff" * 8] * len(kind), np.full(len(kind), 2**32 - 1)), first)
            first = first + (kind == SAME)
            times = np.maximum(last - first + 1, 0)
            row = np.repeat(np.arange(len(kind)), times)
            number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = batch.take(pa.array(row)) if len(row) != len(kind) or kind.any() else batch
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *out.columns[1:]], names=batch.schema.names)

    return rows.mapInArrow(place, rows.schema)


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each member of a gzip stream."""
    unpack, plain = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            plain.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if not unpack.eof:
                break
            member = b"".join(plain)
            head, _, rest = member.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            unpack, plain = zlib.decompressobj(31), []
    if plain and b"".join(plain):
        raise ValueError("the archive ends within a record")


def read_file(store: fs.FileSystem, path: str) -> Iterator[tuple]:
    """Rows of RECORDS; both digests of every record are verified."""
    with store.open_input_stream(path, compression=None) as stream:
        for fields, block in parse_records(iter(lambda: stream.read(1 << 20), b"")):
            if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
                raise ValueError(f"{path}: a block differs from its digest")
            digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
            payload = block.partition(b"\r\n\r\n")[2] if response else None
            if response and base32(hashlib.sha1(payload).digest()) != digest:
                raise ValueError(f"{path}: a payload differs from its digest")
            number = lambda k, f=fields: int(f[k]) if k in f else None
            yield number("X-Page-Id"), fields.get("X-Page-Url"), payload, number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-Id")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names. Revisits have a null payload."""
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for r in read_file(store, f"{path}/{name}"):
                    held.append(r if payloads else (*r[:2], None, *r[3:]))
                    size += len(held[-1][2] or b"") + 200
                    if size > 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    files = manifest.select("file")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(rows, RECORDS)


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives and give their index back, read from the files: one row per page."""
    out = read_archives(write_archives(pages, folder), folder, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
