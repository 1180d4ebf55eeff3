"""Small helpers shared by the operators: shared-folder tables, Arrow slices and vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
SLICE_BYTES = 1 << 19
#: Code points that separate words in every operator: space and tab to carriage return.
WORD_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-"))
            own = spark.sparkContext.getCheckpointDir()
        base = own
    return f"{base.rstrip('/')}/tallymark/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which any executor can read again.

    The tables of an application lie under ``shared_dir`` and can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, their UTF-8 bytes, byte offsets). Null texts count as empty.

    No text is cut: a run holds whole texts, and one text longer than ``limit`` is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


# ---- hashing: 64-bit words, all arithmetic wraps modulo 2**64 -------------------------------

_ODD = 0x9E3779B97F4A7C15  # increments and multipliers of the splitmix64 finaliser: fixed values
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(_ODD)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_M1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or those of the base's inverse (an odd base has one)."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = _BASES[which]
        base = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _powers[which, inverse] = have
    return have[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each range, from one prefix sum."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(n, which), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(n + 1, which, inverse=True)[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(WORD_SEPARATORS)] = True


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words of each text: starts, ends and, for each text, the offset of its first word."""
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _SEPARATES[data]
    first = np.zeros(n + 1, bool)  # a text's first byte starts a word even where the text before has no separator at its end
    first[offsets[:-1]] = True
    first[offsets[1:]] = True
    inner = ~gap[1:-1]
    begins = inner & (gap[:-2] | first[:n])
    finishes = inner & (gap[2:] | first[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolling(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - width + 1, np.uint64)
    for k in range(width):
        out *= np.uint64(_BASES[which])
        out += values[k : len(values) - width + 1 + k]
    return mix(out)
