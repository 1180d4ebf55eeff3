"""Fill-in-middle transformation over token counts, with a sparse index of checkpoints in place of a list of tokens.

A unit is a run of ASCII letters or any other single code point. While the units of a text are counted, every
``every``-th unit's number, byte offset and code-point offset are recorded. A cut is found by binary search in those
checkpoints and a short scan of the text from there. Memory beyond the text is one block and the checkpoints.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

EVERY = 256  # units between checkpoints
BLOCK = 1 << 16  # bytes that are scanned at once
MARKS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_heads(data: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For bytes start:end, whether a unit begins there and whether a code point does."""
    part = data[start:end]
    leads = (part & 0xC0) != 0x80
    lower = part | 0x20
    letter = (lower >= 97) & (lower <= 122)
    after = np.empty(len(part), bool)  # the byte before is a letter
    after[1:] = letter[:-1]
    after[:1] = start > 0 and 97 <= (data[start - 1] | 0x20) <= 122
    return leads & ~(letter & after), leads


class Checkpoints:
    """Offsets of every ``every``-th unit of one text, its number of units and of code points."""

    def __init__(self, data: np.ndarray, every: int = EVERY, block: int = BLOCK):
        self.data, self.block = data, block
        self.units = self.chars = 0
        numbers, at_byte, at_char = [], [], []
        for start in range(0, len(data), block):
            heads, leads = unit_heads(data, start, start + block)
            where = np.flatnonzero(heads)
            picked = where[-self.units % every :: every]
            chars = np.cumsum(leads)
            numbers.append(self.units + -self.units % every + every * np.arange(len(picked)))
            at_byte.append(start + picked)
            at_char.append(self.chars + chars[picked] - 1)
            self.units += len(where)
            self.chars += int(chars[-1])
        self.numbers, self.at_byte, self.at_char = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, at_byte, at_char))

    def locate(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit begins; the text's ends for the number of units."""
        if unit >= self.units:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.numbers, unit, side="right")) - 1
        byte, char, ahead = int(self.at_byte[k]), int(self.at_char[k]), unit - int(self.numbers[k])
        step = 8 * ahead + 64
        while True:
            heads, leads = unit_heads(self.data, byte, byte + step)
            where = np.flatnonzero(heads)
            if ahead < len(where):
                return byte + int(where[ahead]), char + int(leads[: where[ahead]].sum())
            ahead -= len(where)
            char += int(leads.sum())
            byte += step
            step = min(2 * step, self.block)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned integers of 32 bits from the seed and the decimal id; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(doc_id: int | None, data: np.ndarray, seed: int, plain_share: int, suffix_first_share: int, marks: tuple[bytes, ...]) -> tuple:
    """One row of ``RESULT`` without its doc_id, the output in bytes."""
    index = Checkpoints(data)
    n, text = index.units, data.tobytes()
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= 100 - plain_share or any(m in text for m in marks):
        return n, "plain", None, None, text
    (cut, cut_char), (back, back_char) = (index.locate(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:cut], text[cut:back], text[back:]
    before_prefix, before_suffix, before_middle = marks
    if h4 % 100 < suffix_first_share:
        form, parts = "spm", (before_suffix, suffix, before_prefix, prefix, before_middle, middle)
    else:
        form, parts = "psm", (before_prefix, prefix, before_suffix, suffix, before_middle, middle)
    return n, form, cut_char, back_char - cut_char, b"".join(parts)


def overlaps(mark: bytes, marks: tuple[bytes, ...]) -> bool:
    """Whether the mark lies in another one or ends as one of them begins, so that it could arise where parts meet."""
    return any(other.startswith(mark[k:]) for other in marks for k in range(1, len(mark))) or any(mark in other for other in marks if other != mark)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_share: int = 10, suffix_first_share: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (the whole new text).

    Both shares are percentages: of texts left plain, and of the others those written suffix first. Texts that are
    empty or hold one of the marks are plain, so ``restored`` is exact. Null text counts as empty; a null doc_id draws
    as an empty number; repeated rows give repeated results; other columns are not read. There is no shuffle: memory is
    an Arrow batch and the longest text.
    """
    written = tuple(m.encode() for m in marks)
    if not all(written) or len(set(written)) < 3 or any(overlaps(m, written) for m in written):
        raise ValueError("marks must be three different texts, none of which begins as another or itself ends")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in text_slices(batch.column(1)):
                out = [transformed(ids[first + k], data[offsets[k] : offsets[k + 1]], seed, plain_share, suffix_first_share, written) for k in range(end - first)]
                n, form, prefix, middle, text = zip(*out, strict=True)
                longs = [pa.array(x, pa.int64()) for x in (ids[first:end], n, prefix, middle)]
                yield pa.RecordBatch.from_arrays([longs[0], longs[1], pa.array(form, pa.string()), longs[2], longs[3], pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(rows, RESULT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from: its parts stand between marks, each of which it holds once."""
    quoted = [re.sub(r"([^A-Za-z0-9])", r"\\\1", m) for m in marks]

    def parts(text: Column, a: str, b: str, c: str) -> Column:
        head = F.split(text, b, 2)
        tail = F.split(F.get(head, F.lit(1)), c, 2)
        return F.array(F.substr(F.get(head, F.lit(0)), F.lit(len(marks[quoted.index(a)]) + 1)), F.get(tail, F.lit(0)), F.get(tail, F.lit(1)))

    p, s, m = quoted
    psm, spm = parts(output, p, s, m), parts(output, s, p, m)
    at = lambda x, k: F.get(x, F.lit(k))
    return F.when(form == "psm", F.concat(at(psm, 0), at(psm, 2), at(psm, 1))).when(form == "spm", F.concat(at(spm, 1), at(spm, 2), at(spm, 0))).otherwise(output)
