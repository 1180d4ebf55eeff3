"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary, checked against the library.

Encoding is a score-ordered agenda: every adjacent pair of symbols that is a piece enters a heap by falling
score, then position; the best live pair is merged and its two new neighbours enter. No piece of the vocabulary
reaches across certain boundaries (found from the pieces themselves when the model loads), so a text falls
into words that merge independently, and words repeat: each task keeps a bounded table of encoded words.
New short words merge side by side: their agendas are the columns of one array, and each round takes every
agenda's best pair, the leftmost of equals. Long words have an agenda each.
The result of every text is compared with the library's in the same Arrow batch, and so is the decoded text.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import heapq
import itertools
import operator
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, text_slices

SPACE = "▁"
SHORT = 24  # characters up to which a chunk's agenda is a list
NEVER = 1 << 24
WIDTHS = (8, 11, 14, 20, 32)  # characters, the space before a word included, of words whose agendas stand side by side
FEW = 32  # words up to which arrays gain nothing
SIDE_BY_SIDE = 8192  # words that stand side by side at most
SPREAD = np.int64(0x1E3779B97F4A7C15)  # an odd number that spreads pairs over slots
PLACES = 64  # an agenda's entry is rank * PLACES + place
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeCodec:
    """The agenda encoder and the decoder of one model file."""

    def __init__(self, path: str, cache_limit: int = 1_100_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos, self.unknown = sp.eos_id(), sp.unk_id()
        self.score, self.id_of, self.bytes_of, self.byte_id = {}, {}, [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.id_of[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        # Equal scores share a rank, and of equal ranks the leftmost pair goes first.
        ranks = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {piece: ranks[x] for piece, x in self.score.items()}
        self.own_int = list(range(len(self.bytes_of)))
        self.own_str = [str(i) for i in self.own_int]
        self._number_pairs()
        self.parts = self._boundaries()
        self.inner: dict[str, tuple[int, ...]] = {}  # parts inside words
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_limit = cache_limit

    def _boundaries(self) -> re.Pattern:
        """Parts of a spaced word that merge independently: marks that no piece joins to a letter, characters that no piece joins to any."""
        pairs = [p for piece in self.score for p in itertools.pairwise(piece)]
        if any(SPACE in piece[1:] and piece.strip(SPACE) for piece in self.score):
            raise ValueError("a piece reaches across a space: such vocabularies are not supported")
        joined = {c for p in pairs for c in p}
        lone = re.escape("".join(sorted(set(" \n\t\r") - joined)))
        marks = re.escape("".join(sorted(set(string.punctuation) - {"_"} - {b for a, b in pairs if a.isalpha()})))
        return re.compile(f"{SPACE}*[^\\W\\d_]+(?=[{marks}{lone}]|\\Z)|[{marks}]+(?=[{lone}]|\\Z)|[{lone}]+|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+")

    def _number_pairs(self) -> None:
        """Numbers of symbols (ids, then characters that are in pieces only, any other character, no symbol) and, by two numbers, what a pair makes."""
        self.none = none = len(self.bytes_of)
        parts = sorted({c for piece in self.score for c in piece} - self.id_of.keys())
        number = {**self.id_of, **{c: none + k for k, c in enumerate(parts)}}
        self.other, self.blank, self.base = none + len(parts), none + len(parts) + 1, none + len(parts) + 2
        chars = {b: i for b, i in self.byte_id.items() if b < 128}  # characters of one byte that no piece holds
        chars |= {ord(c): k for c, k in number.items() if len(c) == 1}
        self.kind = kind = np.int32 if self.base**2 < 1 << 31 else np.int64
        self.of_char = np.full(max(chars, default=0) + 2, self.other, kind)
        self.of_char[list(chars)] = list(chars.values())
        made = {number[a] * self.base + number[b]: i for piece, i in self.id_of.items() for k in range(1, len(piece)) if (a := piece[:k]) in number and (b := piece[k:]) in number}
        self.pairs = np.array([*sorted(made), self.base**2], np.int64)
        self.makes = np.array([*(made[k] for k in sorted(made)), none], kind)
        # One pair a slot; the others of a slot are looked up in order.
        self.slot_bits = max(8, (4 * len(made)).bit_length())
        slots, first = self._slots(self.pairs[:-1]), np.full(1 << self.slot_bits, len(made))
        first[slots] = np.arange(len(made))
        self.slot_pairs, self.slot_makes = self.pairs[first], self.makes[first]
        self.crowded = np.bincount(slots, minlength=1 << self.slot_bits) > 1
        self.ranks = np.full(none + 1, NEVER, np.int32)
        self.ranks[list(self.id_of.values())] = [self.rank[piece] for piece in self.id_of]
        self.shared = np.array(self.own_int, dtype=object)

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * SPREAD) >> (63 - self.slot_bits) & ((1 << self.slot_bits) - 1)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or ``none``."""
        key = left.astype(np.int64) * self.base + right
        slot = self._slots(key)
        same = self.slot_pairs[slot] == key
        made = np.where(same, self.slot_makes[slot], self.kind(self.none))
        if (rest := ~same & self.crowded[slot]).any():
            at = np.searchsorted(self.pairs, key[rest])
            made[rest] = np.where(self.pairs[at] == key[rest], self.makes[at], self.none)
        return made

    def _merge_columns(self, words: list[str], width: int) -> None:
        """Put words of less than ``width`` characters into the table, but for those that come to a character which is no piece."""
        text = "".join([(SPACE + w).ljust(width) for w in words]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(text, np.uint32).reshape(len(words), width)
        rows = np.arange(width, dtype=np.int32)[:, None]
        codes = np.minimum(np.ascontiguousarray(codes.T), len(self.of_char) - 1)
        symbols = np.where(rows <= np.array(list(map(len, words))), self.of_char[codes], self.kind(self.blank))
        pieces = self._made(symbols[:-1], symbols[1:])
        agendas = self.ranks[pieces] * PLACES + rows[:-1]
        live, merged = np.arange(len(words)), np.empty((len(words), width), self.kind)
        while len(live):
            best = agendas.min(0)
            over = best >= NEVER * PLACES
            if over.any():
                merged[live[over]] = symbols[:, over].T
                live, best = live[~over], best[~over]
                symbols, pieces, agendas = symbols[:, ~over], pieces[:, ~over], agendas[:, ~over]
            at, column = best % PLACES, np.arange(len(live))
            made = pieces[at, column]
            behind = rows[:-1] > at  # what is behind the pair moves up by one
            symbols = np.vstack([np.where(behind, symbols[1:], symbols[:-1]), np.full((1, len(live)), self.blank, self.kind)])
            symbols[at, column] = made
            pieces[:-1] = np.where(behind[:-1], pieces[1:], pieces[:-1])
            agendas[:-1] = np.where(behind[:-1], agendas[1:] - 1, agendas[:-1])
            pieces[-1], agendas[-1] = self.none, NEVER * PLACES + width - 2
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            for some, place in ((before, at[before] - 1), (after, at[after])):
                pieces[place, some] = new = self._made(symbols[place, some], symbols[place + 1, some])
                agendas[place, some] = self.ranks[new] * PLACES + place
        filled = merged != self.blank
        known = ((merged < self.none) | ~filled).all(1)
        ends = np.cumsum(filled[known].sum(1)).tolist()
        ids = self.shared[merged[known][filled[known]]].tolist()
        for k, a, b in zip(np.flatnonzero(known).tolist(), [0, *ends], ends, strict=False):
            self.cache[words[k]] = tuple(ids[a:b])

    def _learn(self, words: set[str]) -> None:
        """Put new short words into the table."""
        by_width: dict[int, list[str]] = {}
        for w in words:
            if len(w) < WIDTHS[-1]:
                by_width.setdefault(WIDTHS[bisect.bisect_right(WIDTHS, len(w))], []).append(w)
        most = max(1, min(SIDE_BY_SIDE, self.cache_limit // 2))
        for width, some in by_width.items():
            for k in range(0, len(some) if len(some) > FEW else 0, most):
                self._make_room()
                self._merge_columns(some[k : k + most], width)

    def _make_room(self) -> None:
        """The older half of a full table goes; what is frequent comes back at once."""
        if len(self.cache) >= self.cache_limit:
            for key in list(itertools.islice(self.cache, self.cache_limit // 2)):
                del self.cache[key]

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk: take the best pair off the agenda until none is left."""
        symbols = self._merge_short(chunk) if len(chunk) <= SHORT else self._merge_long(chunk)
        ids: list[int] = []
        for s, i in zip(symbols, map(self.id_of.get, symbols), strict=True):
            if i is not None:
                ids.append(i)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in s.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _merge_short(self, chunk: str) -> list[str]:
        """The agenda as a list of the pairs' ranks in order of position: its first least entry is the best pair."""
        rank = self.rank.get
        symbols = list(chunk)
        agenda = [rank(p, NEVER) for p in map(operator.add, chunk, chunk[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            symbols[i] = piece = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + piece, NEVER)
            if i < len(agenda):
                agenda[i] = rank(piece + symbols[i + 1], NEVER)
        return symbols

    def _merge_long(self, chunk: str) -> list[str]:
        """The agenda as a heap; entries whose symbols have changed meanwhile are passed over."""
        rank = self.rank
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + piece) in rank:
                heapq.heappush(agenda, (rank[p], h, p))
        return [s for s in symbols if s is not None]

    def _unknown_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word that the table lacks; each of its parts may be there."""
        ids: list[int] = []
        for k, part in enumerate((SPACE + word,) if word.isalpha() else self.parts.findall(SPACE + word)):
            known = self.inner.get(part) if k else self.cache.get(part[1:])
            if known is None:
                known = tuple([self.own_int[i] for i in self.merge(part)])
                if k and len(part) <= 8 and len(self.inner) < 50_000:
                    self.inner[part] = known
            ids += known
        out = tuple(ids)
        if len(word) <= 64:
            self._make_room()
            self.cache[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; words that are new in any of them are merged together."""
        split = list(map(spaced_words, texts))
        found = [list(map(self.cache.get, words)) for words in split]
        lacking = [list(itertools.compress(words, [e is None for e in entries])) if None in entries else [] for words, entries in zip(split, found, strict=True)]
        self._learn(set(itertools.chain.from_iterable(lacking)))
        get, unknown = self.cache.get, self._unknown_word
        out = []
        for entries, words in zip(found, lacking, strict=True):
            if words:
                learned = iter([get(w) or unknown(w) for w in words])
                entries = [next(learned) if e is None else e for e in entries]
            ids = list(itertools.chain.from_iterable(entries))
            ids.append(self.eos)
            out.append(ids)
        return out

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by spaces."""
        return " ".join(map(self.own_str.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def spaced_words(text: str) -> list[str]:
    """The words of a text without the space before each; a run of spaces belongs to the word behind it."""
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return words
    runs, spaces = [], 0
    for w in words:
        if w:
            runs.append(SPACE * spaces + w)
            spaces = 0
        else:
            spaces += 1
    return runs + [SPACE * (spaces - 1)] * (spaces > 0)


_loaded: dict[str, MergeCodec] = {}


def codec(path: str) -> MergeCodec:
    """One codec a worker process; its table of words lasts for a task."""
    if path not in _loaded:
        _loaded[path] = MergeCodec(path)
    return _loaded[path]


def encode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The codec's rows; its tables are empty and the collector is as before when the task ends, however it ends."""
    own, collects = codec(path), gc.isenabled()
    gc.disable()  # millions of live tuples and lists without cycles: reference counts free all of them
    try:
        yield from encoded_batches(batches, own)
    finally:
        own.cache.clear()  # the process may serve other stages next
        own.inner.clear()
        if collects:
            gc.enable()


def encoded_batches(batches: Iterator[pa.RecordBatch], own: MergeCodec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, texts = batch.column(0), batch.column(1)
        for start, end, _, _ in text_slices(texts, 2 * SLICE_BYTES):
            rows = [t or "" for t in texts.slice(start, end - start).to_pylist()]
            encoded = own.encode_all(rows)
            expected = own.library.encode(rows, add_eos=True, num_threads=1)
            decoded = own.library.decode(expected, num_threads=1)
            for k, (mine, theirs) in enumerate(zip(encoded, expected, strict=True)):
                if mine != theirs or own.decode(mine) != decoded[k]:
                    raise ValueError(f"doc_id {doc_id[start + k]}: the agenda's result differs from the library's")
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id.slice(start, end - start).cast(pa.int64()),
                    pa.array(list(map(len, encoded)), pa.int64()),
                    pa.array([hashlib.sha256(own.written(e).encode()).hexdigest() for e in encoded]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id, n_tokens (the end id counts), ids_sha256, decoded_sha256.

    Whole texts, without sampling; null counts as empty, which has the end id alone. Repeated rows give
    repeated results and columns other than doc_id and text are not read. ``model_path`` must be readable on
    every executor. There is no shuffle: memory is bounded by an Arrow batch and the longest text.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encode_rows(batches, model_path), RESULT)


def token_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids themselves, for a trainer's input."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of ``token_ids`` rows; null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")
