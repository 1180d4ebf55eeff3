"""Language ID by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ``ORDER`` bytes deep holds the counts of the bytes that follow.
A text's code length under a tree is exact: at each byte the deepest known context predicts it or escapes to the
next shorter one (escape method C, without exclusions), down to a uniform byte. The statistics are frozen
after training. The tree that codes a text in the fewest bits names its language.

Trees of up to ``LANGS_A_TABLE`` languages share one index of contexts, so one walk over the bytes looks up the costs of a byte
under all of them at once; more languages have more such tables. Training may take a bounded sample: ``docs_per_lang`` whole
documents of each language and about ``sample_docs`` in all, chosen by a hash of doc_id, which bounds the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

ORDER = 3
PAD = 10  # stands before a text's first byte
UNDETERMINED = "und"
LANGS_A_TABLE = 64
STEP_CELLS = 1 << 20  # bytes times languages that are looked up at once, however long a text is
RESULT = "doc_id long, lang_pred string, score double, bits_per_byte double"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def contexts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The 1, 2, .. ORDER bytes before each byte, those of the same text only."""
    lengths, out = np.diff(offsets), []
    for k in range(1, ORDER + 1):
        c = np.full(len(data), PAD, np.uint8)
        c[k:] = data[:-k]
        for j in range(k):
            c[(offsets[:-1] + j)[lengths > j]] = PAD
        out.append(c)
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the bytes before it, the farthest in the highest place."""
    g = data.astype(np.uint32)
    for k, c in enumerate(contexts(data, offsets), 1):
        g |= c.astype(np.uint32) << np.uint32(8 * k)
    return g


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, gram, n; summed within a batch."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for start, end, data, offsets in text_slices(batch.column(1)):
            own = sorted(set(langs[start:end]))
            of = np.repeat(np.array([own.index(x) for x in langs[start:end]], np.uint64), np.diff(offsets))
            keys, n = np.unique(of << np.uint64(32) | grams(data, offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.string()).take(pa.array((keys >> np.uint64(32)).astype(np.int64))), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "gram", "n"],
            )


class Trees:
    """Frozen context trees of all languages, compiled to lookup tables of code lengths in bits."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        # known[k]: contexts of k bytes under any language, sorted; escape[k]: their escape cost, 0 where a tree lacks them
        self.known: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        below = None
        for k in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            per = []
            for lang in self.langs:
                g, n = counts[lang]
                own, at = np.unique(g.astype(np.uint64) & mask, return_inverse=True)
                per.append((own, np.bincount(at, n, len(own))))
            seen = np.unique(np.concatenate([p[0] for p in per])) if per else np.zeros(0, np.uint64)
            known = np.unique(seen >> np.uint64(8))
            escape = np.zeros((len(known), n_langs))
            if k == 0:
                cost = np.full((len(seen), n_langs), 8.0)
            else:
                cost = below(seen & np.uint64((1 << 8 * k) - 1))
            for j, (own, n) in enumerate(per):
                ctx = np.searchsorted(known, own >> np.uint64(8))
                total, distinct = np.bincount(ctx, n, len(known)), np.bincount(ctx, minlength=len(known))
                has = total > 0
                escape[has, j] = np.log2((total[has] + distinct[has]) / distinct[has])
                cost[:, j] += escape[np.searchsorted(known, seen >> np.uint64(8)), j]
                cost[np.searchsorted(seen, own), j] = np.log2((total[ctx] + distinct[ctx]) / n)
            self.known.append(known)
            self.escape.append(escape)
            self.seen.append(seen)
            self.cost.append(cost)
            below = lambda g, k=k: self._of(g, k)
        self._compile()

    def _of(self, g: np.ndarray, k: int) -> np.ndarray:
        """Costs of the last byte of g under its k bytes of context, by the sorted tables."""
        if k < 0:
            return np.full((len(g), len(self.langs)), 8.0)
        at = np.minimum(np.searchsorted(self.seen[k], g), len(self.seen[k]) - 1)
        hit = self.seen[k][at] == g
        out = self.cost[k][at]
        if not hit.all():
            miss = g[~hit]
            c = miss >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.known[k], c), len(self.known[k]) - 1)
            out[~hit] = self._of(miss & np.uint64((1 << 8 * k) - 1), k - 1) + np.where((self.known[k][at] == c)[:, None], self.escape[k][at], 0)
        return out

    def _compile(self) -> None:
        """Dense steps for grams that training saw: 2 context bytes -> node, third -> node, next byte -> row of costs."""
        full, ctx = self.seen[ORDER], self.known[ORDER]
        tail = ctx & np.uint64(0xFFFF)
        pairs = np.unique(tail)
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[pairs.astype(np.int64)] = np.arange(1, len(pairs) + 1)
        self.node = np.zeros((len(pairs) + 1) * 256, np.int32)
        self.node[self.pair[tail.astype(np.int64)].astype(np.int64) * 256 + (ctx >> np.uint64(16)).astype(np.int64)] = np.arange(1, len(ctx) + 1)
        self.row = np.full((len(ctx) + 1) * 256, -1, np.int32)
        self.row[(np.searchsorted(ctx, full >> np.uint64(8)).astype(np.int64) + 1) * 256 + (full & np.uint64(0xFF)).astype(np.int64)] = np.arange(len(full))
        self.fast = self.cost[ORDER].astype(np.float64)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        before = contexts(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        step = max(1, STEP_CELLS // max(1, len(self.langs)))
        for a in range(0, len(data), step):
            b = min(a + step, len(data))
            costs = self._costs(data[a:b], [c[a:b] for c in before])
            first, last = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b)
            texts = np.arange(first, last)[np.diff(np.clip(offsets[first : last + 1], a, b)) > 0]
            out[texts] += np.add.reduceat(costs, np.maximum(offsets[texts] - a, 0), axis=0)
        return out

    def _costs(self, data: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Bits of each byte after the bytes before it."""
        c1, c2, c3 = before
        node = self.node[self.pair[c1.astype(np.int32) | c2.astype(np.int32) << 8] * 256 + c3]
        row = self.row[node * 256 + data]
        costs = self.fast[np.maximum(row, 0)] if len(self.fast) else np.zeros((len(data), len(self.langs)))
        rare = np.flatnonzero(row < 0)
        if len(rare):
            g = data[rare].astype(np.uint64)
            for k, c in enumerate(before, 1):
                g |= c[rare].astype(np.uint64) << np.uint64(8 * k)
            once, at = np.unique(g, return_inverse=True)
            costs[rare] = self._of(once, ORDER)[at]
        return costs


class Forest:
    """The trees of all languages, in tables of LANGS_A_TABLE languages each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.tables = [Trees({x: counts[x] for x in self.langs[k : k + LANGS_A_TABLE]}) for k in range(0, len(self.langs), LANGS_A_TABLE)]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.concatenate([t.bits(data, offsets) for t in self.tables], axis=1)


def train(labelled: DataFrame, docs_per_lang: int = 400, sample_docs: int = 100_000) -> Forest:
    """Trees from (doc_id, text, lang) rows with a text and a lang; every language is learned.

    The sample holds about ``docs_per_lang`` documents of each language, whole texts, or all where there are fewer; with so many
    languages that these would be more than ``sample_docs``, as many fewer of each. Grams are counted on the executors; the
    driver gets one row for each distinct gram of that sample.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sizes.count()
    if not langs:
        return Forest({})
    each = min(docs_per_lang, sample_docs / langs)
    draw = (F.xxhash64("doc_id", F.lit("lang-sample")) / F.lit(2.0**64)) + 0.5
    known = F.broadcast(sizes) if langs <= 10_000 else sizes  # a row a language, counted above
    sample = rows.join(known, "lang").where(draw < F.lit(float(each)) / F.col("n")).select("lang", "text")
    counted = sample.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    gram, n = counted["gram"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    lang = counted["lang"].combine_chunks().dictionary_encode()
    codes = lang.indices.to_numpy()
    return Forest({x: (gram[a:b], n[a:b]) for k, x in enumerate(lang.dictionary.to_pylist()) for a, b in [np.searchsorted(codes, [k, k + 1])]})


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


def identify(docs: DataFrame, trees: Forest) -> DataFrame:
    """Per row: doc_id, lang_pred, score, bits_per_byte (of the winner); whole texts, nothing but the text is looked at.

    lang_pred is a trained language, the first by name on a tie, or ``und`` if the text is null or has no letter, or if
    nothing was trained; score is the winner's share of the probability that the trees give the text, 0 for ``und``.
    Repeated rows give repeated results; extra columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            doc_id, texts = batch.column(0), batch.column(1)
            for start, end, data, offsets in text_slices(texts):
                size = np.diff(offsets)
                best, score, rate = np.full(end - start, len(names) - 1), np.zeros(end - start), np.zeros(end - start)
                if model.langs:
                    bits = model.bits(data, offsets)
                    told = has_letter(data, offsets)
                    best[told] = bits[told].argmin(axis=1)
                    least = bits.min(axis=1)
                    odds = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    score[told] = 1 / odds[told]
                    rate[told] = least[told] / size[told]
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(start, end - start).cast(pa.int64()), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rate)],
                    names=["doc_id", "lang_pred", "score", "bits_per_byte"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, RESULT)


def keep_identified(docs: DataFrame, trees: Trees, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told with a score of ``least_score`` or more; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(at)):
                keep = np.zeros(end - start, bool)
                if model.langs:
                    bits = model.bits(data, offsets)
                    odds = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                    keep = has_letter(data, offsets) & (1 / odds >= least_score)
                yield batch.slice(start, end - start).filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)
