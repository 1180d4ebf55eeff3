"""Mixing sources to target weights, with soft membership.

A naive Bayes classifier learned from a labelled table gives each document a posterior over the domains; a document counts
in every domain by that share. Its features are the presence of words and of the marks that words carry, hashed into buckets;
only those that tell some domain from the rest in the labelled documents count. Then a nonnegative rate for each document is fitted so that the expected tokens of each domain
meet their targets: least squares over the domains' gaps, each gap squared over what the domain has, by projected gradient from
rate 1 (take all as it is). Steps are scaled by the curvature that the documents with a rate above 0 have between the domains.

A step is one number a domain, so the rate of a document follows from its posterior and the short list of past steps: each
round is one pass that sums the domains' tokens and their curvature, and the driver sees a number for each pair of domains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, mix, range_hashes, text_slices, word_ranges

WORD_BUCKETS = 1 << 16
BUCKETS = WORD_BUCKETS + (1 << 12)  # the rest are for the marks in words
LEAST_DOCS = 5  # documents of the domain that have it, or would if it were like the rest
LEAST_Z = 5.0  # standard errors by which a feature's share must differ between a domain and the rest
LEAST_PHI = 0.25  # and the correlation of feature and domain
STEP_CELLS = 1 << 22  # buckets times domains that training looks at together
DAMPING, LEAST_DAMPING = 1e-3, 1e-6  # how far steps are shortened, as a share of what a domain has
POSTERIORS = "doc_id long, tokens long, posterior array<double>"


@dataclass
class Mixture:
    """A classifier (domains, log prior without any feature, log odds by bucket) and the fitted steps."""

    domains: list[str]
    prior: np.ndarray
    buckets: np.ndarray  # those that count, sorted
    words: np.ndarray  # of each of these by domain: log odds of its presence
    steps: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    target: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reached: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and its share in each domain; a text without words has what the absence of all features says."""
        doc, bucket, tokens = features(data, offsets)
        n = len(tokens)
        if not self.domains:
            return tokens, np.zeros((n, 0))
        odds = np.tile(self.prior, (n, 1))
        if len(self.buckets):
            place = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            told = self.buckets[place] == bucket
            pairs = np.unique(doc[told] * len(self.buckets) + place[told])
            np.add.at(odds, pairs // len(self.buckets), self.words[pairs % len(self.buckets)])
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        return tokens, odds / odds.sum(axis=1, keepdims=True)

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        return fold_rates(posterior, self.steps)


def fold_rates(posterior: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the projected steps: each takes the posterior's share of the domains' gaps off and stops at 0."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(rate - posterior @ step, 0)
    return rate


_MARKS = mix(np.arange(256, dtype=np.uint64))
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0  # letters and digits are no marks


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each word and of each word's marks, and the words of each text."""
    data = lower_ascii(data)
    starts, ends, first = word_ranges(data, offsets)
    tokens = np.diff(first)
    doc = np.repeat(np.arange(len(tokens)), tokens)
    word = (range_hashes(data, starts, ends) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MARKS[data])])
    marks = sums[ends] - sums[starts]
    some = marks != 0
    marked = (mix(marks[some]) & np.uint64(BUCKETS - WORD_BUCKETS - 1)).astype(np.int64) + WORD_BUCKETS
    return np.concatenate([doc, doc[some]]), np.concatenate([word, marked]), tokens


def learn(docs: DataFrame, labelled: DataFrame, sample_docs: int = 20_000) -> Mixture:
    """A classifier from (doc_id, domain) rows and those documents' whole texts.

    ``sample_docs`` bounds the labelled documents used, chosen by a hash of doc_id. Null domains and unknown ids are ignored.
    """
    known = labelled.where("domain IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("domain").cast("string"))
    n = known.count()
    draw = F.xxhash64("doc_id", F.lit("domain-sample")) / F.lit(2.0**64) + 0.5
    sample = docs.select("doc_id", "text").join(known.where(draw < sample_docs / max(n, 1)), "doc_id").select("domain", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for start, end, data, offsets in text_slices(batch.column(1)):
                own = sorted(set(names[start:end]))
                doc, bucket, _ = features(data, offsets)
                present = np.unique(doc * BUCKETS + bucket)
                place = np.array([own.index(x) for x in names[start:end]], np.int64)
                keys, n = np.unique(np.concatenate([place[present // BUCKETS] * (BUCKETS + 1) + present % BUCKETS, place * (BUCKETS + 1) + BUCKETS]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()).take(pa.array(keys // (BUCKETS + 1))), pa.array(keys % (BUCKETS + 1)), pa.array(n.astype(np.int64))], names=["domain", "bucket", "n"])

    counted = sample.mapInArrow(count, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).orderBy("bucket", "domain").toArrow()
    bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy().astype(float)
    codes = counted["domain"].combine_chunks().dictionary_encode() if len(bucket) else pa.array([], pa.string()).dictionary_encode()
    domains = sorted(codes.dictionary.to_pylist())
    domain = np.searchsorted(np.array(domains, dtype=object), np.array(codes.dictionary.to_pylist(), dtype=object))[codes.indices.to_numpy()] if domains else np.zeros(0, np.int64)
    each = np.bincount(domain[bucket == BUCKETS], n[bucket == BUCKETS], len(domains))  # documents by domain
    rest, prior = each.sum() - each, np.log((each + 1) / (each + 1).sum())
    kept, words = [], [np.zeros((0, len(domains)))]
    step = max(1, STEP_CELLS // max(1, len(domains)))
    for low in range(0, BUCKETS if domains else 0, step):
        a, b = np.searchsorted(bucket, [low, min(low + step, BUCKETS)])
        present = np.zeros((min(step, BUCKETS - low), len(domains)))  # documents with the feature, by domain
        present[bucket[a:b] - low, domain[a:b]] = n[a:b]
        others, pooled = present.sum(axis=1, keepdims=True) - present, present.sum(axis=1, keepdims=True) / max(each.sum(), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (present / each - others / rest) / np.sqrt(pooled * (1 - pooled) * (1 / each + 1 / rest))
        z = np.abs(np.nan_to_num(z, posinf=0, neginf=0))
        told = ((z >= max(LEAST_Z, LEAST_PHI * np.sqrt(each.sum()))) & (np.maximum(present, pooled * each) >= LEAST_DOCS)).any(axis=1)
        share = np.clip((present[told] + 2 * pooled[told]) / (each + 2), 1e-6, 1 - 1e-6)
        kept.append(np.flatnonzero(told) + low)
        words.append(np.log(share) - np.log1p(-share))
        prior = prior + np.log1p(-share).sum(axis=0)
    return Mixture(domains, prior, np.concatenate([np.zeros(0, np.int64), *kept]), np.concatenate(words))


def classify(docs: DataFrame, model: Mixture) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                tokens, posterior = shared.value.posteriors(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - start + 1, dtype=np.int32) * posterior.shape[1]), pa.array(posterior.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).cast(pa.int64()), pa.array(tokens.astype(np.int64)), lists], names=["doc_id", "tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(rows, POSTERIORS)


def fit(shares: DataFrame, model: Mixture, weights: dict[str, float], anchor: str | None = None, tolerance: float = 1e-3, stall: float = 0.1, watch: int = 8) -> Mixture:
    """The steps that bring the expected tokens of each domain to their targets.

    ``weights`` are relative; domains not named get 0. The total is the corpus's tokens or, with an ``anchor``, such that the
    anchor's target is what it has. The fit ends when every gap is within ``tolerance`` of what its domain has, or when
    ``watch`` passes together took less than the share ``stall`` off the squared gaps; there is no cap on rounds. A target that
    no nonnegative rates can reach is met as closely as they allow, and ``target`` and ``reached`` of the result say how closely.
    """
    n = len(model.domains)
    if not n:
        return model
    steps: list[np.ndarray] = []

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, curvature = np.zeros(n), np.zeros((n, n))
        for batch in batches:
            posterior = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            rate, weighed = fold_rates(posterior, steps), posterior * batch.column(0).to_numpy()[:, None]
            tokens += rate @ weighed
            curvature += weighed[rate > 0].T @ posterior[rate > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + n * n)), pa.array(np.concatenate([tokens, curvature.ravel()]))], names=["cell", "value"])

    def summed() -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain after the steps, and the curvature of the documents with a rate above 0."""
        cells = shares.select("tokens", "posterior").mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(n + n * n)
        out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
        return out[:n], out[n:].reshape(n, n)

    have, curvature = summed()
    weight = np.array([float(weights.get(d, 0.0)) for d in model.domains])
    weight = weight / weight.sum() if weight.sum() else weight
    total = have.sum()
    if anchor in model.domains and weight[model.domains.index(anchor)] > 0:
        total = have[model.domains.index(anchor)] / weight[model.domains.index(anchor)]
    target, scale = weight * total, np.maximum(have, 1.0)
    squares = lambda tokens: float((((tokens - target) ** 2) / scale).sum())
    reached, damping, past = have, DAMPING, [squares(have)]
    while (np.abs(reached - target) / scale).max(initial=0) >= tolerance and (len(past) <= watch or past[-1] < (1 - stall) * past[-1 - watch]):
        steps = [*steps, np.linalg.solve(curvature + damping * np.diag(scale), reached - target)]
        tokens, curves = summed()
        if squares(tokens) < past[-1]:
            reached, curvature, damping = tokens, curves, max(damping / 10, LEAST_DAMPING)
        else:  # too far: with damping of 1 and above a step is within the plain gradient's, which descends
            steps, damping = steps[:-1], min(damping * 10, 1 / LEAST_DAMPING)
        past.append(squares(reached))
    return Mixture(model.domains, model.prior, model.buckets, model.words, np.array(steps).reshape(-1, n), target, reached)


def copies_of(rate: np.ndarray, doc_id: pa.Array) -> np.ndarray:
    """Whole copies with the rate as expectation: the fraction is settled by a hash of doc_id, the same in every run."""
    draw = mix(doc_id.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) / 2.0**64
    return np.floor(rate + draw).astype(np.int32)


def rate_rows(shares: DataFrame, fitted: Mixture) -> DataFrame:
    """Per row: doc_id, tokens, domain (the likeliest), rate, copies, and that domain's target_tokens and reached_tokens."""
    shared = shares.sparkSession.sparkContext.broadcast(fitted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            posterior = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(model.domains))
            rate = model.rates(posterior)
            best = posterior.argmax(axis=1) if model.domains else None
            pick = lambda values, kind: pa.nulls(batch.num_rows, kind) if best is None else pa.array(values, kind).take(pa.array(best))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pick(model.domains, pa.string()), pa.array(rate), pa.array(copies_of(rate, batch.column(0))), pick(model.target, pa.float64()), pick(model.reached, pa.float64())],
                names=["doc_id", "tokens", "domain", "rate", "copies", "target_tokens", "reached_tokens"],
            )

    return shares.mapInArrow(rows, "doc_id long, tokens long, domain string, rate double, copies int, target_tokens double, reached_tokens double")


def mix_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, tokens, domain, rate, copies, target_tokens, reached_tokens (both of its domain).

    Whole texts; null counts as empty, has no tokens and the prior's posterior. Repeated rows get equal rates. Without any labelled
    document there are no domains and every rate is 1. Columns other than doc_id and text are not read. An empty table gives
    an empty result.
    """
    model = learn(docs, labelled)
    shares = materialize(classify(docs, model), "posteriors")
    return rate_rows(shares, fit(shares, model, weights, anchor))


def apply_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix_rates`` says; texts are not shuffled."""
    model = learn(docs, labelled)
    fitted = fit(materialize(classify(docs, model), "posteriors"), model, weights, anchor)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(names.index("text"))):
                part = batch.slice(start, end - start)
                _, posterior = own.posteriors(data, offsets)
                copies = copies_of(own.rates(posterior), part.column(names.index("doc_id")))
                for k in range(1, int(copies.max(initial=0)) + 1):
                    yield part.filter(pa.array(copies >= k))

    return docs.mapInArrow(rows, docs.schema)
