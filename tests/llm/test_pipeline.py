"""The pipeline's stages against brute force on the smallest documents."""

from __future__ import annotations

import binascii
import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from tallymark.llm import mixing
from tallymark.llm.queries import ANCHOR, WEIGHTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """What each stage makes of the one before, written and read again as the driver does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def sets_of(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def test_stages_keep_the_columns(outputs):
    assert all(o.columns == outputs[0].columns for o in outputs[1:-1])


def test_language_stage_drops_only_what_has_no_language(outputs):
    before, after = ({r.doc_id: r.text for r in o.collect()} for o in outputs[:2])
    gone = set(before) - set(after)
    assert all(sum(map(str.isalpha, before[i] or "")) < 0.7 * len(re.sub(r"\s", "", before[i] or "x")) for i in gone)


def test_language_stage_against_brute_force(outputs):
    """Context counts and code lengths by the definition, a byte at a time: what keeps half of the probability stays."""
    rows, order = outputs[0].collect(), 3
    counts: dict[str, dict[bytes, Counter]] = {}
    for r in rows:
        if r.text and r.lang and binascii.crc32(str(r.doc_id).encode()) % 4 != 2:
            own, padded = counts.setdefault(r.lang, {}), b"\n" * order + r.text.encode()
            for k in range(order, len(padded)):
                for j in range(order + 1):
                    own.setdefault(padded[k - j : k], Counter())[padded[k]] += 1
    totals = {lang: {c: (sum(n.values()), len(n)) for c, n in own.items()} for lang, own in counts.items()}

    def bits(text, lang):
        own, sums, padded, out = counts[lang], totals[lang], b"\n" * order + text.encode(), 0.0
        for k in range(order, len(padded)):
            for j in (3, 2, 1, 0):
                context = padded[k - j : k]
                if context in own:
                    n, kinds = sums[context]
                    if padded[k] in own[context]:
                        out += np.log2((n + kinds) / own[context][padded[k]])
                        break
                    out += np.log2((n + kinds) / kinds)
            else:
                out += 8.0
        return out

    kept = set()
    for r in rows:
        if any(map(str.isalpha, r.text or "")):
            each = np.array([bits(r.text, lang) for lang in counts])
            if 1 / np.exp2(np.maximum(each.min() - each, -1000)).sum() >= 0.5:
                kept.add(r.doc_id)
    assert {r.doc_id for r in outputs[1].collect()} == kept


def test_mixture_stage_against_brute_force(spark, outputs):
    """Counts, posteriors and rates over plain arrays; each document as often as its rate and its own draw say."""
    rows = sorted(outputs[3].collect(), key=lambda r: r.doc_id)
    labels = {r.doc_id: "toxic" if r.toxic == 1 else "good" if r.quality == 1 else "poor" if r.quality == 0 else None for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = sorted({d for i, d in labels.items() if d and i in {r.doc_id for r in rows}})
    texts = [(r.text or "").encode() for r in rows]
    found = [mixing.features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    sets, tokens = [set(f[1].tolist()) for f in found], np.array([int(f[2][0]) for f in found], float)
    known = [(k, names.index(labels[r.doc_id])) for k, r in enumerate(rows) if labels.get(r.doc_id)]
    each = np.bincount([d for _, d in known], minlength=len(names)).astype(float)
    odds, prior = {}, np.log((each + 1) / (each + 1).sum())
    for b in set().union(*(sets[k] for k, _ in known)):
        have = np.bincount([d for k, d in known if b in sets[k]], minlength=len(names)).astype(float)
        rest, pooled = each.sum() - each, have.sum() / each.sum()
        z = np.abs(have / each - (have.sum() - have) / rest) / np.sqrt(pooled * (1 - pooled) * (1 / each + 1 / rest)) if pooled < 1 else np.zeros(len(names))
        if ((z >= max(5.0, 0.25 * np.sqrt(each.sum()))) & (np.maximum(have, pooled * each) >= 5)).any():
            p = np.clip((have + 2 * pooled) / (each + 2), 1e-6, 1 - 1e-6)
            odds[b] = np.log(p / (1 - p))
            prior = prior + np.log(1 - p)
    posterior = np.array([prior + sum((odds[b] for b in s if b in odds), np.zeros(len(names))) for s in sets])
    posterior = np.exp(posterior - posterior.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    have = posterior.T @ tokens
    weight = np.array([WEIGHTS.get(d, 0.0) for d in names])
    target = weight / weight.sum() * have[names.index(ANCHOR)] / (weight[names.index(ANCHOR)] / weight.sum())
    rate, carried, reached = np.ones(len(rows)), np.zeros(len(names)), have
    for _ in range(60):
        gap = (reached - target) / np.maximum(have, 1)
        if np.abs(gap).max() < 1e-3:
            break
        carried = gap + carried / 2
        rate = np.maximum(rate - posterior @ carried, 0)
        before, reached = reached, posterior.T @ (rate * tokens)
        if (np.abs(reached - before) / np.maximum(have, 1)).max() < 1e-4:
            break
    want = mixing.copies_of(rate, pa.array([r.doc_id for r in rows], pa.int64()))
    got = Counter(r.doc_id for r in outputs[4].collect())
    assert [got[r.doc_id] for r in rows] == want.tolist() and 0 < want.sum()


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).count() == 0


def test_exact_stage_keeps_one_of_each_text(outputs):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    before, after = outputs[1].collect(), outputs[2].collect()
    groups = {}
    for r in before:
        groups.setdefault(key(r.text), []).append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in after} == {min(g)[1] for g in groups.values()}


def test_near_stage_keeps_the_smallest_of_each_component(outputs):
    sets = sets_of(outputs[2].collect())
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    for _ in sets:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not changed:
            break
    assert {r.doc_id for r in outputs[3].collect()} == {i for i in low if low[i] == i}


def test_mixture_repeats_whole_documents(outputs):
    before = {r.doc_id: r for r in outputs[3].collect()}
    after = outputs[4].collect()
    assert after and all(before[r.doc_id] == r for r in after)


def test_encoding_covers_the_mixture(outputs):
    texts = {r.doc_id: r.text for r in outputs[4].collect()}
    rows = outputs[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in outputs[4].collect())
    plain = lambda t: hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()
    assert all(r.decoded_sha256 == plain(texts[r.doc_id]) for r in rows)


def test_registered_run_is_the_stages(spark, outputs):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(__spark_entry__.queries()["pipeline"](spark, SF)) == key(outputs[-1])
