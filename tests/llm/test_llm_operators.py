"""The operators against brute force on small tables with nulls, empty, long and repeated rows and clashing column names."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import embeddings, exact_dedup, jaccard, language, lines, mixing, pieces, secrets, substrings, warc
from tallymark.llm.common import materialize
from tallymark.llm.queries import ANCHOR, WEIGHTS, domains, piece_model

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, row long, key string, best string, size long"
BLANK = re.compile(r"[\x20\x09-\x0D]")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def table(spark, rows):
    """(doc_id, text) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "k", "b", 3) for i, t in rows], SCHEMA)


WORDS = [w + s for w in ("alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta") for s in ("", "s", "ed", ",")]


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 25, 60, 120]))) for _ in range(8)]
    rows: list[tuple[int | None, str | None]] = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "one two three")]
    for i in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if rng.random() < 0.3:
            words += rng.choice(base).split(" ")[:40]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [rows[7], (None, base[0]), (2000, "x y z " * 400)]
    rng.shuffle(rows)
    return rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_dedup(spark, seed):
    rows = [*corpus(seed), (-(2**63), "far ids"), (2**63 - 1, "far  ids"), (-(2**63), "low"), (2**63 - 1, "high")]
    got = exact_dedup.exact_dedup(table(spark, rows).repartition(9), fan_in=2).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0))
    for r in got:
        group = next(g for k, g in groups.items() if sha(k) == r.text_sha256)
        best = min(group)
        assert r.group_size == len(group) and r.keep_id == (None if best[1] else best[2])
    assert sum(r.kept for r in got) == len(groups)


def test_keep_distinct_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "ab"), (None, "q"), (None, "q"), (3, None), (4, "")]
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in exact_dedup.keep_distinct(table(spark, rows)).collect())
    assert got == sorted([(False, 1, "a b"), (False, 1, "c"), (True, None, "q"), (False, 3, None)])


def test_keep_distinct_keeps_the_longest_of_a_repeated_id(spark):
    """The same id with texts of different lengths; columns of types that have no order."""
    rows = [(1, "ab", {"k": 1}), (1, "ab   ", {"k": 2}), (1, "a b", None), (2, "abc", {"k": 3}), (2, "other", {}), (None, "ab", {"k": 4}), (3, "q", {"x": 1}), (3, "q", {"x": 1}), (3, "q", {"x": 2})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").withColumn("a.b", F.lit(1))
    got = exact_dedup.keep_distinct(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "ab   "), (2, "abc"), (2, "other"), (3, "q")]
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 4


@pytest.mark.parametrize(("crowd", "open_pairs"), [(2048, 4), (3, 0)])
def test_jaccard_join(spark, monkeypatch, crowd, open_pairs):
    """Also with lists that are dealt out in blocks and that give their best pairs first."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", open_pairs)
    rows = corpus(3, 120)
    got = {r.doc_id: r for r in jaccard.jaccard_join(table(spark, rows)).collect()}
    sets = {}
    for i, t in rows:
        w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {i: (got[i].n_shingles, got[i].component_id) for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}
    assert got[None].component_id is None and got[None].n_shingles == len(sets[None])


def test_linked_sets_share_a_prefix_shingle_for_certain():
    """Sets that differ in their first shingles alone: what a shortened prefix would miss."""
    shingles = np.sort(np.random.default_rng(6).integers(0, 1 << 62, 4000)).astype(np.uint64)
    for common in (np.zeros(0, np.uint64), shingles[1000::7]):
        order = np.concatenate([s for s in (shingles[~np.isin(shingles, common)], shingles[np.isin(shingles, common)])])
        a, b = np.sort(order[: 2000]), np.sort(order[500:2000])  # 1500 of 2000: similarity 0.75
        keys = [set(np.concatenate(jaccard.prefix(s, common)).tolist()) for s in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("remembered", [200_000, 1])
def test_repeated_lists_lose_no_pair(monkeypatch, remembered):
    monkeypatch.setattr(jaccard, "SEEN_LISTS", remembered)
    rng = np.random.default_rng(7)
    rows = sorted((int(k), int(d)) for k, d in zip(rng.integers(-40, 40, 300), rng.integers(0, 60, 300), strict=True))
    rows += [(100 + k, d) for k in range(30) for d in (1, 2, 3)] + [(200, 9), (201, 9), (201, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 7]], pa.int64()) for c in (0, 1)], names=["key", "doc_id"]) for i in range(0, len(rows), 7)]

    def pairs(found):
        lists = {}
        for k, d in found:
            lists.setdefault(k, set()).add(d)
        return {(a, b) for ds in lists.values() for a in ds for b in ds if a < b}

    got = [(k, d) for b in jaccard.repeated_lists(iter(batches)) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert pairs(got) == pairs(rows)
    assert remembered == 1 or len(got) < len(set(rows)) - 80
    assert sum(b.num_rows for b in jaccard.repeated_lists(iter([]))) == 0


@pytest.mark.parametrize("most", [90, 900])
def test_count_tree_gives_every_pair_that_may_link(most):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(20, most)).astype(np.uint64)) for _ in range(40)]
    for k in range(160):
        s = sets[rng.integers(0, 40)].copy()
        s[rng.integers(0, len(s), rng.integers(0, 12))] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    found = set()
    for a, b, _ in jaccard.list_pairs(np.arange(len(sets)), sizes, [jaccard.count_vector(s) for s in sets]):
        found |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            overlap = len(np.intersect1d(sets[a], sets[b]))
            if 175 * overlap >= 75 * (sizes[a] + sizes[b]):
                assert (b, a) in found


@pytest.mark.parametrize(("crowded", "parts"), [(2000, 1), (3, 5)])
def test_substring_dedup(spark, monkeypatch, crowded, parts):
    monkeypatch.setattr(substrings, "MOST_SEGMENTS", crowded)
    rows = corpus(4, 90)
    rows += [(3000, "loop the loop " * 60), (3001, "loop the loop " * 9), (-5, dict(rows)[8])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(table(spark, rows).repartition(parts)).collect()}
    seen, expected = set(), {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        w, gone = words_of(t), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        expected[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    nulls = words_of(dict(rows)[None])
    expected[None] = (len(nulls), 0, sha(" ".join(nulls)))
    assert got == expected


def test_suffix_automaton_matches():
    rng = random.Random(2)
    known = substrings.SuffixAutomaton()
    added = []
    for _ in range(6):
        s = [rng.choice([b"a", b"b", b"c"]) for _ in range(30)]
        known.add(s)
        added.append(s)
    query = [rng.choice([b"a", b"b", b"c"]) for _ in range(60)]
    for at, (size, _) in enumerate(known.matches(query)):
        longest = max(k for k in range(at + 2) if k == 0 or any(query[at + 1 - k : at + 1] == s[j : j + k] for s in added for j in range(len(s))))
        assert size == longest


def test_suffix_automaton_knows_first_places():
    """Pieces of few words, added in order: each window's first place is that of a plain search."""
    rng = random.Random(3)
    known, seen = substrings.SuffixAutomaton(), {}
    for doc in range(12):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.choice([20, 30, 45]))] if doc % 4 else [b"a", b"b", b"b"] * 12
        known.add(words, doc, 7)
        for k in range(len(words) - 19):
            seen.setdefault(tuple(words[k : k + 20]), (doc, 7 + k))
        assert known.first_places(words) == [seen[tuple(words[k : k + 20])] for k in range(len(words) - 19)]
    assert known.first_places([b"c"] * 21) == [None, None]


def within_one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return a == b
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


@pytest.mark.parametrize(("seed", "least"), [(1, lines.LEAST_CHARS), (2, 16), (3, 1)])
def test_line_dedup(spark, seed, least):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cé") for _ in range(rng.choice([5, 7, 8, 9, 15, 16, 17, 30, 300]))) for _ in range(20)]

    def edited(s):
        s = list(s)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "x", "é"])
        return "".join(s)

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(1, 10)))) for i in range(80)] + [(900, None), (901, ""), (902, "\n \n"), (None, base[0])]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in lines.dedup_lines(table(spark, [*rows, rows[3]]), least).collect()}
    seen, expected = [], {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kept, own = [], (t.split("\n") if t else [])
        for line in own:
            body = line.strip(lines.BLANKS)
            if not body or not any(body == s or (min(len(body), len(s)) >= least and within_one_edit(body, s)) for s in seen):
                kept.append(line)
            if body:
                seen.append(body)
        expected[i] = (len(own), len(own) - len(kept), sha("\n".join(kept)))
    expected[None] = (1, 0, sha(base[0]))
    assert got == expected


def brute_spans(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.PATTERNS.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(out)]


def test_secret_scan(spark):
    key = base64.b64encode(hashlib.sha256(b"k").digest()).decode().rstrip("=")
    texts = [
        None, "", "nothing here", "password = hunter2secret", "token=secret: abcdefghij", "é token: 'ABCDEFGH12345678' x", "api_key=abc API-KEY=abcdefghi",
        "AKIAABCDEFGHIJKL and AKIAABC", "a" * 31 + " " + "0123456789abcdef" * 2, f"see {key} there", "internationalization_of_everything", "password=" * 40 + "abcdefgh",
        "deadbeef" * 4 + " apikey : \"deadbeefdeadbeefdeadbeefdeadbeef\"", "😀" * 5 + " secret=abcdefgh12 " * 300,
    ]
    docs = table(spark, list(enumerate(texts)) + [(3, texts[3])])
    plain = table(spark, [(i, "the quick brown fox jumps over internationalization and_identifiers " * 5) for i in range(40)])
    model = materialize(secrets.train(secrets.random_tokens(docs), secrets.ordinary_tokens(plain)), "model")
    got = secrets.find_secrets(docs, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(",".join(base))
        assert set(base) <= set(filter(None, r.spans.split(",")))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign:", "access:", "hex:"))
    added = {r.doc_id: r.n_random for r in got}
    assert added[9] == 1 and added[10] == 0 and added[2] == 0
    ratios = model.first().ratios
    for r in got:
        assert set(r.spans.split(",")) - set(brute_spans(texts[r.doc_id] or "")) - {""} == set(brute_random(texts[r.doc_id] or "", ratios))


def brute_random(text, ratios, least_bits=20.0, bits_per_char=0.5):
    """Tokens that a random model explains better, by a walk over their characters."""
    out, n = [], len(secrets.ALPHABET)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        pairs = [secrets.ALPHABET.index(a) * n + secrets.ALPHABET.index(b) for a, b in zip(m[0], m[0][1:], strict=False)]
        bits = max(sum(x[i] for i in pairs) for x in ratios)
        if len(m[0]) >= 20 and bits >= least_bits and bits >= bits_per_char * len(m[0]):
            out.append(f"random:{m.start()}:{m.end()}")
    return out


def test_secret_scan_of_a_very_long_text(spark):
    """Thousands of hits in one text, with ordinary and random tokens in between."""
    keys = [base64.b64encode(hashlib.sha256(str(k).encode()).digest()).decode() for k in range(3000)]
    text = " ".join(f"token={k[:12]} {hashlib.md5(k.encode()).hexdigest()} {k} é and_some_identifiers_of_the_ordinary_kind" for k in keys)
    docs = table(spark, [(1, text), (2, "AKIAABCDEFGHIJKL " * 5000)])
    plain = table(spark, [(i, "and_some_identifiers_of_the_ordinary_kind the quick brown fox jumps over it " * 5) for i in range(40)])
    model = materialize(secrets.train(secrets.random_tokens(docs), secrets.ordinary_tokens(plain)), "model")
    got = {r.doc_id: r for r in secrets.find_secrets(docs, model).collect()}
    base = brute_spans(text)
    assert got[1].base_sha256 == sha(",".join(base)) and (got[1].n_assign, got[1].n_hex, got[2].n_access) == (3000, 3000, 5000)
    assert set(got[1].spans.split(",")) == set(base) | set(brute_random(text, model.first().ratios))


@pytest.mark.parametrize("text", ["PASSWORD=hunter2secret", "PASSWD: Abcdefgh12", "PassWord = 'hunter2secret'", "passWD:abcdefgh", "API_KEY=abcdefgh1", "ApiKey: abcdefgh1", "SECRET\"  = abcdefgh", "my TOKEN=abcdefgh"])
def test_secret_scan_takes_keywords_in_either_case(spark, text):
    """A text whose only assignment is in upper or mixed case passes the gate too."""
    rows = spark.createDataFrame([(text,)], "text string")
    got = rows.select(secrets.spans(F.col("text"), "assign", *secrets.PATTERNS["assign"])).first()[0]
    assert [f"assign:{s.start}:{s.end}" for s in got] == [s for s in brute_spans(text) if s.startswith("assign:")] != []


def test_pieces_agree_with_the_library(spark):
    own = pieces.MergeCodec(piece_model(), cache_limit=50)
    rng = random.Random(1)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", ".", ",", "é", "▁", "中", "😀", "<s>", "\t", "0", "_", "'", "­"]
    texts = ["", " ", "   ", "a", "▁", " a  b ", "x" * 200, "the " * 50] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    for t in texts:
        ids = own.encode(t)
        assert ids == own.library.encode(t, add_eos=True), repr(t)
        assert own.decode(ids) == own.library.decode(ids)
    docs = table(spark, [*enumerate(texts), (999, None)])
    got = {r.doc_id: r for r in pieces.encode_documents(docs, piece_model()).collect()}
    assert got[999].n_tokens == got[0].n_tokens == 1
    back = {r.doc_id: r.text for r in pieces.decode_ids(pieces.token_ids(docs, piece_model()), piece_model()).collect()}
    assert back[4] == "a" if texts[4] == "a" else True
    assert all(sha(back[i]) == got[i].decoded_sha256 for i in back)


def test_new_words_merge_side_by_side(monkeypatch):
    """Thousands of new words need no agenda of their own, and the columns give what each agenda gives, also where scores are equal."""
    own = pieces.MergeCodec(piece_model())
    agenda, calls = own.merge, []
    monkeypatch.setattr(own, "merge", lambda chunk: calls.append(chunk) or agenda(chunk))
    rng = random.Random(4)
    bits = ["th", "ing", "e", "é", "ß", ".", ",\n", "0", "&&&", "Sch", "qu", "'", "x", "\0", "▁"]
    words = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    assert own.encode_all(texts) == own.library.encode(texts, add_eos=True)
    assert len(calls) < 300, "each new word has an agenda of its own"
    odd = ["中" + w for w in words[:500]] + [w * 9 for w in words[:200]]  # characters that are no piece, long words
    assert own.encode_all([" ".join(odd)]) == own.library.encode([" ".join(odd)], add_eos=True)
    own.rank = {piece: k // 50 for piece, k in own.rank.items()}  # ranks shared by many
    own._number_pairs()
    own.cache.clear(), own.inner.clear()
    own.encode_all(texts)
    assert len(own.cache) > 4000 and all(list(ids) == agenda(pieces.SPACE + w) for w, ids in own.cache.items())


def ppm_bits(text: bytes, counts: dict[bytes, dict[int, int]]) -> float:
    """The definition, byte by byte."""
    total, padded = 0.0, b"\n" * language.ORDER + text
    for k in range(language.ORDER, len(padded)):
        cost, order = 0.0, language.ORDER
        while order >= 0:
            seen = counts.get(padded[k - order : k])
            if seen:
                n, kinds = sum(seen.values()), len(seen)
                if padded[k] in seen:
                    cost += np.log2((n + kinds) / seen[padded[k]])
                    break
                cost += np.log2((n + kinds) / kinds)
            order -= 1
        total += cost if order >= 0 else cost + 8.0
    return total


def test_language_code_lengths_are_those_of_the_definition(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "le chat et la souris é", "fr"), (3, "an other thing", "en"), (4, None, "en"), (5, "x", None)]
    trees = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.langs == ["en", "fr"]
    for lang in trees.langs:
        counts: dict[bytes, dict[int, int]] = {}
        for _, t, own in rows:
            if t and own == lang:
                padded = b"\n" * language.ORDER + t.encode()
                for k in range(language.ORDER, len(padded)):
                    for order in range(language.ORDER + 1):
                        seen = counts.setdefault(padded[k - order : k], {})
                        seen[padded[k]] = seen.get(padded[k], 0) + 1
        texts = ["the hat", "la souris", "zzz qq", "é", "", "a"]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        got = trees.bits(data, offsets)[:, trees.langs.index(lang)]
        assert np.allclose(got, [ppm_bits(t.encode(), counts) for t in texts])
    docs = table(spark, [(1, "the hat"), (2, "la souris"), (3, "12 34"), (4, None), (5, ""), (6, "the hat"), (None, "the cat")])
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, trees).collect()}
    assert {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "en")} == got
    kept = language.keep_identified(docs, trees)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 6]
    nothing = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language.train(docs.where(~language.held_out()))
    got = language.identify(docs, trees).join(docs.where(language.held_out()).select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n > 0.97


def test_mixing_meets_its_targets(spark):
    rng = random.Random(3)
    kinds = {"a": "red green blue", "b": "one two three", "c": "sun moon stars"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randrange(5, 60)))) for i, k in enumerate(rng.choices("abc", [6, 3, 1], k=300))]
    labelled = spark.createDataFrame([(i, next(k for k, w in kinds.items() if t.split()[0] in w)) for i, t in rows[:150]] + [(1, None), (None, "a"), (99999, "b")], "doc_id long, domain string")
    docs = table(spark, [*rows, (500, None), (501, ""), (None, "red sun")])
    model = mixing.learn(docs, labelled)
    shares = materialize(mixing.classify(docs, model), "shares")
    fitted = mixing.fit(shares, model, {"a": 1, "b": 1, "c": 1})
    assert np.all(np.abs(fitted.reached - fitted.target) <= 0.002 * fitted.target.sum())
    got = mixing.rate_rows(shares, fitted).collect()
    assert len(got) == len(rows) + 3 and all(r.rate >= 0 for r in got)
    again = mixing.rate_rows(shares, fitted).collect()
    assert [(r.doc_id, r.copies) for r in got] == [(r.doc_id, r.copies) for r in again]
    mixed = mixing.apply_mix(docs, labelled, {"a": 1, "b": 1, "c": 1})
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    free = mixing.mix_rates(docs, labelled.where("false"), {"a": 1}).collect()
    assert all(r.rate == 1 for r in free)


def test_mixing_comes_as_close_as_nonnegative_rates_allow(spark):
    """A domain that shall vanish though every document has some share of it: no round cap ends the fit before the optimum."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = mixing.learn(docs, domains(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    shares = materialize(mixing.classify(docs, model), "shares")
    fitted = mixing.fit(shares, model, WEIGHTS, ANCHOR)
    rows = shares.collect()
    tokens, posterior = np.array([float(r.tokens) for r in rows]), np.array([r.posterior for r in rows])
    have = posterior.T @ tokens
    rate = np.ones(len(rows))
    for _ in range(5000):
        rate = np.maximum(rate - posterior @ ((posterior.T @ (rate * tokens) - fitted.target) / have), 0)
    plain = posterior.T @ (rate * tokens)
    assert np.allclose(posterior.T @ (fitted.rates(posterior) * tokens), fitted.reached)
    assert (np.abs(fitted.reached - fitted.target) <= np.abs(plain - fitted.target) + 1e-3 * have).all()


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = centres[rng.integers(0, 12)] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.35, 2.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2)) if i % 17 else None))
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [1.0, None] + [0.0] * 14, 1), (404, [float("nan")] * 16, 0), (405, [float("inf")] * 16, 0), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit("x")).withColumn("size", F.lit(1))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    unit = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = (label, len(v), np.array(v, float) / np.linalg.norm(np.array(v, float)))
    links = {i: {j for j in unit if j != i and unit[i][:2] == unit[j][:2] and float(unit[i][2] @ unit[j][2]) >= 0.93} for i in unit}
    total, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert 0.9 * total <= found <= total
    assert all(got[i].n_links <= len(links.get(i, ())) for i in got)
    assert got[407].component_id == 406 and got[402].component_id == 402 and not got[407].kept


def test_embedding_doubles_labels_and_copies(spark):
    """Doubles are compared as they are, labels may be of any type, equal vectors count as often as they stand."""
    close = 0.93 + 3e-10
    rows = [(1, [1.0, 0.0], "a"), (2, [close, float(np.sqrt(1 - close**2))], "a"), (3, [1e300, 0.0], "b"), (4, [1.0, 0.0], "b"), (5, [1e-300, 0.0], "b"), (6, [1.0, 0.0], None)]
    rows += [(10 + k, [0.0, 1.0, 1.0], "c") for k in range(5)] + [(10, [0.0, 1.0, 1.0], "c"), (20, [0.0, 1.0, 1.1], "c"), (None, [1.0, 0.0], "a"), (-(2**63), [5.0], "d"), (2**63 - 1, [7.0], "d")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got[1] == got[2] == (1, 1) and got[6] == (0, 6) and got[None] == (0, None)
    assert {got[k] for k in (3, 4, 5)} == {(2, 3)} and got[2**63 - 1] == (1, -(2**63))
    assert got[10] == (10, 10) and got[11] == (6, 10) and got[20] == (6, 10)  # the row of 10 stands twice: 5 others each time


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_embedding_recall_in_a_dense_group(spark, share):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 32))
    dense = int(share * len(v))
    v[:dense] = rng.normal(size=32) + rng.normal(size=(dense, 32)) * 0.2
    v[dense + 1 :: 2] = v[dense:-1:2][: len(v[dense + 1 :: 2])] + rng.normal(size=(len(v[dense + 1 :: 2]), 32)) * 0.25
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum() - len(v)
    found = sum(r.n_links for r in embeddings.near_duplicates(df).collect())
    assert 0.9 * want <= found <= want and want > 300


def test_embedding_recall_on_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    total = 0
    for label in {r.label for r in rows}:
        own = [r for r in rows if r.label == label]
        u = np.array([r.embedding for r in own], float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        n = (u @ u.T >= 0.93).sum(axis=1) - 1
        total += n.sum()
        assert all(got[r.vec_id] <= k for r, k in zip(own, n, strict=True))
    assert sum(got.values()) >= 0.9 * total


def test_language_tables_hold_any_number_of_languages(spark, monkeypatch):
    """More languages than a table holds, and texts longer than a step: the same code lengths as in one table at once."""
    rng = random.Random(9)
    own = {f"l{k:02}": [rng.choice("abcdefghé ") for _ in range(6)] for k in range(70)}
    rows = [(i, "".join(rng.choice(own[x]) for _ in range(120)), x) for i, x in enumerate(sorted(own) * 3)]
    forest = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert forest.langs == sorted(own) and len(forest.tables) == 2
    data = np.frombuffer("".join(t for _, t, _ in rows[:40]).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for _, t, _ in rows[:20]), 0, *(len(t.encode()) for _, t, _ in rows[20:40])])
    whole = forest.bits(data, offsets)
    monkeypatch.setattr(language, "STEP_CELLS", 64 * 37)
    assert np.allclose(forest.bits(data, offsets), whole) and whole.shape == (41, 70) and not whole[20].any()


def test_rates_against_brute_force(spark):
    """Posteriors by plain counting and rates by plain projected gradient, for more domains than former models held."""
    rng = random.Random(12)
    names = [f"d{k:03}" for k in range(70)]
    words = {d: [f"{d}w{j}" for j in range(3)] + ["both", "all", "every"] for d in names}
    docs = [(i, " ".join(rng.choice(words[d]) for _ in range(rng.choice([5, 12, 30])))) for i, d in enumerate(names * 14)]
    labels = [(i, names[i % 70]) for i in range(0, len(docs))]
    weights = {d: 1.0 + (k % 5) for k, d in enumerate(names)}
    got = {r.doc_id: r for r in mixing.mix_rates(table(spark, docs), spark.createDataFrame(labels, "doc_id long, domain string"), weights).collect()}
    model = mixing.learn(table(spark, docs), spark.createDataFrame(labels, "doc_id long, domain string"))
    assert model.domains == names
    bucket = lambda w: int(mixing.features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])
    sets = [{bucket(w) for w in set(t.split())} for _, t in docs]
    share = {b: np.array([sum(b in sets[i] for i in range(k, len(docs), 70)) for k in range(70)]) for b in set().union(*sets)}
    assert set(model.buckets.tolist()) <= set(share) and len(model.buckets) >= 200  # less what shares a bucket
    odds = {}
    for b in model.buckets.tolist():
        pooled = share[b].sum() / len(docs)
        p = np.clip((share[b] + 2 * pooled) / (14 + 2), 1e-6, 1 - 1e-6)
        odds[b] = np.log(p), np.log(1 - p)
    posterior = np.array([sum(odds[b][0] if b in s else odds[b][1] for b in odds) for s in sets])
    posterior = np.exp(posterior - posterior.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    tokens = np.array([len(t.split()) for _, t in docs], float)
    have = posterior.T @ tokens
    target = np.array([weights[d] for d in names])
    target *= tokens.sum() / target.sum()
    rate = np.ones(len(docs))
    for _ in range(4000):
        rate = np.maximum(rate - 0.5 * posterior @ ((posterior.T @ (rate * tokens) - target) / have), 0)
    mine = np.array([got[i].rate for i, _ in docs])
    assert [got[i].domain for i, _ in docs] == [names[k] for k in posterior.argmax(axis=1)]
    assert np.allclose(posterior.T @ (rate * tokens), target, rtol=1e-2) and np.allclose(posterior.T @ (mine * tokens), target, rtol=1e-2)
    assert (mine >= 0).all() and np.corrcoef(mine, rate)[0, 1] > 0.99


def test_warc_shards_are_even_whatever_the_ids(spark, tmp_path):
    """Far apart, least, greatest and missing ids: shards of about equal bytes, in the order of the ids."""
    rows = [(i, f"u{i}", "x" * 500 + str(i)) for i in range(2000)] + [(10**15, "far", "y"), (-(2**63), "least", "z"), (2**63 - 1, "most", "w")] + [(None, f"n{i}", f"no id {i}" * 20) for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    folder = str(tmp_path / "even")
    manifest = warc.write_archives(pages, folder, shard_bytes=50_000)
    shards = {}
    for m in manifest.collect():
        shards.setdefault(m.file.split("-")[1], []).append(m.records)
    assert 20 <= len(shards) <= 40 and max(map(sum, shards.values())) <= 400
    ordered = [m.last_id for m in sorted(manifest.collect(), key=lambda m: m.file) if m.first_id is not None]
    assert ordered == sorted(ordered) and ordered[-1] == 2**63 - 1
    got = warc.read_archives(manifest, folder).collect()
    assert sorted((r.page_id or 0, r.url, bytes(r.payload).decode()) for r in got) == sorted((i or 0, u, h) for i, u, h in rows)


@pytest.mark.parametrize("urls", [3000, 1, 7])
def test_warc_spreads_equal_pages(spark, tmp_path, urls):
    """Thousands of rows with no id and one payload, and of one id and one payload: even shards, one response of an id."""
    body = "".join(random.Random(1).choices("abcdefgh ", k=2000))
    rows = [(None, f"u{k % urls}", body) for k in range(3000)] + [(7, f"v{k % urls}", body + "!") for k in range(3000)] + [(5, "w", body + "!"), (9, "x", body + "?"), (9, "y", body + "?")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifest = warc.write_archives(pages, str(tmp_path / "a"), shard_bytes=100_000)
    shards = {}
    for m in manifest.collect():
        shards[m.file.split("-")[1]] = shards.get(m.file.split("-")[1], 0) + m.records
    assert sum(shards.values()) == len(rows) and max(shards.values()) <= 200 and len(shards) > 50
    got = warc.read_archives(manifest, str(tmp_path / "a")).collect()
    assert sorted((r.page_id or 0, r.url) for r in got) == sorted((i or 0, u) for i, u, _ in rows)
    by = lambda i: [r for r in got if r.page_id == i]
    assert all(r.record_type == "response" and bytes(r.payload).decode() == body for r in by(None))
    assert all((r.record_type, r.refers_to, r.payload_bytes) == ("revisit", 5, 2001) for r in by(7)) and by(5)[0].record_type == "response"
    assert sorted((r.record_type, r.refers_to) for r in by(9)) == [("response", None), ("revisit", 9)]
    alone = spark.createDataFrame([(3, f"v{k % urls}", body) for k in range(3000)], "page_id long, url string, html string")
    written = warc.write_archives(alone.repartition(3), str(tmp_path / "b"), shard_bytes=100_000)
    mine = warc.read_archives(written, str(tmp_path / "b")).groupBy("record_type", "refers_to").count().collect()
    assert sorted(map(tuple, mine), key=str) == [("response", None, 1), ("revisit", 3, 2999)]
    again = warc.write_archives(alone.repartition(8), str(tmp_path / "c"), shard_bytes=100_000)
    assert sorted((m.file, m.sha256) for m in written.collect()) == sorted((m.file, m.sha256) for m in again.collect())


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, None), (2, "u\r\nX: y", ""), (7, "http://c/", "x" * 300_000), (7, "http://c/", "x" * 300_000), (None, "n", "<p>é</p>"), (11, "http://d/", "solo"), (12, "e", "a\r\n\r\nb\x00")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("note", F.lit(True)).repartition(3)
    folder = str(tmp_path / "one")
    manifest = warc.write_archives(pages, folder, shard_bytes=100_000, roll_bytes=400)
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows) and manifest.count() > 2
    want = {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows}
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == want
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(5, "revisit", 3), (3, "response", None), (9, "revisit", 2), (2, "response", None), (7, "response", None), (7, "revisit", 7), (0, "revisit", 3), (11, "response", None), (12, "response", None)])
    payload = {r.page_id: bytes(r.payload) for r in got if r.payload is not None}
    assert payload[12] == b"a\r\n\r\nb\x00" and payload[3] == "<p>é</p>".encode()
    other = str(tmp_path / "two")
    again = warc.write_archives(pages.repartition(2), other, shard_bytes=100_000, roll_bytes=400)
    digests = lambda m: sorted((r.file, r.sha256) for r in m.collect())
    assert digests(manifest) == digests(again)
    assert {p.name for p in (tmp_path / "one").iterdir()} == {r.file for r in manifest.collect()}
    large = warc.read_archives(warc.write_archives(pages, str(tmp_path / "three"), least_bytes=100), str(tmp_path / "three"))
    assert {r.page_id for r in large.where("record_type = 'revisit'").collect()} == {7}


def test_texts_of_megabytes(spark):
    """A text of some megabytes, the same with a changed word, and a short one, through every operator on documents."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    body = [rng.choice(words) for _ in range(300_000)]
    other = [*body[:150_000], "changedword", *body[150_001:]]
    text = lambda w: "\n".join(" ".join(w[k : k + 10]) for k in range(0, len(w), 10))
    docs = table(spark, [(1, text(body)), (2, text(other)), (3, "a short text of a few words only")]).repartition(2)
    plain = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert plain[1].text_sha256 == sha("".join(body)) and all(r.group_size == 1 for r in plain.values())
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert (kept[1].n_removed, kept[2].n_removed) == (0, len(body) - 1) and kept[2].kept_sha256 == sha("changedword")
    by_line = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert (by_line[1].n_removed, by_line[2].n_removed, by_line[2].n_lines) == (0, 29_999, 30_000)
    trees = language.train(spark.createDataFrame([(1, text(words), "x"), (2, "1234 5678 0123", "digits")], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, trees).collect()} == dict.fromkeys((1, 2, 3), "x")
    own = pieces.MergeCodec(piece_model())
    assert {r.doc_id: r.n_tokens for r in pieces.encode_documents(docs, piece_model()).collect()}[2] == len(own.library.encode(text(other), add_eos=True))


def test_empty_tables(spark):
    docs = table(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, domain string")
    model = secrets.train(secrets.random_tokens(docs, 10), secrets.ordinary_tokens(docs))
    import uuid

    folder = f"/tmp/tallymark-test-{uuid.uuid4().hex}"
    for out in (
        exact_dedup.exact_dedup(docs), exact_dedup.keep_distinct(docs), jaccard.jaccard_join(docs), jaccard.keep_one_each(docs), substrings.remove_repeats(docs), lines.dedup_lines(docs),
        secrets.find_secrets(docs, model), pieces.encode_documents(docs, piece_model()), language.identify(docs, language.train(docs)), mixing.mix_rates(docs, labels, {"a": 1}),
        mixing.apply_mix(docs, labels, {"a": 1}), embeddings.near_duplicates(vectors), warc.read_archives(warc.write_archives(pages, folder), folder),
    ):
        assert out.count() == 0
