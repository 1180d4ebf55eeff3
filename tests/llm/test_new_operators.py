"""Fill-in-middle, personal data and periodic runs against brute force: nulls, empty, long and repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import infill, personal, queries, runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, form string, runs string, spans string, start long, output string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def table(spark, rows):
    """(doc_id, text) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "f", "r", "s", 2, "o") for i, t in rows], SCHEMA)


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# ---- 11 ------------------------------------------------------------------------------------


def expected_infill(doc_id, text, rate=90, first=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_texts():
    rng = random.Random(11)
    rows = [(None, None), (None, "abc d"), (1, None), (2, ""), (3, "a"), (4, "é"), (5, "has <M> in it"), (6, "<S"), (7, "😀" * 900 + "x<P"), (-5, "a\u0000b c")]
    rows += [(100 + k, "".join(rng.choice(["ab", "Z", " ", "\n", "é", "ß", "日本", "😀", "<", "S>", "1"]) for _ in range(rng.choice([3, 40, 700])))) for k in range(120)]
    rows += [(300, "x" * 300_000), (301, "word é " * 60_000), (302, "é" * 200_000), rows[40], rows[40]]
    return rows


def test_fill_in_middle(spark):
    rows = infill_texts()
    out = infill.fill_in_middle(table(spark, rows).repartition(5))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *expected_infill(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(table(spark, rows[:1]).limit(0)).count() == 0


@pytest.mark.parametrize(("every", "block"), [(1, 3), (4, 5), (256, 1 << 16), (7, 64)])
def test_checkpoints_find_every_unit(every, block):
    for _, text in infill_texts()[:60]:
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
        index = infill.Checkpoints(np.frombuffer((text or "").encode(), np.uint8), every, block)
        assert index.units == len(units) and index.chars == len(text or "")
        assert len(index.numbers) == -(-len(units) // every)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.locate(k) == (len(before.encode()), len(before))


def test_fill_in_middle_shares_and_marks(spark):
    rows = [(i, "some words here") for i in range(300)]
    forms = lambda **kw: {r.form for r in infill.fill_in_middle(table(spark, rows), **kw).select("form").distinct().collect()}
    assert forms(plain_share=0, suffix_first_share=0) == {"psm"} and forms(plain_share=0, suffix_first_share=100) == {"spm"} and forms(plain_share=100) == {"plain"}
    marks = ("<|pre|>", "<|suf.*|>", "<|mid$1|>")
    out = infill.fill_in_middle(table(spark, rows), seed=9, marks=marks)
    assert out.where(infill.restored(F.col("output"), F.col("form"), marks) != "some words here").count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("abc", "b", "x")):
        with pytest.raises(ValueError, match="marks"):
            infill.fill_in_middle(table(spark, rows), marks=bad)


def test_op11_on_all_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_fill_in_middle(spark, SF).collect()}
    want = {}
    for i, t in docs.items():
        n, form, p, m, out = expected_infill(i, t)
        want[i] = (n, form, p, m, sha(out), sha(t or ""))
    assert got == want


# ---- 12 ------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    """The patterns as they are given, run plainly."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def with_luhn(rng, n):
    body = [rng.randrange(10) for _ in range(n - 1)]
    check = next(c for c in range(10) if personal.luhn("".join(map(str, [*body, c]))))
    return "".join(map(str, [*body, check]))


def iban(rng):
    body = "".join(str(rng.randrange(10)) for _ in range(18))
    return "DE" + next(f"{c:02d}" for c in range(2, 99) if personal.mod97(f"DE{c:02d}{body}")) + body


def personal_texts():
    rng = random.Random(12)
    pieces = ["a.b@c.de", "@x.y", "x@y", "a@b.c@d.e", "q@-.-", "1.2.3.4", "01.002.0255.9", "999.1.1.1.1", "1.2.3.4.5.6.7.8", "+1 (523) 555-1055", "+1--", "++49 30 123456789", "+1", "12 34", "😀", "é", "Ü", " ", ", ", "-", ".", "0" * 15, "5" * 25, "12345678-9", "+"]
    rows = [(None, None), (None, "x@y.z"), (1, None), (2, ""), (3, " "), (4, "@"), (5, "+"), (6, "1.2.3"), (7, "no data at all")]
    for k in range(250):
        parts = [rng.choice(pieces) for _ in range(rng.choice([2, 9, 40]))]
        for _ in range(rng.randrange(4)):
            number = with_luhn(rng, rng.randrange(12, 21))
            sep = rng.choice(["", " ", "-"])
            parts.insert(rng.randrange(len(parts)), sep.join(number[i : i + 4] for i in range(0, len(number), 4)))
        rows.append((10 + k, rng.choice(["", " ", "x"]).join(parts)))
    rows += [rows[20], rows[20], (900, "word a@b.cd 4111 1111 1111 1111 " * 3000)]
    return rows


def test_base_spans_of_personal_data(spark):
    rows = personal_texts()
    got = personal.find_personal(table(spark, rows).repartition(4)).collect()
    seen = sorted(((r.doc_id is None, r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans if s.kind in personal.BASE]) for r in got))
    assert seen == sorted((i is None, i or 0, base_spans(t)) for i, t in rows)
    texts = dict(rows)
    for r in got:
        for s in r.spans:
            assert 0 <= s.score <= 1 and (r.doc_id is None or s.value == texts[r.doc_id][s.start : s.end])
    assert all(any(s.kind == kind for r in got for s in r.spans) for kind in personal.BASE)


def test_added_spans_need_a_checksum_or_context():
    rng = random.Random(13)
    number = iban(rng)
    spaced = " ".join(number[i : i + 4] for i in range(0, 22, 4))
    kinds = lambda t: [(s["kind"], s["value"]) for s in personal.find_spans(t) if s["kind"] in personal.ADDED]
    assert kinds(f"pay to {number}.") == [("iban", number)] and kinds(f"pay to {spaced} BIC X") == [("iban", spaced)]
    wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
    assert kinds(f"account {wrong}") == [] and kinds(f"account X{number}") == [] and kinds(f"account {number}7") == []
    assert kinds(f"serial {number}") == []  # lowered by its context
    assert kinds("her SSN is 123-45-6789") == [("ssn", "123-45-6789")] and kinds("123-45-6789 of the part list") == []
    assert kinds("SSN 000-45-6789, 666-45-6789, 123-00-6789, 123-45-0000") == []
    assert kinds("routing no. 021000021") == [("routing", "021000021")] and kinds("routing no. 021000022") == [] and kinds("in all 021000021") == []
    assert personal.find_spans("call +1 (523) 555-1055")[0]["score"] > personal.find_spans("xxxx +1 (523) 555-1055")[0]["score"] > personal.find_spans("order +1 (523) 555-1055")[0]["score"]
    assert [s["kind"] for s in personal.find_spans("a@b.cd", kinds=("ip",))] == []


@pytest.mark.parametrize("text", ["1" * 400_000, "1 " * 200_000, "1." * 200_000, "a" * 400_000 + "@", "a@" * 200_000, "+1" * 200_000, "+1" + "(" * 400_000, "AB12" * 100_000, "A" * 400_000, "a@b." * 100_000, "a@b.c " * 60_000 + "SSN 123-45-6789 " * 20_000])
def test_personal_data_takes_linear_time(text):
    began = time.process_time()
    personal.find_spans(text)
    assert time.process_time() - began < 6


def test_op12_on_all_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op12_personal_data(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        spans, r = base_spans(t), got[i]
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in BASE)
        assert r.base_sha256 == sha(written) and r.spans.startswith(written)
    assert sum(r.n_card + r.n_phone + r.n_email for r in got.values()) > 0


# ---- 13 ------------------------------------------------------------------------------------


def expected_runs(words, least):
    """Every period, every maximal stretch of equal words that far apart; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k < len(words) - q:
            e = k
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            if e - k + q >= max(least, 2 * q):
                best.setdefault((k, e - k + q), q)
            k = e + 1
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, letters = rng.choice([0, 1, 2, 5, 20, 60, 150]), rng.choice([1, 2, 3, 5, 40])
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randrange(1, n + 1)
        words = [words[i] if i < a else words[a + (i - a) % min(p, n - a)] for i in range(n)]
    return words


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [2, 12])
def test_runs_against_all_periods(seed, least):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 8))]
        number = {}
        found = runs.runs_of([[number.setdefault(w, len(number)) for w in t] for t in texts], least)
        for words, got in zip(texts, found, strict=True):
            assert [tuple(r) for r in got.tolist()] == expected_runs(words, least)


def test_known_runs():
    def of(word, least=2):
        return [tuple(r) for r in runs.runs_of([[ord(c) for c in word]], least)[0].tolist()]

    assert of("mississippi") == [(1, 7, 3), (2, 2, 1), (5, 2, 1), (8, 2, 1)]
    assert of("aaaaaaaaaaaaa", 12) == [(0, 13, 1)] and of("") == [] and of("a") == []
    fibonacci = "abaababaabaababaababa"
    assert of(fibonacci) == expected_runs(fibonacci, 2)


@pytest.mark.parametrize("gather", [8, 1 << 20])
def test_runs_of_long_texts(monkeypatch, gather):
    """Nested periods over many blocks of the sparse table; also with direct comparisons in small pieces."""
    monkeypatch.setattr(runs, "GATHER", gather)
    rng = random.Random(3)
    inner = [rng.randrange(3) for _ in range(17)] * 4 + [rng.randrange(900) for _ in range(40)]
    text = [rng.randrange(900) for _ in range(300)] + inner * 9 + [5] * 30
    assert [tuple(r) for r in runs.runs_of([text])[0].tolist()] == expected_runs(text, 12)


def test_periodic_runs(spark):
    rng = random.Random(9)
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "a b " * 6), (6, "x " * 20 + "y " * 20), (7, "a b c d " * 4 + "z"), (None, "q\x0br " * 9), (8, "nb sp " * 13), (9, "long words " * 40_000)]
    rows += [(100 + k, rng.choice([" ", "  \n"]).join(random_words(rng))) for k in range(80)]
    rows += [rows[5], rows[5]]
    got = runs.periodic_runs(table(spark, rows).repartition(5)).collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = expected_runs(words, 12) if len(words) < 1000 else [(0, len(words), 2)]
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        want.append((i is None, i or 0, len(words), found, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert runs.periodic_runs(table(spark, rows[:1]).limit(0)).count() == 0


def test_op13_on_all_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if n > 2000:
            continue  # the brute force is quadratic; SQL checks the others at sf0.01
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = expected_runs(words, 12)
        some += len(found)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        written = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        assert got[i] == (len(found), *four, sha(written), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    assert some > 10
