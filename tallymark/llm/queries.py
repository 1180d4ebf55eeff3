"""Driver queries of the operators: each applies one to its whole table."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, exact_dedup, infill, jaccard, language, lines, mixing, personal, pieces, runs, secrets, substrings, warc
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


#: Shares of the tokens that a mixture shall have. Toxic documents get none.
WEIGHTS = {"good": 0.9, "poor": 0.1}
ANCHOR = "good"  # keeps what it has


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents: toxic, else good or poor."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), WEIGHTS, ANCHOR)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language.train(docs.where(~language.held_out()))
    out = language.identify(docs, trees)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.random_tokens(docs), secrets.ordinary_tokens(docs))
    return secrets.find_secrets(docs, model)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"), folder)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*personal.BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_min(F.transform("spans", lambda s: s["score"])).alias("least_score"))


def tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten gets a periodic tail, so that runs of every length occur: which, from where and with what
    period follows from a checksum of its id."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(table(spark, sf_dir, "documents"), rearrange=tail_repeated)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        out.withColumn("longest", longest)
        .withColumn("length", -F.col("longest.short"))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            F.col("longest.start").alias("start"),
            "length",
            F.col("longest.period").alias("period"),
            F.expr("(1000 * length) div longest.period").alias("exponent_milli"),
            F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_mixing, op3_embedding_dedup, op4_language_id, op5_sentencepiece, op6_substring_dedup, op7_secret_scan, op8_jaccard_join, op9_line_dedup, op10_warc,
        op11_fill_in_middle, op12_personal_data, op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        b AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM b
    """,
    "op10_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
        o AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS owner,
                     (SELECT string_agg(substr('0123456789abcdef', i, 1), '') FROM range(1, 17) t(i)) AS hexes FROM p)
        SELECT page_id, octet_length(payload) AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST(floor((instr(hexes, substr(digest, (k * 5) // 4 + 1, 1)) * 16
                        + instr(hexes, substr(digest || '0', (k * 5) // 4 + 2, 1)) - 17)
                        / power(2, 3 - (k * 5) % 4)) AS BIGINT) % 32, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> owner THEN owner END AS refers_to
        FROM o
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   list_transform(range(4), lambda k: CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * k + 1, 8) AS BIGINT)) AS h
            FROM documents),
        f AS (
            SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                           WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                   least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b
            FROM d),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
        SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
    "op13_periodic_runs": r"""
        WITH crc AS (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c
            FROM range(256) t(i)),
        tab AS (SELECT list(c ORDER BY i) AS tab FROM crc),
        w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                   xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(coalesce(CAST(doc_id AS VARCHAR), ''), '.'), lambda s: CAST(ascii(s) AS BIGINT))),
                       lambda x, b: xor(x // 256, tab[1 + xor(x, b) % 256]))) AS h
            FROM documents, tab),
        g AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
        v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM p),
        grams AS (SELECT doc_id, i, hash(ws[i + 1:i + 6]) AS k FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM v)),
        same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
        islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
        found AS (SELECT doc_id, min(i) AS start, count(*) + 5 + q AS length, q FROM islands GROUP BY doc_id, q, island),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM found WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
        sums AS (
            SELECT doc_id, count(*) AS n_runs, first(r ORDER BY length DESC, start, period) AS longest,
                   string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS written
            FROM r GROUP BY doc_id),
        cut AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        word AS (SELECT doc_id, i, ws[i + 1] AS word FROM (SELECT doc_id, ws, unnest(range(n)) AS i FROM v)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
        SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, longest.start AS start, longest.length AS length, longest.period AS period,
               (1000 * longest.length) // longest.period AS exponent_milli, sha256(coalesce(written, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM v LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op3_embedding_dedup": r"""
        WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i AS start, sha256(array_to_string(ws[i:i + 19], ' ')) AS h
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
        rep AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS k FROM win) WHERE k > 1),
        word AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        marked AS (
            SELECT x.doc_id, x.i, x.ws[x.i] AS word, max(r.start) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS UNBOUNDED PRECEDING) AS latest
            FROM word x LEFT JOIN rep r ON r.doc_id = x.doc_id AND r.start = x.i),
        kept AS (
            SELECT doc_id, count(*) FILTER (WHERE latest > i - 20) AS n_removed,
                   string_agg(word, ' ' ORDER BY i) FILTER (WHERE latest IS NULL OR latest <= i - 20) AS kept
            FROM marked GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 175 * o.o >= 75 * (x.n + y.n)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
}
