"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a run: its distinct digests, each with its best row so far and a count. In every
round the runs of ``fan_in`` neighbours are merged under their common parent, which sorts and folds equal
digests again, until one run is left. That run stays spread over the cluster by digest. No step ever holds
more than ``fan_in`` entries of a digest, or one partition's copies of it, so a text that fills a third of
the corpus costs no more than any other. The verdicts then travel down the same tree to the rows.

Digests are verified at every level: entries merge only if a second, independent hash of the normalised
text and its length agree as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: What is deleted before texts are compared.
IGNORED = r"[\x20\x09-\x0D]+"


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per input row: digest and second hash of the normalised text, length of the original, its run."""
    plain = F.regexp_replace(text_or_empty(), IGNORED, "")
    return with_runs(
        docs.select("doc_id", F.char_length(text_or_empty()).alias("n"), plain.alias("plain"))
        .select("doc_id", "n", F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain", F.length("plain")).alias("second"))
    )


def tree_merge(rows: DataFrame, keys: list[str], best: Column, fan_in: int = 8) -> DataFrame:
    """Every row of a materialised table with the greatest ``best`` and the ``size`` of its group of equal ``keys``.

    ``row`` numbers the rows by partition, and ``run`` is the partition. See the module's description.
    """
    key = ["run", *keys]
    levels = [rows.groupBy(*key).agg(F.max(best).alias("best"), F.count("*").alias("size"))]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        runs = -(-runs // fan_in)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in))
        levels.append(up.groupBy(*key).agg(F.max("best").alias("best"), F.sum("size").alias("size")))
    verdict = levels.pop()
    while levels:
        below = levels.pop().select(F.col("run").alias("child"), F.floor(F.col("run") / fan_in).alias("run"), *keys)
        verdict = below.join(verdict, key).drop("run").withColumnRenamed("child", "run")
    return rows.join(verdict, key)


def with_runs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("run", F.shiftright("row", 33))


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``IGNORED``; null counts as empty. Of equal
    texts the one with most code points stays, then the smallest doc_id; a null doc_id comes last. Rows that
    repeat a doc_id count as members of their own and only one of them is kept. Columns other than doc_id
    and text are not looked at, whatever their names. An empty table gives an empty result.
    """
    rows = materialize(digest_rows(docs), "digests")
    # Complements turn the order around and, unlike negatives, exist for every number.
    best = F.struct("n", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row").alias("not_row"))
    return tree_merge(rows, ["digest", "second"], best, fan_in).select(
        "doc_id",
        F.bitwise_not("best.not_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.bitwise_not("best.not_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their types.

    Rows that repeat a doc_id and a text stay once: the one with most code points, as in ``exact_dedup``; of those that
    also tie in length the one with the greatest text, then the greatest hash of all columns.
    """
    verdicts = materialize(exact_dedup(docs, fan_in).select("doc_id", "kept", "text_sha256"), "verdicts")
    dropped = verdicts.where(~F.col("kept")).select("doc_id").distinct()
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_tm_kept_id"), F.col("text_sha256").alias("_tm_kept_sha"))
    # A doc_id that is both dropped and kept repeats in the input: only those rows are told apart by their digest.
    both = materialize(dropped.join(kept, F.col("doc_id").eqNullSafe(F.col("_tm_kept_id"))).select("_tm_kept_id", "_tm_kept_sha"), "repeated-ids")
    unkept = dropped.withColumnRenamed("doc_id", "_tm_dropped_id")
    clear = docs.join(unkept, F.col("doc_id").eqNullSafe(F.col("_tm_dropped_id")), "left_anti")
    if both.isEmpty():
        return clear
    digest = F.sha2(F.regexp_replace(text_or_empty(), IGNORED, ""), 256)
    unclear = docs.join(both, F.col("doc_id").eqNullSafe(F.col("_tm_kept_id")) & (digest == F.col("_tm_kept_sha")), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.char_length(text_or_empty()), F.col("text"), F.xxhash64(F.to_json(whole)))
    repeated = unclear.groupBy("doc_id", digest.alias("digest")).agg(F.max_by(whole, order).alias("r"))
    return clear.unionByName(repeated.select("r.*"))
