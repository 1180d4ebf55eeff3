"""Sinks: export pages, CSV, account exports, rollups and partitioned logs. All writing is Spark's own."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import keyed_digest
from ..operators.ranges import RANGE_ROWS, previous
from ..schemas import EXPORT_COLUMNS, GENESIS

NESTED = (T.StructType, T.ArrayType, T.MapType)


def export_projection(ledger: DataFrame, *more: str) -> DataFrame:
    """The export's fixed columns in their order; times as ISO text, missing columns as null. ``more`` go along as they are."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    kinds = dict(ledger.dtypes)
    columns = []
    for name in EXPORT_COLUMNS:
        if name not in kinds:
            columns.append(F.lit(None).cast("string").alias(name))
        else:
            columns.append((iso(name) if kinds[name].startswith("timestamp") else F.col(name)).alias(name))
    return ledger.select(*columns, *more)


def completeness(page: DataFrame, has_more: bool = False) -> DataFrame:
    """One row that states what a page covers."""
    return page.agg(F.count("*").alias("count"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.min_by("prev_hash", "seq").alias("prev_chain_hash")).withColumn("complete", F.lit(not has_more)).withColumn("next_after_seq", F.when(F.lit(has_more), F.col("to_seq")))


PAGE_ROWS, PAGE_BYTES = 10_000, 20 << 20  # bounds of an export page


def paged(ledger: DataFrame, key: str = "org_id", most_rows: int = PAGE_ROWS, most_bytes: int = PAGE_BYTES, size: Column | None = None, width: int = RANGE_ROWS) -> DataFrame:
    """The rows of all ledgers with the page they go to: ``part``, a struct that orders a key's pages, and ``before``, the hash to start from.

    A page is what falls into one cell of two rulers along the sorted ledger, of ``most_rows`` rows and of ``most_bytes`` bytes, so
    it holds no more rows, and at most one row's bytes more. Places and bytes are running totals over ranges: no task walks a ledger.
    ``size`` measures a row, by default its JSON.
    """
    measured = size if size is not None else F.octet_length(F.to_json(F.struct(*ledger.columns), {"ignoreNullFields": "false"})) + 2
    rows = ledger.withColumn("bytes", measured.cast("long")).withColumn("_one", F.lit(1))
    rows = previous(rows, [key], "seq", ["seq", "chain_hash"], width, ("_one", "bytes"))  # rows are dealt once
    follows = F.col("before_seq") == F.col("seq") - 1
    rows = rows.withColumn("before", F.when(F.col("seq") == 1, F.lit(GENESIS)).when(follows, F.col("before_chain_hash"))).drop("before_seq", "before_chain_hash", "_one")
    part = F.struct(F.floor(F.col("total__one") / most_rows).alias("by_rows"), F.floor(F.col("total_bytes") / most_bytes).alias("by_bytes"))
    return rows.withColumn("part", part).drop("total__one", "total_bytes")


def page_manifest(rows: DataFrame, key: str = "org_id", most_rows: int = PAGE_ROWS) -> DataFrame:
    """One row a page: its number, what it covers, where its recompute starts, and how to go on after it."""
    pages = rows.groupBy(key, "part").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.min_by("before", "seq").alias("prev_chain_hash"))
    order = Window.partitionBy(key).orderBy("part")  # one row a page
    more = F.lead("part").over(order).isNotNull()
    return pages.select(
        key, "part", F.row_number().over(order).cast("long").alias("page_no"), "count", "bytes", "from_seq", "to_seq", "prev_chain_hash", (~more).alias("complete"),
        F.when(more, F.col("to_seq")).alias("next_after_seq"), F.when(more, F.concat(F.lit("?after_seq="), F.col("to_seq"))).alias("next"), F.lit(most_rows).alias("max_rows_per_page"),
    )


def write_pages(rows: DataFrame, manifest: DataFrame, folder: str, key: str = "org_id", shape: Callable[[DataFrame], DataFrame] | None = None, codec: str = "none") -> None:
    """Each page as a JSON document of its own with its statement of coverage before the rows; what is gathered for one is a page.

    Rows are dealt by page before they are made into texts, and ``shape`` widens them there to what is exported, leaving key and part as they are, so that
    texts are not dealt again; a page is one row and so one file. ``codec`` compresses files, which are then read whole by one task: a page is bounded.
    """
    dealt = rows.repartition(key, "part")
    texts = export_projection(shape(dealt) if shape else dealt, key, "part")
    row = F.to_json(F.struct(*EXPORT_COLUMNS), {"ignoreNullFields": "false"})
    logs = texts.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))).alias("rows"))
    statement = F.to_json(F.struct("from_seq", "to_seq", "prev_chain_hash", "complete", "next_after_seq", "next", "max_rows_per_page"), {"ignoreNullFields": "false"})
    body = F.concat(
        F.lit('{"org_id": '), F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2),
        F.lit(', "count": '), F.col("count"), F.lit(', "page": '), statement, F.lit(', "anchor": null, "logs": [\n'), F.array_join(F.transform("rows", lambda r: r["row"]), ",\n"), F.lit("\n]}"),
    )
    pages = manifest.join(logs, [key, "part"]).select(F.col(key), "page_no", body.alias("value"))
    pages.write.mode("overwrite").option("compression", codec).partitionBy(key, "page_no").text(folder)


def write_json_export(page: DataFrame, folder: str, has_more: bool = False) -> None:
    rows = export_projection(page)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/logs")
    completeness(rows, has_more).write.mode("overwrite").json(f"{folder}/page")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f.name) for f in df.schema.fields])


def write_csv_export(page: DataFrame, folder: str, has_more: bool = False) -> None:
    """Rows as CSV and the statement of coverage beside them."""
    rows = export_projection(page)
    flat(rows).write.mode("overwrite").option("header", "true").csv(f"{folder}/logs")
    completeness(rows, has_more).write.mode("overwrite").json(f"{folder}/page")


def write_csv_page(page: DataFrame, folder: str, preamble: list[str]) -> None:
    """A page as one CSV file that begins with comment lines; the size of a page is bounded where it is cut."""
    rows = flat(export_projection(page))
    head = [*(f"# {x}" for x in preamble), ",".join(rows.columns)]
    top = page.sparkSession.createDataFrame([(-1, k, x) for k, x in enumerate(head)], "part int, place long, value string")
    lines = top.unionByName(rows.select(F.lit(0).alias("part"), F.col("seq").cast("long").alias("place"), F.to_csv(F.struct(*rows.columns)).alias("value")))
    lines.repartition(1).sortWithinPartitions("part", "place").select("value").write.mode("overwrite").text(folder)


def write_audit_csv(actions: DataFrame, folder: str, limit: int = 10_000) -> None:
    """The newest staff actions; the limit is the feature of this report."""
    flat(actions.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)).write.mode("overwrite").option("header", "true").csv(folder)


def write_account_export(sections: dict[str, DataFrame], folder: str) -> None:
    """Each section of an account in a directory of its own."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def with_month(df: DataFrame, at: str = "created_at") -> DataFrame:
    return df.withColumn("month", F.date_format(at, "yyyy-MM"))


def hashed_clients(traffic: DataFrame, key: str) -> DataFrame:
    """Addresses and user agents as keyed digests: they can be counted but not read."""
    return traffic.withColumns({f"{c}_hash": keyed_digest(F.col(c), key) for c in ("ip", "user_agent")}).drop("ip", "user_agent")


def append_log(df: DataFrame, path: str, at: str = "created_at") -> None:
    """Append to a log partitioned by month."""
    with_month(df, at).write.mode("append").partitionBy("month").parquet(path)


def upsert_days(rollup: DataFrame, path: str) -> None:
    """Replace whole days of a rollup: only the day partitions that occur in ``rollup`` are overwritten."""
    rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def expired_months(months: list[str], today: date, keep_days: int) -> list[str]:
    """Month partitions that lie wholly before the retention window."""
    first_kept = date.fromordinal(today.toordinal() - keep_days).strftime("%Y-%m")
    return sorted(m for m in months if m < first_kept)


def drop_months(spark: SparkSession, path: str, months: list[str]) -> None:
    """Drop partitions of a monthly log: each is overwritten by nothing, whatever store it is in."""
    nothing = spark.read.parquet(path).drop("month").limit(0)
    for month in months:
        spark.createDataFrame([], nothing.schema).write.mode("overwrite").parquet(f"{path}/month={month}")


def rewrite_since(df: DataFrame, target: str, at: str, cutoff: str) -> None:
    """Retention by age as a rewrite: what stays, in a new place that the table's name is then pointed to."""
    keep_since(df, at, cutoff).write.mode("overwrite").parquet(target)


def keep_since(df: DataFrame, at: str, cutoff: str) -> DataFrame:
    """Retention by age: what stays when older rows go."""
    return df.where(F.col(at) >= F.to_timestamp(F.lit(cutoff)))
