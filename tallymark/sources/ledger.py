"""Sources: tenant-scoped tables, export files, known-content sidecars and a guarded table browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANCHOR, EXPORT_ROW, PAGE


def scan(spark: SparkSession, path: str, org: str | int | None) -> DataFrame:
    """One tenant's rows of a table. The tenant is the first filter, so it reaches the scan."""
    if org is None:
        raise ValueError("a tenant is required; use scan_all for staff reads")
    return spark.read.parquet(path).where(F.col("org_id") == F.lit(org))


def scan_all(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tenants, for staff reads."""
    return spark.read.parquet(path)


def by_seq(ledger: DataFrame, seq: int) -> DataFrame:
    return ledger.where(F.col("seq") == seq)


def with_predecessor(ledger: DataFrame, chain_hash: str) -> DataFrame:
    """The row of a chain hash and the row before it, found by two point filters."""
    row = ledger.where(F.col("chain_hash") == chain_hash)
    before = row.select("org_id", (F.col("seq") - 1).alias("seq"))
    return row.withColumn("part", F.lit("row")).unionByName(ledger.join(before, ["org_id", "seq"], "left_semi").withColumn("part", F.lit("predecessor")))


def export_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Export files, one row a file: its name, tenant, page block, anchor and rows.

    A file holds its rows under ``logs`` or ``ledger``, the first present wins; ``ledger`` may itself be an object with ``logs``.
    Nested verdicts and metadata stay JSON text, which is what their hashes are taken over.
    """
    raw = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    pick = lambda *keys: F.coalesce(*[F.get_json_object("body", f"$.{k}") for k in keys])
    rows = F.from_json(pick("logs", "ledger.logs", "ledger"), f"array<struct<{_fields(EXPORT_ROW)}>>")
    return raw.select(
        "file",
        F.get_json_object("body", "$.org_id").alias("org_id"),
        F.from_json(F.get_json_object("body", "$.page"), PAGE).alias("page"),
        F.from_json(F.get_json_object("body", "$.anchor"), ANCHOR).alias("anchor"),
        rows.alias("rows"),
    )


def _fields(ddl: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))


def export_rows(documents: DataFrame) -> DataFrame:
    """The rows of all files, whatever the order of the files."""
    return documents.select("file", "org_id", F.explode("rows").alias("r")).select("file", "org_id", "r.*")


def sidecar(spark: SparkSession, *paths: str) -> DataFrame:
    """event_id, prompt, response, salt from a JSON map of ids or JSON lines; later lines win key by key."""
    lines = spark.read.text(list(paths)).withColumn("line", F.monotonically_increasing_id())
    fields = "event_id string, prompt string, response string, salt string"
    parsed = lines.select("line", F.from_json("value", fields).alias("r"), F.from_json("value", "map<string,struct<prompt:string,response:string,salt:string>>").alias("m"))
    single = parsed.where("r.event_id IS NOT NULL").select("line", "r.*")
    mapped = parsed.where("r.event_id IS NULL AND m IS NOT NULL").select("line", F.explode("m").alias("event_id", "v")).select("line", "event_id", "v.*")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    return single.unionByName(mapped).groupBy("event_id").agg(*[latest(c) for c in ("prompt", "response", "salt")])


#: Columns that never leave a table, and the ending of encrypted keys: fixed values.
NEVER_SHOWN = {"password_hash", "totp_secret", "recovery_codes", "key_hash", "api_key_hash", "payload", "secret", "token_hash", "session_token", "code_hash"}
ENCRYPTED_ENDING = "_key_enc"


def public_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold secrets."""
    return df.drop(*[c for c in df.columns if c in NEVER_SHOWN or c.endswith(ENCRYPTED_ENDING)])


def contains(columns: list[str], q: str) -> Column:
    """Any of the columns holds ``q``, whatever the case; its wildcards stay live."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(f"%{q}%")
    return cond


def browse(df: DataFrame, allowed: list[str], filters: dict[str, str] | None = None, search: list[str] | None = None, q: str = "", order: str = "id", page: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of a registered table and its honest total. Only ``allowed`` columns can be filtered, by equality of text."""
    for name, value in (filters or {}).items():
        if name not in allowed:
            raise ValueError(f"{name} cannot be filtered")
        df = df.where(F.col(name).cast("string") == value)
    if q and search:
        df = df.where(contains(search, q))
    rows = public_columns(df).orderBy(F.col(order).desc()).offset((page - 1) * limit).limit(limit)
    return rows, df.agg(F.count("*").alias("total"))
