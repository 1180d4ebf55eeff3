"""Hash chains: building, verifying and anchoring.

A row's hash is the digest of its own text followed by the hash of the row before. Verification needs no walk: a row is
compared with the *stored* hash of its predecessor, so all rows are checked side by side and the first break is the smallest
sequence number that fails. A head is recomputed in the same way: where every row from genesis follows from the stored hash before it, the
stored head is what a walk would give. Predecessors come by ranges, so that a chain of any length is spread over the cluster. Only building
a chain is a fold over a tenant's rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import utc_text
from ..functions.hashes import canonical, utc_of
from ..schemas import GENESIS
from .ranges import RANGE_ROWS, previous

#: First versions that fold a field in: fixed values.
WITH_VERSION, WITH_VERDICT, WITH_UTC = 3, 4, 5
EVENT_FIELDS = ("agent", "client_id", "client_seq", "commitment_alg", "event_id", "event_type", "occurred_at", "org_id", "pii_signals", "policy_tag", "prompt_hash", "response_hash", "seq", "token_count")


def blob_v1() -> Column:
    """The text of a version-1 row; the agent only where there is one."""
    parts = F.concat_ws("|", *[F.col(c).cast("string") for c in ("org_id", "prompt_hash", "response_hash", "token_count", "policy_tag", "seq")])
    return F.when(F.coalesce(F.col("agent"), F.lit("")) != "", F.concat(parts, F.lit("|agent="), F.col("agent"))).otherwise(parts)


def with_document(name: str) -> Callable[..., Column]:
    """A function that puts a JSON document under a name into another one and gives the canonical form."""

    @F.pandas_udf(T.StringType())
    def put(event: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else canonical({**json.loads(e), name: None if d is None else json.loads(d)}) for e, d in zip(event, document, strict=True)])

    return put


canonical_event, canonical_action = with_document("event_metadata"), with_document("detail")


#: Types whose JSON is the same in Spark and in Python's canonical form, and JSON text that has nothing the two escape differently.
ALIKE = ("string", "bigint", "int", "smallint", "tinyint", "boolean", "array<string>", "void")
PLAIN_TEXT, ESCAPE = r"^[ -~]*\z", "\\u"


def with_place(fields: dict[str, Column], name: str) -> tuple[Column, Column]:
    """The fields as JSON in the order of their names, null under one more name, and whether their types are written alike."""
    alike = F.lit(True)
    for v in fields.values():
        alike = alike & F.typeof(v).isin(*ALIKE)
    all_ = fields | {name: F.lit(None).cast("string")}
    return F.to_json(F.struct(*[all_[k].alias(k) for k in sorted(all_)]), {"ignoreNullFields": "false"}), alike


def canonical_whole(event: Column, alike: Column, name: str, document: Column, put: Callable[..., Column]) -> Column:
    """The canonical form of an event with a JSON document in its place. Only documents, and events with other than plain text, go through Python; one call a row at most.

    Inside strings quotes are escaped, so the place occurs once.
    """
    plain = alike & event.rlike(PLAIN_TEXT) & ~event.contains(ESCAPE)
    whole = put(F.when(plain, F.when(document.isNotNull(), "{}")).otherwise(event), document)
    inner = whole.substr(F.lit(2), F.length(whole) - 2)
    return F.when(~plain, whole).when(document.isNull(), event).otherwise(F.replace(event, F.lit(f'"{name}":null'), inner))


def event_text(version: int, utc: Column) -> tuple[Column, Column]:
    """The fields of a row of version 2 to 5, with a place for the metadata. Each version adds keys or, for 5, states times in UTC."""
    fields = {f: F.col(f) for f in EVENT_FIELDS} | {"org_id": F.col("org_id").cast("string"), "occurred_at": utc if version >= WITH_UTC else F.col("occurred_at").cast("string")}
    fields["event_type"] = F.coalesce("event_type", F.lit("interaction"))
    fields["commitment_alg"] = F.coalesce("commitment_alg", F.lit("sha256-legacy"))
    if version >= WITH_VERSION:
        fields["chain_version"] = F.lit(version)
    if version >= WITH_VERDICT:
        fields["verdict_hash"] = F.col("verdict_hash")
    return with_place(fields, "event_metadata")


def with_blob(ledger: DataFrame, versions: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Column blob: each row's text by its own chain_version. The version picks the fields natively, so a row goes through Python's canonical form once at most."""
    version, newer = F.col("chain_version"), [v for v in versions if v > 1]
    plain = F.when(version == 1, blob_v1()) if 1 in versions else F.lit(None).cast("string")
    if not newer:
        return ledger.withColumn("blob", plain)
    utc = utc_of(F.when(version >= WITH_UTC, F.col("occurred_at").cast("string"))) if max(newer) >= WITH_UTC else F.lit(None)
    event, alike = F.lit(None).cast("string"), F.lit(True)
    for v in newer:
        own = event_text(v, utc)
        event, alike = F.when(version == v, own[0]).otherwise(event), alike & own[1]
    # a column of its own: it is looked at, and then may have its document put in
    rows = ledger.withColumn("_event", event)
    whole = canonical_whole(F.col("_event"), alike, "event_metadata", F.when(version > 1, F.col("event_metadata")), canonical_event)
    return rows.withColumn("blob", F.coalesce(whole, plain)).drop("_event")


def link(blob: Column, before: Column) -> Column:
    return F.sha2(F.concat(blob, before), 256)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link rows (key, seq, blob, head_hash) that come by key and seq; only the last hash is held between rows."""
    current, prev, began = None, None, False
    for b in batches:
        before, own = [], []
        for key, blob, head in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if not began or key != current:
                current, prev, began = key, GENESIS if head is None else head, True
            before.append(prev)
            prev = None if blob is None or prev is None else hashlib.sha256((blob + prev).encode()).hexdigest()
            own.append(prev)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(before, pa.string()), pa.array(own, pa.string())], names=[b.schema.names[0], "seq", "prev_hash", "chain_hash"])


def fold(batch: DataFrame, heads: DataFrame | None = None, key: str = "org_id") -> DataFrame:
    """Chain a batch of rows (key, seq, blob) behind each key's head (key, head_hash), genesis where there is none.

    A chain is sequential within a key: its rows are walked in one task, keys side by side. They are sorted (which spills) and
    streamed, so that no history is held in memory, and each row is copied once.
    """
    rows = batch.select(key, F.col("seq").cast("bigint").alias("seq"), "blob")
    if heads is not None:
        rows = rows.join(heads.select(key, "head_hash"), key, "left")
    else:
        rows = rows.withColumn("head_hash", F.lit(None).cast("string"))
    schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, t in (("seq", T.LongType()), ("prev_hash", T.StringType()), ("chain_hash", T.StringType()))]])
    ordered = rows.repartition(key).sortWithinPartitions(key, F.col("seq").asc_nulls_last(), F.col("blob").asc_nulls_last())
    return ordered.select(key, "seq", "blob", "head_hash").mapInArrow(walk, schema)


def walk_along(names: list[str], kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Link rows that come by key and seq, as ``walk`` does; the columns ``kept`` go along as they are. Names begin with key, seq, blob, head_hash."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, prev, began = None, None, None, False
        for b in batches:
            before, own = [], []
            for key, seq, blob, head in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if not began or key != current:
                    current, prev, began = key, GENESIS if head is None else head, True
                elif last is None or seq is None or seq <= last:
                    raise ValueError(f"numbers of chain {key} do not rise: {last}, {seq}")
                last = seq
                before.append(prev)
                prev = None if blob is None or prev is None else hashlib.sha256((blob + prev).encode()).hexdigest()
                own.append(prev)
            columns = [b.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*kept, "prev_hash", "chain_hash"])

    return step


def fold_along(rows: DataFrame, heads: DataFrame | None = None, key: str = "org_id", order: str = "seq", texts: Callable[[DataFrame], DataFrame] | None = None, kept: list[str] | None = None) -> DataFrame:
    """Rows (key, seq, any others) chained as ``fold`` does, each with its own columns beside prev_hash and chain_hash: no join puts them together again.

    ``texts`` adds the column blob, by default that of version 1, after rows have been dealt and sorted, so texts are not shuffled. ``order`` rises with
    seq; rows that were numbered by windows over (key, order) are neither dealt nor sorted anew. Numbers that do not rise stop the job.
    ``kept`` names the columns that go along, by default all but the text.
    """
    if heads is not None:
        rows = rows.join(heads.select(key, "head_hash"), key, "left")
    else:
        rows = rows.withColumn("head_hash", F.lit(None).cast("string"))
    own = [c for c in rows.columns if c not in ("blob", "head_hash")]
    ordered = rows.repartition(key).sortWithinPartitions(key, order)
    told = (texts or (lambda r: r.withColumn("blob", blob_v1())))(ordered)
    kept = kept or own
    first = [key, F.col("seq").cast("bigint").alias("seq"), "blob", "head_hash"]
    names = [key, "seq", "blob", "head_hash", *[c for c in kept if c not in (key, "seq", "blob")]]
    told = told.select(*first, *names[4:])
    schema = T.StructType([*[told.schema[c] for c in kept], T.StructField("prev_hash", T.StringType()), T.StructField("chain_hash", T.StringType())])
    return told.mapInArrow(walk_along(names, kept), schema)


def checked(chain: DataFrame, key: str | None = "org_id", first_seq: int = 1, seed: str | None = GENESIS, width: int = RANGE_ROWS) -> DataFrame:
    """Each row of a chain (key, seq, blob, prev_hash, chain_hash) with its problem, null where it is sound.

    A gap is found before a wrong predecessor, and that before a wrong hash. With ``seed`` null a segment is taken to
    start from what its first row says. Without a key all rows are one chain. A key's rows are dealt in ranges of ``width`` numbers.
    """
    # where a row names the hash before it rightly, its own hash can be checked before rows are dealt: texts stay where they are
    rows = chain.withColumn("_own", link(F.col("blob"), F.col("prev_hash")) != F.col("chain_hash"))
    rows = previous(rows, [key] if key else [], "seq", ["seq", "chain_hash"], width)
    expected_seq = F.coalesce(F.col("before_seq") + 1, F.lit(first_seq) if seed is not None else F.col("seq"))
    expected_prev = F.coalesce("before_chain_hash", F.lit(seed) if seed is not None else F.col("prev_hash"))
    rows = rows.withColumn("expected_seq", expected_seq).withColumn("expected_prev", expected_prev).drop("before_seq", "before_chain_hash")
    problem = (
        F.when(F.col("seq") != F.col("expected_seq"), "gap")
        .when(~F.col("prev_hash").eqNullSafe(F.col("expected_prev")), "previous")
        .when(F.col("_own"), "hash")
    )
    return rows.withColumn("problem", problem).drop("_own")


def verdicts(checked_rows: DataFrame, key: str = "org_id") -> DataFrame:
    """Per chain: ok, the first broken row and its problem, rows, head."""
    return checked_rows.groupBy(key).agg(
        F.min(F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("first_broken_seq"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("problem"),
        F.count("*").alias("rows"), F.max("seq").alias("head_seq"), F.max_by("chain_hash", "seq").alias("head_hash"),
    ).withColumn("ok", F.col("first_broken_seq").isNull())


def verify(chain: DataFrame, key: str = "org_id", width: int = RANGE_ROWS) -> DataFrame:
    return verdicts(checked(chain, key, width=width), key)


def bounded_answer(verdict: DataFrame, most: int | None = None) -> DataFrame:
    """Three answers: true, false, or null where nothing was checked. Without a bound every chain is checked."""
    skipped = F.lit(False) if most is None else F.col("rows") > most
    return verdict.withColumn("ok", F.when(~skipped & (F.col("rows") > 0), F.col("ok")))


def verify_record(chain: DataFrame, chain_hash: str, key: str = "org_id") -> DataFrame:
    """One record against its predecessor: intact or not."""
    rows = checked(chain, key)
    return rows.where(F.col("chain_hash") == chain_hash).select(key, "seq", F.col("problem").isNull().alias("intact"))


def refold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold each stretch of consecutive rows (key, seq, blob, before, chain_hash, more) from the hash stored before it.

    Gives a stretch's key, last number, own last hash, and whether that is the hash stored.
    """
    current: tuple | None = None
    last, own, stored, out = None, None, None, []

    def batch(schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        types = (schema.field(0).type, pa.int64(), pa.string(), pa.bool_())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[schema.names[0], "end_seq", "own", "joins"])

    for b in batches:
        schema = b.schema
        for key, seq, blob, before, chain_hash in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
            if current != (key,) or seq != last + 1:
                if current is not None:
                    out.append((current[0], last, own, own == stored))
                current, own = (key,), before
            last, stored = seq, chain_hash
            own = None if blob is None or own is None else hashlib.sha256((blob + own).encode()).hexdigest()
        yield batch(schema)
    if current is not None:
        out.append((current[0], last, own, own == stored))
        yield batch(schema)


def head_up_to(chain: DataFrame, upto: DataFrame, key: str = "org_id", width: int = RANGE_ROWS) -> DataFrame:
    """Each key's head recomputed from genesis to upto_seq; null where the range has a gap or leaves what is stored for good.

    A row is a segment: its hash is computed anew from its text and the hash stored before it, genesis for the first. Where that
    is the hash stored, a walk from genesis that was right before is right there. Rows where it is not are few; consecutive ones are
    folded as one segment, whose end must join the row behind it, so a stored hash that was overwritten alone does no harm, as in a walk.
    """
    rows = previous(chain.select(key, "seq", "blob", "chain_hash"), [key], "seq", ["chain_hash"], width, beside=upto.select(key, "upto_seq"))
    rows = recomputing(rows)
    whole = rows.groupBy(key).agg(*covered()).where("n > 0")
    return with_head_again(whole, rows, upto, key).select(key, "upto_seq", "recomputed")


def recomputing(rows: DataFrame) -> DataFrame:
    """Rows with the hash before them, and their own recomputed from it."""
    return rows.withColumn("before", F.coalesce("before_chain_hash", F.lit(GENESIS))).withColumn("again", link(F.col("blob"), F.col("before")))


def covered() -> list[Column]:
    """What a chain has up to upto_seq: rows, the last of them, and that one's own hash."""
    within = F.col("seq") <= F.col("upto_seq")
    return [F.count_if(within).alias("n"), F.max(F.when(within, F.col("seq"))).alias("last"), F.max("upto_seq").alias("upto_seq"), F.max_by("again", F.when(within, F.col("seq"))).alias("again")]


def with_head_again(whole: DataFrame, rows: DataFrame, upto: DataFrame, key: str) -> DataFrame:
    """What chains cover with recomputed, their head from it and from the rows whose own hash is not the one stored, folded in stretches."""
    odd = rows.where((F.col("seq") <= F.col("upto_seq")) & ~F.col("again").eqNullSafe(F.col("chain_hash")))
    odd = odd.select(key, F.col("seq").cast("bigint").alias("seq"), "blob", "before", "chain_hash", *[c for c in ("prev_hash", "before_seq") if c in rows.columns])  # all that was dealt, so it is dealt once
    schema = T.StructType([odd.schema[key], T.StructField("end_seq", T.LongType()), T.StructField("own", T.StringType()), T.StructField("joins", T.BooleanType())])
    stretches = odd.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(refold, schema)
    at_end = F.col("end_seq") == F.col("upto_seq")
    ends = stretches.join(upto.select(key, "upto_seq"), key).groupBy(key).agg(F.bool_and(F.col("joins") | at_end).alias("joined"), F.max(F.when(at_end, F.col("own"))).alias("own"), F.bool_or(at_end).alias("inside"))
    sound = (F.col("n") == F.col("last")) & (F.col("last") == F.col("upto_seq")) & F.coalesce("joined", F.lit(True))
    return whole.join(ends, key, "left").withColumn("recomputed", F.when(sound, F.when(F.coalesce("inside", F.lit(False)), F.col("own")).otherwise(F.col("again"))))


def against_anchor(chain: DataFrame, anchors: DataFrame, key: str = "org_id", keys: DataFrame | None = None, width: int = RANGE_ROWS) -> DataFrame:
    """The published root against the chain: three answers and what went wrong.

    Without a confirmed anchor the answer is null. A head behind the anchor is truncated; a range that does not recompute is
    modified; one that recomputes to another root is modified if the chain is broken in itself, else a root mismatch. ``keys``
    names those to answer for, chains without any row included; without it, those with rows. Rows are dealt once: what is broken
    and what is covered come from one aggregate.
    """
    anchor = anchors.where("status = 'confirmed'").groupBy(key).agg(F.max_by(F.struct("last_seq", "root_hash"), "anchored_at").alias("a")).select(key, F.col("a.last_seq").alias("anchored_seq"), F.col("a.root_hash").alias("root_hash"))
    upto = anchor.select(key, F.col("anchored_seq").alias("upto_seq"))
    rows = recomputing(previous(chain.select(key, "seq", "blob", "prev_hash", "chain_hash"), [key], "seq", ["seq", "chain_hash"], width, beside=upto))
    broken = (F.col("seq") != F.coalesce(F.col("before_seq") + 1, F.lit(1))) | ~F.col("prev_hash").eqNullSafe(F.col("before")) | (F.col("again") != F.col("chain_hash"))
    once = rows.groupBy(key).agg(F.max("seq").alias("head_seq"), (F.count_if(broken) == 0).alias("intact"), *covered())
    state = with_head_again(once, rows, upto, key).select(key, "head_seq", "intact", "recomputed")
    if keys is not None:
        state = keys.select(key).join(state, key, "left")
    rows = state.join(anchor, key, "left")
    head = F.coalesce("head_seq", F.lit(0))
    kind = (
        F.when(F.col("anchored_seq").isNull(), None)
        .when(head < F.col("anchored_seq"), "truncated")
        .when(F.col("recomputed").isNull(), "modified")
        .when(F.col("recomputed") != F.col("root_hash"), F.when(~F.col("intact"), "modified").otherwise("root_mismatch"))
    )
    return rows.withColumn("kind", kind).select(key, "head_seq", "anchored_seq", "kind", F.when(F.col("anchored_seq").isNotNull(), F.col("kind").isNull()).alias("ok"), (head - F.col("anchored_seq")).alias("unwitnessed"))


def blob_staff(version: int = 1) -> Column:
    """The canonical text of a staff action: its fields by name in order, the detail document inside, the time in UTC."""
    text = lambda c: F.col(c).cast("string")
    fields = {"action": F.col("action"), "chain_version": F.lit(version), "created_at": utc_text(F.col("created_at")), "ip": F.col("ip"), "seq": F.col("seq"), "staff_user_id": text("staff_user_id"), "target_id": text("target_id"), "target_org_id": text("target_org_id"), "target_type": F.col("target_type")}
    return canonical_whole(*with_place(fields, "detail"), "detail", F.col("detail"), canonical_action)


STAFF_KINDS = {"gap": "missing", "previous": "out_of_order", "hash": "modified"}


def verify_staff(actions: DataFrame, width: int = RANGE_ROWS, site: str | None = None) -> DataFrame:
    """The platform-wide chain of staff actions: one chain without a key, or one for each ``site``.

    Rows before the chain (seq null) are counted and never a failure; a chain without any row is neither sound nor broken. What is
    named as broken is the entry that is missing, does not follow, or was changed. No task sorts a whole chain.
    """
    by = [site] if site else []
    rows = checked(actions.where("seq IS NOT NULL"), site, width=width)
    kind = F.lit(None).cast("string")
    for problem, name in STAFF_KINDS.items():
        kind = F.when(F.col("problem") == problem, name).otherwise(kind)
    broken = F.when(F.col("problem") == "gap", F.col("expected_seq")).when(F.col("problem").isNotNull(), F.col("seq"))
    rows = rows.withColumn("kind", kind).withColumn("broken_seq", broken).withColumn("at", F.when(F.col("problem").isNotNull(), F.col("seq")))
    first = rows.groupBy(*by).agg(
        F.min_by("broken_seq", "at").alias("first_broken_seq"), F.min_by("kind", "at").alias("kind"), F.count("*").alias("chained"), F.max("seq").alias("head_seq"), F.max_by("chain_hash", "seq").alias("head_hash")
    )
    old = actions.groupBy(*by).agg(F.count_if(F.col("seq").isNull()).alias("unchained"))
    both = old.join(first, site, "left") if site else first.crossJoin(old)  # without sites two single rows
    return both.withColumn("chained", F.coalesce("chained", F.lit(0))).withColumn("ok", F.when(F.col("chained") > 0, F.col("first_broken_seq").isNull()))


def verify_staff_anchor(actions: DataFrame, anchors: DataFrame, site: str, width: int = RANGE_ROWS) -> DataFrame:
    """Each site's staff chain against the last root that was confirmed for it: truncated, modified, root_mismatch or sound.

    A chain that was deleted whole is truncated as well. Entries behind the anchor are not yet witnessed, which is no fault.
    """
    sites = actions.select(site).distinct()
    return against_anchor(actions.where("seq IS NOT NULL"), anchors, site, sites, width)


def verify_pages(documents: DataFrame, rows: DataFrame, width: int = RANGE_ROWS) -> DataFrame:
    """Export files as one chain: per tenant whether they are sound, join, and cover the ledger.

    ``documents`` has file, org_id, page, anchor and rows, or the first and last row that ``page_summaries`` gives; ``rows`` the exploded rows with blob. Status is complete, segment or
    broken; broken names what was found first: declared bounds, pages that do not join, then rows, then a
    checkpoint beyond the end.
    """
    if "first_seq" in documents.columns:  # summaries of files that are not held whole
        pages = documents.select("file", "org_id", "page", F.col("anchor.last_seq").alias("anchored_seq"), "first_seq", "last_seq", "last_hash", "first_prev")
    else:
        number = F.transform("rows", lambda r: r["seq"])
        pages = documents.select(
            "file", "org_id", "page", F.col("anchor.last_seq").alias("anchored_seq"), F.array_min(number).alias("first_seq"), F.array_max(number).alias("last_seq"),
            F.array_max(F.transform("rows", lambda r: F.struct(r["seq"], r["chain_hash"])))["chain_hash"].alias("last_hash"),
            F.array_min(F.transform("rows", lambda r: F.struct(r["seq"], r["prev_hash"])))["prev_hash"].alias("first_prev"),
        )
    order = Window.partitionBy("org_id").orderBy("first_seq")
    before_seq, before_hash = F.lag("last_seq").over(order), F.lag("last_hash").over(order)
    wrong = (
        F.when(F.col("page.from_seq") != F.col("first_seq"), F.struct(F.lit(1).alias("step"), F.col("first_seq").alias("seq"), F.lit("declared start").alias("what")))
        .when(F.col("page.to_seq") != F.col("last_seq"), F.struct(F.lit(1).alias("step"), F.col("last_seq").alias("seq"), F.lit("declared end").alias("what")))
        .when(before_seq + 1 != F.col("first_seq"), F.struct(F.lit(2).alias("step"), F.col("first_seq").alias("seq"), F.lit("pages do not join").alias("what")))
        .when(before_hash != F.col("page.prev_chain_hash"), F.struct(F.lit(2).alias("step"), F.col("first_seq").alias("seq"), F.lit("pages do not join").alias("what")))
    )
    page_state = pages.withColumn("wrong", wrong).groupBy("org_id").agg(
        F.min("wrong").alias("page_wrong"), F.min("first_seq").alias("from_seq"), F.max("last_seq").alias("to_seq"), F.count("*").alias("pages"),
        F.min_by(F.coalesce("page.prev_chain_hash", "first_prev"), "first_seq").alias("seed"), F.max_by(F.coalesce("page.complete", F.lit(True)), "last_seq").alias("last_complete"), F.max("anchored_seq").alias("anchored_seq"),
    )
    start = page_state.select("org_id", F.when(F.col("from_seq") == 1, F.lit(GENESIS)).otherwise(F.col("seed")).alias("start"))
    told = F.col("prev_hash").isNotNull()  # such a row's own hash is checked where it is; only texts of rows that do not say what is before them travel
    dealt = rows.withColumn("_own", link(F.col("blob"), F.col("prev_hash")) != F.col("chain_hash")).withColumn("_text", F.when(~told, F.col("blob"))).drop("blob")
    seen = previous(dealt, ["org_id"], "seq", ["seq", "chain_hash"], width, beside=start).withColumn("expected_prev", F.coalesce("before_chain_hash", "start"))
    own = F.when(told, F.col("_own") & F.col("expected_prev").isNotNull()).otherwise(link(F.col("_text"), F.col("expected_prev")) != F.col("chain_hash"))
    problem = F.when(F.col("seq") != F.col("before_seq") + 1, "gap").when(F.col("prev_hash") != F.col("expected_prev"), "previous").when(own, "hash")
    if "verdict_ok" in rows.columns:
        problem = problem.when(~F.coalesce(F.col("verdict_ok"), F.lit(True)), "local verdict")
    found = seen.withColumn("problem", problem).groupBy("org_id").agg(F.count("*").alias("rows"), F.min(F.when(F.col("problem").isNotNull(), F.struct(F.lit(3).alias("step"), F.col("seq").alias("seq"), F.col("problem").alias("what")))).alias("row_wrong"))
    all_ = page_state.join(found, "org_id")
    complete = (F.col("from_seq") == 1) & F.col("last_complete")
    beyond = F.when(complete & (F.col("anchored_seq") > F.col("to_seq")), F.struct(F.lit(4).alias("step"), F.lit(None).cast("long").alias("seq"), F.lit("ends before the anchor").alias("what")))
    first = F.coalesce("page_wrong", "row_wrong", beyond)
    return all_.withColumn("first", first).select("org_id", "pages", "rows", "from_seq", "to_seq", F.when(F.col("first").isNotNull(), "broken").when(complete, "complete").otherwise("segment").alias("status"), F.col("first.seq").alias("first_broken_seq"), F.col("first.what").alias("detail"))


def coverage_report(ledger: DataFrame, chain_ok: bool | None, all_time: bool = True) -> DataFrame:
    """Whether what clients numbered arrived: events, gaps, repeats, and one status."""
    from .windows import sequence_gaps

    identified = F.col("client_id").isNotNull() & F.col("client_seq").isNotNull()
    totals = ledger.agg(F.count("*").alias("total_events"), F.count_if(identified).alias("identified_events"), F.count_distinct(F.when(identified, F.col("client_id"))).alias("instrumented_clients"), F.max("created_at").alias("last_event_at"))
    gaps = sequence_gaps(ledger, all_time).groupBy("client_id").agg(F.sum("missing").alias("missing"))
    twice = ledger.where(identified).groupBy("client_id", "client_seq").agg(F.count("*").alias("n")).where("n > 1").groupBy("client_id").agg(F.sum(F.col("n") - 1).alias("repeated"))
    odd = gaps.join(twice, "client_id", "full").agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_events"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("duplicate_client_sequences"), F.count("*").alias("clients_with_anomalies"))
    both = totals.crossJoin(odd)  # two single rows
    unclear = (F.col("missing_events") > 0) | (F.col("duplicate_client_sequences") > 0) | (F.col("identified_events") < F.col("total_events"))
    status = F.when(F.col("total_events") == 0, "unknown").when(F.lit(chain_ok is False) | unclear | F.lit(chain_ok is None), "partial").otherwise("verified")
    return both.withColumn("status", status)
