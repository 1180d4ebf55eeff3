"""Previous rows and running numbers inside keys of any size, without a key's rows in one task.

A key's rows are dealt into ranges of its order column. Each range gets one boundary row, made by an aggregate that combines before the
shuffle: what the ranges before it end with, or how many rows they hold. Boundary rows go into their ranges as first rows, so a window
over (key, range) sees what it needs, null keys included, and no join is made. What meets in one task is a range, and a key's boundary rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 18  # rows of a range


def previous(rows: DataFrame, keys: list[str], order: str, values: list[str], width: int = RANGE_ROWS, sums: tuple[str, ...] = (), beside: DataFrame | None = None) -> DataFrame:
    """Each row with ``before_<value>`` of the row before it in its key, null for a key's first row.

    ``order`` is a whole number that is dense and hardly repeats in a key, as chain and client numbers are: a range is
    ``width`` numbers, so it holds about as many rows at most, and ranges grow in number with the ledger. Rows of one number
    stay together, in any order. ``total_<c>`` is the sum of each of ``sums`` over the rows before in the key. ``beside`` has one row
    a key, whose columns every row of the key gets, null where there is none: they travel in the boundary rows, so rows are dealt once.
    """
    placed = rows.withColumn("_range", F.floor(F.col(order) / width)).withColumns({f"_{c}": F.col(c) for c in sums})
    ends = placed.groupBy(*keys, "_range").agg(F.max_by(F.struct(*values), order).alias("_values"), *[F.sum(f"_{c}").alias(f"_{c}") for c in sums])
    by_range = Window.partitionBy(*keys).orderBy("_range")
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_values", F.lag("_values").over(by_range)).withColumns({f"_{c}": F.sum(f"_{c}").over(earlier) for c in sums})
    more = [c for c in beside.columns if c not in keys] if beside is not None else []
    if beside is not None:
        carried = carried.join(beside, keys, "left")
    elif not sums:
        carried = carried.where("_values IS NOT NULL")
    carried = carried.select(*keys, "_range", F.lit(0).alias("_row"), *[F.col(f"_values.{v}").alias(v) for v in values], *[f"_{c}" for c in sums], *more)
    both = placed.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_range").orderBy("_row", order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = {f"before_{v}": F.lag(v).over(inside) for v in values} | {f"total_{c}": F.coalesce(F.sum(f"_{c}").over(upto), F.lit(0)) for c in sums}
    given = {c: F.first(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in more}
    return both.withColumns(seen | given).where("_row = 1").drop("_range", "_row", *[f"_{c}" for c in sums])


def as_number(rows: DataFrame, order: str) -> Column:
    """A double that never falls where the order column rises: numbers, times, or the first bytes of a text."""
    kind = dict(rows.dtypes)[order]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(order).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind.startswith("timestamp") or kind == "date":
        return F.col(order).cast("timestamp").cast("double")
    return F.col(order).cast("double")


def numbered_rows(rows: DataFrame, keys: list[str], order: str, name: str, per_range: int = RANGE_ROWS) -> DataFrame:
    """Each row with its place (from 1) in its key by ``order``, for any order column: its values may be far apart or crowded.

    Ranges are cut at quantiles of the whole table, so none holds many more than ``per_range`` rows whatever the keys; only rows
    of equal order stay together. The cuts are one number a range; their binary search is the JVM's own.
    """
    from pyspark.ml.feature import Bucketizer

    placed = rows.withColumn("_place", F.coalesce(as_number(rows, order), F.lit(float("-inf"))))
    parts = -(-rows.count() // per_range)
    if parts > 1:
        cuts = sorted(set(placed.approxQuantile("_place", [k / parts for k in range(1, parts)], 0.25 / parts)) - {float("-inf"), float("inf")})
        placed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_place", outputCol="_range").transform(placed) if cuts else placed.withColumn("_range", F.lit(0.0))
    else:
        placed = placed.withColumn("_range", F.lit(0.0))
    placed = placed.drop("_place")
    running = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(running, F.lit(0))).drop("_n")
    both = placed.withColumn("_row", F.lit(1)).unionByName(offsets.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_range").orderBy("_row", order)
    offset = F.max("_offset").over(Window.partitionBy(*keys, "_range"))
    return both.withColumn(name, (F.row_number().over(inside) - 1 + offset).cast("long")).where("_row = 1").drop("_range", "_row", "_offset")
