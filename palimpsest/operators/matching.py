"""Joins and windows that the inventory needs beyond plain equi-joins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folder import written


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a stated order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def asof_backward(rows: DataFrame, at: str, table: DataFrame, start: str, bound: int = 10_000) -> DataFrame:
    """Each row of ``rows`` with the last row of ``table`` that starts at or before it; nulls before the first, and where ``at`` is null. ``at`` and ``start`` are whole
    numbers; of entries that start at once one counts.

    Up to ``bound`` entries are broadcast: an entry holds until the next one starts, and is put into every bucket of time that it touches, about two of
    them, so an equi-join on the bucket finds it. Beyond, rows and entries are sorted together in ranges that Spark cuts by their number, however they lie in time; the last entry
    is carried on inside each range, and from range to range.
    """
    table = table.where(F.col(start).isNotNull())
    low, high, n = table.agg(F.min(start), F.max(start), F.count(F.lit(1))).first()
    if not n:
        return rows.select("*", *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    if n > bound:
        return _asof_in_ranges(rows, at, table, start)
    width = max(1, (high - low) // n)
    bucket = lambda c: F.floor((F.least(F.col(c), F.lit(high)) - low) / width)
    one = table.groupBy(start).agg(F.min(F.struct(*table.columns)).alias("_entry")).select("_entry.*")
    spans = one.withColumn("_until", F.lead(start).over(Window.orderBy(start)))
    spans = F.broadcast(spans.withColumn("_bucket", F.explode(F.sequence(bucket(start), F.coalesce(bucket("_until"), bucket(start))))))
    held = rows.withColumn("_at", bucket(at))
    fits = (F.col("_at") == F.col("_bucket")) & (F.col(start) <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return held.join(spans, fits, "left").drop("_at", "_bucket", "_until").select(*rows.columns, *table.columns)


def _asof_in_ranges(rows: DataFrame, at: str, table: DataFrame, start: str) -> DataFrame:
    none = lambda df: F.lit(None).cast(df.schema)
    one = table.groupBy(F.col(start).alias("_t")).agg(F.min(F.struct(*table.columns)).alias("_entry"))
    both = one.select("_t", F.lit(0).alias("_kind"), none(rows).alias("_row"), "_entry").unionByName(rows.select(F.col(at).cast(table.schema[start].dataType).alias("_t"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), none(table).alias("_entry")))
    # rows of one time may be most of all, so they are cut apart by a hash
    hashed = [f"_row.`{f.name}`" for f in rows.schema if "map<" not in f.dataType.simpleString()]
    keyed = both.withColumn("_salt", F.xxhash64(*hashed))
    held = written(keyed.repartitionByRange("_t", "_kind", "_salt").withColumn("_range", F.spark_partition_id()), "ranges")
    last = lambda w: F.last("_entry", ignorenulls=True).over(w)
    told = held.withColumn("_own", last(Window.partitionBy("_range").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)))
    ends = held.groupBy("_range").agg(F.max_by("_entry", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_entry"))  # one row a range
    carried = ends.withColumn("_before", last(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", "_before")
    found = told.where("_kind = 1").join(carried, "_range").withColumn("_own", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_before")))
    return found.select("_row.*", "_own.*")


def lagged(rows: DataFrame, group: str, order: list[str], n: int, **values: str) -> DataFrame:
    """``rows`` with columns of the row that is ``n`` places before them in their group (null if there is none). Rows are ranked in ranges
    and joined by rank, so that a group may hold most of them."""
    placed = ranked(rows, group, *order)
    before = placed.select(group, (F.col("place") + n).alias("place"), *(F.col(c).alias(name) for name, c in values.items()))
    return placed.join(before, [group, "place"], "left").select(*rows.columns, *values)


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with their ``place`` in the order of ``keys``, from 1: sorted in ranges, whose counts give each its offset."""
    at = F.monotonically_increasing_id()  # range << 33 | place in it
    held = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at), "ranked")
    part = F.shiftright("_at", 33)
    offset, offsets = 0, []
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a range
        offsets.append((r["part"], offset))
        offset += r["count"]
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint"))
    placed = held.withColumn("_part", part).join(known, "_part")
    return placed.withColumn("place", F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).select(*rows.columns, "place")


def anti_exact(rows: DataFrame, gate: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the gate. An empty gate, or one with a null or repeated key, is an error, not a pass."""
    unnamed = reduce(or_, (F.col(k).isNull() for k in keys))
    n, distinct, nulls = gate.agg(F.count(F.lit(1)), F.countDistinct(*keys), F.count_if(unnamed)).first()
    if not n or nulls or distinct != n:
        raise ValueError(f"the gate has {n} rows, {distinct} keys and {nulls} nulls")
    return rows.join(gate.select(*keys), keys, "left_anti")
