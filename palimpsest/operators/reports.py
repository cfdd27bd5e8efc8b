"""Reports over evidence: groups of rows that contradict one another, and how far child headers are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFLICT, MIXED, MALFORMED, EPOCH = "conflicting_prev", "mixed_classification", "malformed", "epoch_mismatch"
#: Rows that a group shows, and parts that a large group is ranked in before its parts meet.
SAMPLES, PARTS = 20, 64


def anomalies(rows: DataFrame, fault: Column, expected_bits: Column, samples: int = SAMPLES) -> DataFrame:
    """(kind, key, n, variants, first_row, samples), from ``rows`` (id, hash, prev, classification, bits), read once: hashes with several predecessors, hashes with several classes, rows with
    a ``fault`` (by its text), and rows whose bits differ from ``expected_bits`` (by both). ``variants`` are a conflict's values, sorted; ``samples`` the smallest ids.

    A group may hold most rows: it is counted before the shuffle, and its samples are ranked in parts first."""
    one = lambda when, kind, key, value: F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value")))
    none = F.lit(None).cast("string")
    told = F.array_compact(F.array(
        one(F.col("prev").isNotNull(), CONFLICT, F.col("hash"), F.col("prev")),
        one(F.col("classification").isNotNull(), MIXED, F.col("hash"), F.col("classification")),
        one(fault.isNotNull(), MALFORMED, fault, none),
        one(expected_bits.isNotNull() & (F.col("bits") != expected_bits), EPOCH, F.concat(F.col("bits"), F.lit(" for "), expected_bits), none),
    ))
    each = rows.select("id", F.explode(told).alias("a")).select("id", "a.*")
    values = each.groupBy("kind", "key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_row"))
    groups = values.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"), F.array_sort(F.collect_set("value")).alias("variants"))
    groups = groups.where(F.col("kind").isin(MALFORMED, EPOCH) | (F.size("variants") > 1))
    members = each.join(groups.select("kind", "key"), ["kind", "key"], "left_semi").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    place = lambda *by: F.row_number().over(Window.partitionBy("kind", "key", *by).orderBy("id"))
    some = members.withColumn("place", place("part")).where(F.col("place") <= samples).withColumn("place", place()).where(F.col("place") <= samples)
    shown = some.groupBy("kind", "key").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return groups.join(shown, ["kind", "key"]).select("kind", "key", "n", F.array_join("variants", "|").alias("variants"), "first_row", F.array_join(F.transform("samples", lambda x: x.cast("string")), "|").alias("samples"))


def child_coverage(rows: DataFrame, child_fields: tuple[str, ...], reason: Column) -> DataFrame:
    """(chain, total_rows, hydrated_rows, unrecoverable_rows, reasons, min_child_time, max_child_time, delta_status, delta_coverage, min_delta, max_delta). A row is hydrated if all ``child_fields`` are
    filled; ``reason`` tells why another isn't. Deltas are child times minus ``btc_time`` where there is one: all zero is ``degenerate``; ``incomplete`` where a hydrated row has none."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    whole = F.lit(True)
    for c in child_fields:
        whole = whole & filled(c)
    told = rows.select("chain", whole.alias("whole"), F.when(whole, F.col("child_block_time").cast("bigint")).alias("time"), F.when(whole & filled("btc_time"), F.col("child_block_time").cast("bigint") - F.col("btc_time").cast("bigint")).alias("delta"), F.when(~whole, reason).alias("reason"))
    by_reason = told.groupBy("chain", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("hydrated"), F.min("time").alias("low"), F.max("time").alias("high"), F.count("delta").alias("deltas"), F.min("delta").alias("d0"), F.max("delta").alias("d1"))
    entries = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
    out = by_reason.groupBy("chain").agg(
        F.sum("n").alias("total_rows"), F.sum("hydrated").alias("hydrated_rows"), F.to_json(F.map_from_entries(entries)).alias("reasons"), F.min("low").alias("min_child_time"), F.max("high").alias("max_child_time"),
        F.sum("deltas").alias("deltas"), F.min("d0").alias("min_delta"), F.max("d1").alias("max_delta"),
    )
    hydrated = F.col("hydrated_rows")
    status = F.when(hydrated == 0, "not_applicable").when(F.col("deltas") != hydrated, "incomplete").when((F.col("min_delta") == 0) & (F.col("max_delta") == 0), "degenerate").otherwise("non_degenerate")
    return out.select("chain", "total_rows", "hydrated_rows", (F.col("total_rows") - hydrated).alias("unrecoverable_rows"), "reasons", "min_child_time", "max_child_time", status.alias("delta_status"), F.concat(F.col("deltas").cast("string"), F.lit("/"), hydrated.cast("string")).alias("delta_coverage"), "min_delta", "max_delta")
