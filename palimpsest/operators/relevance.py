"""The relevance of evidence rows: an ordered list of conditions, of which the first that holds gives bucket and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexbytes import is_hex, meets, target
from .matching import asof_backward


def with_epoch_bits(rows: DataFrame, at: str, epochs: DataFrame, interval: int = 2016) -> DataFrame:
    """``rows`` with near_bits, the bits that may hold at their time: of its epoch and of the two beside it; and last_epoch, the last
    time that ``epochs`` (height, time, bits) knows. Times outside the table have no epoch."""
    table = epochs.select("time", F.col("height").alias("_height"), F.col("bits").alias("_bits"))
    span = epochs.agg(F.max("time").alias("last_epoch"))
    rows = asof_backward(rows.join(F.broadcast(span)), at, table, "time").drop("time")
    inside = F.col(at) <= F.col("last_epoch")
    rows = rows.withColumns({"_height": F.when(inside, F.col("_height")), "epoch_bits": F.when(inside, F.col("_bits"))}).drop("_bits")
    for name, shift in (("_before", interval), ("_after", -interval)):
        near = epochs.select((F.col("height") + shift).alias("_height"), F.col("bits").alias(name))
        rows = rows.join(near, "_height", "left")
    near = F.array_compact(F.array("epoch_bits", "_before", "_after"))
    return rows.withColumn("near_bits", near).drop("_height", "_before", "_after")


def relevance(hash_: Column, prev: Column, bits: Column, time: Column, kind: Column, status: Column, sidecar: Column, known_main: Column, known_stale: Column, rejected: Column, strict_bits: Column, strict_note: Column, epoch_bits: Column, near_bits: Column, last_epoch: Column) -> Column:
    """A struct (bucket, reason). Verdicts of validation count only for stale rows; UNKNOWN is no rejection of an unknown row."""
    true = lambda c: F.coalesce(c, F.lit(False))
    stale = kind == "stale"
    rules: list[tuple[Column, str | None, str]] = [
        (~true(is_hex(hash_, 32)), "excluded", "malformed_header_hash"),
        (~true(is_hex(prev, 32)), "excluded", "malformed_prev_hash"),
        (~meets(hash_, target(bits)), "excluded", "pow_target_mismatch"),
        (sidecar & (status == "VALID_STALE_DESCENDANT") & (kind == "stale_descendant"), None, "valid_stale_descendant"),
        (sidecar, "excluded", "known_rejected_stale_descendant"),
        (stale & (status != "") & ~status.startswith("VALID"), "excluded", "validation_rejected"),
        (kind == "canonical", "excluded", "source_canonical"),
        (kind == "near", "excluded", "source_near"),
        (stale & true(known_main), "excluded", "known_mainchain"),
        (stale, None, "valid_direct_stale"),
        (~kind.isin("unknown", "orphan"), "excluded", "insufficient_evidence"),
        (true(rejected), "excluded", "known_rejected_stale_descendant"),
        (true(known_stale), "excluded", "known_stale_hash"),
        (true(known_main), "excluded", "known_mainchain"),
        (true(strict_note.endswith("_out_of_epoch_cache_range")), "pending", "above_nbits_height_horizon"),
        (strict_bits.isNotNull() & (strict_bits == bits), "strict_btc_orphan", "strict_height_nbits_match"),
        (strict_bits.isNotNull(), "excluded", "non_btc_epoch_bits"),
        (last_epoch.isNull(), "excluded", "insufficient_epoch_cache"),
        (time.isNull(), "excluded", "insufficient_evidence"),
        (time > last_epoch, "pending", "above_nbits_time_horizon"),
        (F.array_contains(near_bits, bits), "weak_btc_orphan", "timestamp_epoch_nbits_match"),
        (epoch_bits.isNotNull(), "excluded", "non_btc_epoch_bits"),
    ]
    pair = lambda bucket, reason: F.struct(F.lit(bucket).cast("string").alias("bucket"), F.lit(reason).alias("reason"))
    verdict = pair("excluded", "insufficient_evidence")
    for condition, bucket, reason in reversed(rules):
        verdict = F.when(condition, pair(bucket, reason)).otherwise(verdict)
    return verdict
