"""Claims of broken rules against what the bytes prove, sweeps for rows that nobody claimed, and recovery of identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexbytes import display_hash, meets, target


def claim_failures(claimed: Column, derived: Column, reason: Column) -> Column:
    """What is wrong with a row's claims, as texts: rules that the bytes don't prove, rules that they prove and the row omits, no claim at
    all, and a reason other than the first rule."""
    unproven = F.transform(F.array_except(claimed, derived), lambda r: F.concat(F.lit("not proven: "), r))
    omitted = F.transform(F.array_except(derived, claimed), lambda r: F.concat(F.lit("not claimed: "), r))
    first = F.get(claimed, F.lit(0))
    others = F.array_compact(F.array(F.when(F.size(claimed) == 0, "no rule claimed"), F.when((F.size(claimed) > 0) & (F.coalesce(reason, F.lit("")) != first), "reason is not the first rule")))
    return F.concat(unproven, omitted, others)


def swept(rows: DataFrame, finding: Column, dataset: DataFrame, name: str) -> DataFrame:
    """Rows with a finding that meet their own target and that of the main chain at their height, and aren't in ``dataset`` (height, hash).

    ``rows``: hash, height, bits, expected."""
    known = dataset.select("height", "hash").distinct()
    own = meets(F.col("hash"), target(F.col("bits")))
    main = meets(F.col("hash"), target(F.col("expected")))
    return rows.where(F.coalesce(finding, F.lit(False)) & own & F.coalesce(main, F.lit(False))).join(known, ["height", "hash"], "left_anti").withColumn("sweep", F.lit(name))


def recovery_targets(evidence: DataFrame) -> DataFrame:
    """(chain, btc_header_hash, child_height) of rows that aren't canonical; a hash with two heights fails."""
    per = evidence.where("classification <> 'canonical'").groupBy("chain", "btc_header_hash").agg(F.min("child_height").alias("child_height"), F.max("child_height").alias("_high"))
    height = F.when(F.col("child_height") == F.col("_high"), F.col("child_height")).otherwise(F.raise_error(F.lit("a hash has two child heights")).cast("bigint"))
    return per.withColumn("child_height", height).drop("_high")


def recovered(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``targets`` with the child block that a snapshot (chain, height, block_hash, parent_header) has at their height, if its
    parent header hashes to the target; else a note says why not."""
    joined = targets.join(blocks.withColumn("_found", F.lit(True)).withColumnRenamed("height", "child_height"), ["chain", "child_height"], "left")
    derived = display_hash(F.col("parent_header"))
    note = (
        F.when(F.col("_found").isNull(), "block_not_found")
        .when(F.coalesce("parent_header", F.lit("")) == "", "no_parent_header")
        .when(derived != F.col("btc_header_hash"), F.concat(F.lit("parent_mismatch:"), derived))
        .otherwise("")
    )
    joined = joined.withColumn("note", note)
    good = F.col("note") == ""
    return joined.select("chain", "btc_header_hash", "child_height", F.when(good, F.col("block_hash")).alias("child_block_hash"), F.when(good, "parent_header_match").otherwise("").alias("verification"), "note")


def promoted(walks: DataFrame, nodes: DataFrame, roots: DataFrame, epoch_bits: DataFrame, push: Column) -> DataFrame:
    """Descendants of known stale roots, with their inferred height and what speaks against them, in order.

    ``walks``: node, terminal, depth, kind as ``ancestry.walk`` gives; ``nodes``: node, hash, bits, and what ``push`` needs; ``roots``: node,
    height (several observations, the least counts); ``epoch_bits``: epoch, expected."""
    heights = roots.groupBy(F.col("node").alias("terminal")).agg(F.min("height").alias("root_height"))
    known = walks.where("kind = 'known'").join(heights, "terminal", "left").join(nodes, "node")
    known = known.withColumn("btc_height", F.col("root_height") + F.col("depth"))
    known = known.withColumn("epoch", F.col("btc_height") - F.col("btc_height") % 2016).join(epoch_bits, "epoch", "left")
    failures = F.array_compact(F.array(
        F.when(~meets(F.col("hash"), target(F.col("bits"))), "pow_target_mismatch"),
        F.when(F.col("bits") != F.col("expected"), "nbits_epoch_mismatch"),
        F.when(F.col("root_height").isNull(), "missing_root_height"),
        F.when(push != F.col("btc_height"), "bip34_height_mismatch"),
    ))
    known = known.withColumn("failures", failures)
    status = F.when(F.size("failures") == 0, "VALID_STALE_DESCENDANT").otherwise(F.concat(F.lit("REJECTED: "), F.array_join("failures", "|")))
    return known.withColumn("validation_status", status)


def audit_verdict(failures: Column, root_known: Column, parent_is_main: Column) -> Column:
    """Whether a rejection stands on the height push alone, at a place in a fork that is proven."""
    only = (F.size(failures) == 1) & F.array_contains(failures, "bip34_height_mismatch")
    return F.when(only & root_known & F.coalesce(parent_is_main, F.lit(False)), "confirmed_height_mismatch").when(only, "unproven_place").otherwise("other_failures")
