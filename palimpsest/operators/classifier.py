"""Classification of parent headers that side chains preserve, by joins with a snapshot of the main chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexbytes import bits_of, display_hash, is_hex, meets, target
from ..sources.folder import written
from . import gates as G
from .matching import first_by

BCH_FORK = 478_559  # fixed value: the height from which another chain shares the history


def worked(rows: DataFrame, order: str) -> DataFrame:
    """Candidates whose header meets its own target, the first row of each hash; a claim that differs from the header's bytes fails.

    ``rows``: header_hex, hash, bits, and more. Of the header only what is claimed is read: each field of a struct of all would find all of them again."""
    header = F.col("header_hex")
    same = F.coalesce(is_hex(header, 80) & (display_hash(header) == F.col("hash")) & (bits_of(header) == F.col("bits")), F.lit(False))
    checked = rows.withColumn("hash", F.when(same, F.col("hash")).otherwise(F.raise_error(F.lit("a candidate's fields differ from its header")).cast("string")))
    return first_by(checked.where(meets(F.col("hash"), target(F.col("bits")))), ["hash"], F.col(order))


def placed(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """``rows`` with classification (canonical, stale, unknown), btc_height, and the parent's confirmations and median time.

    ``canonical``: hash, height, mediantime, confirmations."""
    main = canonical.where("confirmations > 0").select("hash", F.col("height").alias("_main"))
    parents = canonical.select(F.col("hash").alias("prev"), F.col("height").alias("_parent"), F.col("mediantime").alias("parent_mtp"), F.col("confirmations").alias("parent_confirmations"))
    joined = rows.join(main, "hash", "left").join(parents, "prev", "left")
    kind = F.when(F.col("_main").isNotNull(), "canonical").when(F.col("_parent").isNotNull(), "stale").otherwise("unknown")
    return joined.withColumns({"classification": kind, "btc_height": F.coalesce("_main", F.col("_parent") + 1)}).drop("_main", "_parent")


def overwritten(now: Column, then: Column) -> Column:
    """A later verdict replaces an earlier one, unless it is UNKNOWN and the earlier one is a rejection."""
    return F.when(then.isNull() | (now.startswith("REJECTED") & then.startswith("UNKNOWN")), now).otherwise(then)


def validated(rows: DataFrame, expected: DataFrame, coinbase_rules: bool = True) -> DataFrame:
    """Stale rows of ``placed`` with expected_nbits, validation_status and rules_violated; others have none.

    ``expected``: height, expected. ``rows``: bits, header_hex, t, declared, script."""
    rows = rows.join(expected.select(F.col("height").alias("btc_height"), F.col("expected").alias("expected_nbits")), "btc_height", "left")
    c = F.col
    bits = G.bits_gate(c("btc_height"), c("bits"), c("expected_nbits"))
    place = G.placement_gate(c("prev"), c("btc_height") - 1, c("parent_confirmations"), c("btc_height"))
    script = c("script") if coinbase_rules else F.lit(None).cast("string")
    declared = c("declared") if coinbase_rules else F.lit(None).cast("string")
    rows, e = G.bound(rows, c("btc_height"), c("header_hex"), declared, script)
    context = G.first_failure(e, c("t"), c("parent_mtp")) if coinbase_rules else F.coalesce(G.time_gate(c("t"), c("parent_mtp")), G.version_gate(c("btc_height"), c("header_hex")))
    stale = c("classification") == "stale"
    rows = rows.withColumn("_bits", bits).withColumn("_context", F.coalesce(place, context))
    status = F.when(stale, F.when(c("_context") == G.PLACEMENT, G.PLACEMENT).otherwise(overwritten(c("_bits"), c("_context"))))
    rules = G.violations(e, c("t"), c("parent_mtp"), F.lit(None).cast("boolean"))
    rows = rows.withColumns({"validation_status": status, "expected_nbits": F.when(stale, c("expected_nbits"))}).drop("_bits", "_context")
    return G.unbound(rows.withColumn("rules_violated", F.when(stale & c("validation_status").startswith("REJECTED"), rules)))


def routed(rows: DataFrame) -> DataFrame:
    """Rejected stale rows go to unknown or error_block where their rejection says so."""
    goes = G.routed(F.col("validation_status"), F.col("rules_violated"), F.col("bits"), F.col("expected_nbits"), F.col("hash"))
    rejected = F.col("validation_status").startswith("REJECTED")
    rows = rows.withColumn("classification", F.when(rejected, F.coalesce(goes, F.col("classification"))).otherwise(F.col("classification")))
    return rows.withColumn("rules_violated", F.when(F.col("classification") == "error_block", F.col("rules_violated")))


def classified(rows: DataFrame, canonical: DataFrame, expected: DataFrame, order: str = "id", coinbase_rules: bool = True, refuse_unknown: bool = False) -> DataFrame:
    """All phases. Candidates that have their own work, few of all, are written after placement and after validation, as the gates'
    expressions are long and routing names the status often. ``refuse_unknown``: a stale row whose validation is UNKNOWN fails the run, so that it replaces no output."""
    out = routed(written(validated(written(placed(worked(rows, order), canonical), "placed"), expected, coinbase_rules), "validated"))
    if refuse_unknown:
        bad = (F.col("classification") == "stale") & F.col("validation_status").startswith("UNKNOWN")
        out = out.withColumn("validation_status", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("stale validation is incomplete")).cast("string")).otherwise(F.col("validation_status")))
    return out


def published(rows: DataFrame) -> DataFrame:
    """Canonical and VALID stale rows with nbits_match and post_bch_fork, as a family's publication has them."""
    keep = (F.col("classification") == "canonical") | ((F.col("classification") == "stale") & F.col("validation_status").startswith("VALID"))
    match = F.when(F.col("classification") == "canonical", True).otherwise(F.col("bits") == F.col("expected_nbits"))
    status = F.when(F.col("classification") == "canonical", "VALID (canonical block)").otherwise(F.col("validation_status"))
    return rows.where(keep).withColumns({"nbits_match": match, "post_bch_fork": F.col("btc_height") >= BCH_FORK, "validation_status": status})
