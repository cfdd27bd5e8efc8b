"""A reference table of difficulty epochs that grows with the chain: a map of bits, a list of headers, and a manifest, published at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .family import Floor, current, publish_family, read_family

COLUMNS = ["height", "bits", "hash", "time"]


def refresh_reference(spark: SparkSession, source: DataFrame, root: str, tip: int, confirmations: int = 6, interval: int = 2016) -> dict[str, DataFrame]:
    """Brings the tables under ``root`` up to ``confirmations`` blocks below the tip and returns them: ``epochs`` (COLUMNS and the number of the refresh that fetched the row),
    ``headers`` (epochs and the highest block that counts, where it starts none), ``manifest`` (one row).

    ``source`` (COLUMNS, each height once) is asked only for starts of epochs that aren't kept, the last kept height, and that highest block. If the last kept hash is no longer on the chain,
    or the source lacks its height, the refresh is refused and what is published stays.
    """
    if confirmations < 0 or tip < confirmations:
        raise ValueError("the tip lies below the confirmations that are asked for")
    final = tip - confirmations
    start = final - final % interval
    number, kept = 1, None
    if current(spark, root):
        published = read_family(spark, root)
        number = published["manifest"].first()["refresh"] + 1
        kept = published["epochs"].where(F.col("height") <= start)
        last = kept.agg(F.max("height").alias("height"), F.max_by("hash", "height").alias("kept")).where("height is not null")
        wrong = last.join(source.select("height", "hash"), "height", "left").where("not (kept <=> hash)").collect()
        if wrong:
            raise ValueError(f"the kept hash at {wrong[0]['height']} is not on the chain; nothing is refreshed")
    fresh = source.where((F.col("height") % interval == 0) & (F.col("height") <= start)).select(*COLUMNS)
    if kept is not None:
        fresh = fresh.join(kept.select("height"), "height", "left_anti")
    fresh = fresh.withColumn("refresh", F.lit(number))
    epochs = fresh if kept is None else kept.unionByName(fresh)
    horizon = source.where(F.col("height") <= final).agg(*(F.max_by(c, "height").alias(c) for c in COLUMNS[1:]), F.max("height").alias("height")).where("height is not null")
    headers = epochs.select(*COLUMNS).unionByName(horizon.where(F.col("height") % interval != 0).select(*COLUMNS))
    manifest = epochs.agg(F.count(F.lit(1)).alias("epoch_rows")).select("epoch_rows", F.lit(interval).alias("interval"), F.lit(confirmations).alias("confirmations"), F.lit(tip).alias("tip"), F.lit(final).alias("final"), F.lit(number).alias("refresh"))
    # a chain that has become shorter takes epochs off the end, so only a longer one must hold all that is published
    floors = {"epochs": Floor(("height", "hash"))} if kept is None or kept.count() == published["epochs"].count() else {}
    publish_family({"epochs": epochs, "headers": headers, "manifest": manifest}, root, floors)
    return read_family(spark, root)
