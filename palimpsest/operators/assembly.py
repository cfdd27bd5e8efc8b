"""Rows of the error-block data set, put together from the sources that their group names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["height", "hash", "header_hex", "expected_nbits", "script", "provenance", "source_group", "error"]


def assembled(seeds: DataFrame, groups: DataFrame, evidence: DataFrame, upstream: DataFrame, recovered: DataFrame, self_contained: tuple[str, ...]) -> DataFrame:
    """COLUMNS of every seed (height, hash, header_hex, expected_nbits, script, provenance). One whose provenance starts with a prefix in ``self_contained`` stands as it is. Of the others
    ``groups`` (height, source_group, chain; and hash, where several rows share a height) says where their header is: A in the evidence of the chain, with its script and bits; B there too, but the script is the seed's; C in ``upstream``;
    all that it doesn't name are D, in ``recovered``. ``evidence``: chain, height, hash, header_hex, expected_nbits, script; ``upstream``: height, hash, header_hex; ``recovered``: those and
    ``source``. A seed whose source lacks it has an ``error`` and no header."""
    own = F.lit(False)
    for prefix in self_contained:
        own = own | F.startswith(F.coalesce("provenance", F.lit("")), F.lit(prefix))
    key = ["height", "hash"]
    by = [c for c in key if c in groups.columns]
    g = groups.select(*by, F.col("source_group").alias("_group"), F.col("chain").alias("_chain"))
    s = seeds.withColumn("_own", own).join(g, by, "left").withColumn("_group", F.coalesce("_group", F.lit("D")))
    one = lambda df, by, *rest: df.groupBy(*by).agg(F.min(F.struct(*rest)).alias("_x")).select(*by, "_x.*")  # noqa: E731  of several, the smallest
    e = one(evidence.withColumn("_chain", F.col("chain")), ["_chain", *key], F.col("header_hex").alias("_e"), F.col("expected_nbits").alias("_bits"), F.col("script").alias("_script"))
    u = one(upstream, key, F.col("header_hex").alias("_u"))
    r = one(recovered, key, F.col("header_hex").alias("_r"), F.col("source").alias("_source"))
    j = s.join(e, ["_chain", *key], "left").join(u, key, "left").join(r, key, "left")
    group, c = F.col("_group"), F.col
    header = F.when(c("_own"), c("header_hex")).when(group.isin("A", "B"), c("_e")).when(group == "C", c("_u")).otherwise(c("_r"))
    where = F.when(c("_own"), c("provenance")).when(group.isin("A", "B"), F.concat(F.lit("full-evidence:"), c("_chain"))).when(group == "C", "upstream").otherwise(c("_source"))
    bits = F.when(c("_own"), c("expected_nbits")).when(group.isin("A", "B"), F.trim(F.coalesce("_bits", F.lit("")))).otherwise("")
    script = F.when(~c("_own") & (group == "A"), c("_script")).otherwise(c("script"))
    error = F.when(header.isNull(), F.concat(F.lit("no header in "), F.when(c("_own"), "the row").when(group.isin("A", "B"), F.concat(F.lit("the evidence of "), F.coalesce("_chain", F.lit("no chain")))).when(group == "C", "upstream").otherwise("what was recovered")))
    return j.select(*key, header.alias("header_hex"), bits.alias("expected_nbits"), script.alias("script"), where.alias("provenance"), F.when(c("_own"), "self").otherwise(group).alias("source_group"), error.alias("error"))


def upserted(rows: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``newer`` in place of rows of the same keys; the columns are those of ``rows``."""
    return rows.join(newer.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(newer.select(*rows.columns))
