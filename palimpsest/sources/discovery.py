"""Which files hold the evidence of each chain: found by their names in a listing, whose contents aren't read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import whole_path

# What each kind of file is called after its chain, the folder of its family in an archive, and how it is told of.
KINDS = (
    # role, rank of the kind, suffix, family, folder in the repository's data, source_kind, artifact_scope
    ("primary", 0, "stale_blocks", "classified", "", "full_inventory", "full_classifier_inventory"),
    ("primary", 1, "validated_stales", "validated", "validated-stales/", "validated_stales", "stale_only_publication"),
    ("canonical", 0, "canonical_blocks", "classified", "", "canonical_blocks", "canonical_blocks"),
    ("unknown", 0, "unknown_blocks", "classified", "", "full_inventory", "full_classifier_inventory"),
)


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, ordinal, path): the CSV files under each root, whose order counts; ``path`` is relative. A table of several part files is one. A file
    without any byte counts as none."""
    parts = []
    for n, root in enumerate(roots):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
        below = F.substring("path", len(whole_path(spark, root)) + 2, 1 << 30)
        parts.append(found.select(F.lit(root).alias("root"), F.lit(n).alias("ordinal"), F.regexp_extract(below, r"^(.*?\.csv)(/.*)?$", 1).alias("path")).distinct())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rank(chain: Column, path: Column, is_data: Column, suffix: str, family: str, data_folder: str) -> Column:
    """The place of a path among those where a chain's file may lie; null if it doesn't lie at one."""
    file = F.concat(chain, F.lit(f"_{suffix}.csv"))
    archive = F.when(path == F.concat(chain, F.lit(f"/{family}/"), file), 0).when(path == F.concat(chain, F.lit("/"), file), 1).when(path == file, 2)
    return F.when(~is_data, archive).otherwise(F.when(path == F.concat(F.lit(data_folder), file), 3))


def sources(chains: DataFrame, files: DataFrame, data_root: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """(chain, role, path, source_kind, artifact_scope, provenance): for every chain of ``chains`` its primary file (a whole inventory before validated stales;
    missing without either) and, where they exist, its canonical and unknown companions, each found by itself. Of several places the first root's comes
    first, there the family's folder, then the chain's, then the root; the repository's data come last. ``overrides`` name a path in an archive
    that goes before a chain's whole inventory."""
    chain, path, is_data = F.col("chain"), F.col("path"), F.col("root") == data_root
    named = F.regexp_extract(path, rf"([^/]*)_({'|'.join(k[2] for k in KINDS)})\.csv$", 1)
    own = files.withColumn("chain", F.when(named != "", named))
    for name, place in (overrides or {}).items():
        own = own.withColumn("chain", F.when(~is_data & (path == f"{name}/{place}"), name).otherwise(F.col("chain")))
    own = own.join(chains.select("chain").distinct(), "chain")
    found = []
    for role, kind_rank, suffix, family, data_folder, kind, scope in KINDS:
        rank = _rank(chain, path, is_data, suffix, family, data_folder)
        if role == "primary" and kind_rank == 0:
            for name, place in (overrides or {}).items():
                rank = F.when(~is_data & (chain == name) & (path == f"{name}/{place}"), -1).otherwise(rank)
        place = F.struct(F.lit(kind_rank).alias("kind"), is_data.alias("data"), F.when(is_data, 0).otherwise(F.col("ordinal")).alias("ordinal"), rank.alias("rank"))
        whole = F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), path)
        provenance = F.when(is_data, "repo-data").otherwise("archive")
        found.append(own.withColumn("rank", rank).where("rank is not null").select(chain, F.lit(role).alias("role"), place.alias("place"), F.struct(whole.alias("path"), F.lit(kind).alias("source_kind"), F.lit(scope).alias("artifact_scope"), provenance.alias("provenance")).alias("source")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = every.groupBy("chain", "role").agg(F.min_by("source", "place").alias("s")).select("chain", "role", "s.*")
    missing = chains.select("chain").distinct().join(best.where("role = 'primary'"), "chain", "left_anti")
    none = missing.select("chain", F.lit("primary").alias("role"), F.lit(None).cast("string").alias("path"), F.lit("missing").alias("source_kind"), F.lit("missing").alias("artifact_scope"), F.lit("").alias("provenance"))
    return best.unionByName(none)
