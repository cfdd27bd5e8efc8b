"""Queries of what is published: families of tables, their floors and contracts, and the sources that exports are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.discovery import listing, sources
from ..sources.family import CONTRACT, CONTRACT_SCHEMA, Floor, floor_report, lacking, publish_family, read_family
from ..sources.folder import fresh_path, written
from .evidence import headers, with_h
from .registry import Registry

R = Registry()
query = R.query
col = F.col


def _family(rows: DataFrame) -> dict[str, DataFrame]:
    told = rows.withColumn("kind", F.when(col("id") % 4 == 0, "canonical").when(col("id") % 4 == 1, "stale"))
    return {k: told.where(col("kind") == k).select("id", "chain", "hash", "kind") for k in ("canonical", "stale")}


@query(with_h("SELECT CASE id % 4 WHEN 0 THEN 'canonical' ELSE 'stale' END AS table_name, id, chain, hash, 1 AS refused FROM h WHERE id % 4 < 2 AND id % 16 < 14"))
def k03_published_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables published at once, three times: the second time one of them lacks rows, so both stay as they were."""
    path = fresh_path(spark, "family")
    h = written(headers(spark, sf_dir).select("id", "chain", "hash"), "headers")
    floors = {k: Floor(("hash",), "chain") for k in ("canonical", "stale")}
    refused = 0
    for kept in ("id % 16 < 12", "id % 16 between 5 and 13", "id % 16 < 14"):
        try:
            publish_family(_family(h.where(kept)), path, floors)
        except ValueError:
            refused += 1
    told = read_family(spark, path)
    parts = [df.select(F.lit(name).alias("table_name"), "id", "chain", "hash", F.lit(refused).alias("refused")) for name, df in told.items()]
    return parts[0].unionByName(parts[1])


@query(with_h("SELECT CASE id % 4 WHEN 0 THEN 'canonical' ELSE 'stale' END AS table_name, count(*) AS rows, true AS all_bytes FROM h WHERE id % 4 < 2 GROUP BY 1"))
def k05_published_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a published family promises: the rows of each table, and a digest of every byte of its files."""
    path = fresh_path(spark, "contract")
    folder = publish_family(_family(headers(spark, sf_dir).select("id", "chain", "hash")), path)
    contract = spark.read.schema(CONTRACT_SCHEMA).json(f"{folder}/{CONTRACT}")
    read_family(spark, path)  # fails if a byte differs
    files = contract.where("file is not null").groupBy("table").agg((F.min(F.length("sha256")) == 64).alias("all_bytes"))
    return contract.where("file is null").join(files, "table").select(col("table").alias("table_name"), "rows", "all_bytes")


@query(with_h("""SELECT coalesce(o.chain, w.chain) AS kind, coalesce(published, 0) AS published, coalesce(staged, 0) AS staged, coalesce(lacking, 0)::BIGINT AS lacking FROM (SELECT chain, count(*) AS published FROM h WHERE id % 10 IN (3, 4) GROUP BY 1) o
 FULL JOIN (SELECT chain, count(*) AS staged FROM h WHERE id % 20 IN (3, 4, 13) OR id % 10 = 7 GROUP BY 1) w USING (chain) LEFT JOIN (SELECT chain, count(*) AS lacking FROM h WHERE id % 20 = 14 GROUP BY 1) g ON g.chain = o.chain"""))
def a11_publication_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is staged against what is published, by chain: counts, and published rows that are missing, as often as they stood there."""
    h = headers(spark, sf_dir).select("id", "chain", "hash")
    return floor_report(h.where("id % 10 in (3, 4)"), h.where("id % 20 in (3, 4, 13) or id % 10 = 7"), Floor(("hash",), "chain"))


@query(with_h("SELECT chain, event_type, n FROM (SELECT chain, event_type, count_if(id % 10 IN (3, 4)) - count_if(id % 10 = 5) AS n FROM h GROUP BY 1, 2) WHERE n > 0"))
def a11_missing_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that stand more often in the published table than in the new one."""
    h = headers(spark, sf_dir).select("id", "chain", "event_type")
    return lacking(h.where("id % 10 in (3, 4)"), h.where("id % 10 = 5"), ("chain", "event_type"))


_PLACES = """pl AS (SELECT DISTINCT user_id % 40 AS k FROM events),
f AS (SELECT 'c' || k AS chain, k, k % 2 = 0 AS in_archive, k % 3 = 0 AS in_chain, k % 5 < 3 AS in_data, k % 4 = 1 AS validated, k % 7 = 0 AS second FROM pl)"""


@query(f"""WITH {_PLACES}, p AS (SELECT chain, CASE WHEN in_archive THEN 'one/' || chain || '/classified/' || chain || '_stale_blocks.csv' WHEN in_chain THEN 'one/' || chain || '/' || chain || '_stale_blocks.csv' WHEN second THEN 'two/' || chain || '_stale_blocks.csv' WHEN in_data THEN 'data/' || chain || '_stale_blocks.csv' END AS whole,
  CASE WHEN validated THEN 'data/validated-stales/' || chain || '_validated_stales.csv' END AS part, CASE WHEN second THEN 'two/' || chain || '/classified/' || chain || '_canonical_blocks.csv' END AS canonical, CASE WHEN in_chain AND validated THEN 'data/' || chain || '_unknown_blocks.csv' END AS unknown FROM f)
SELECT chain, 'primary' AS role, coalesce(whole, part) AS path, CASE WHEN whole IS NOT NULL THEN 'full_inventory' WHEN part IS NOT NULL THEN 'validated_stales' ELSE 'missing' END AS source_kind, CASE WHEN whole IS NULL AND part IS NULL THEN '' WHEN coalesce(whole, part) LIKE 'data/%' THEN 'repo-data' ELSE 'archive' END AS provenance FROM p
UNION ALL SELECT chain, 'canonical', canonical, 'canonical_blocks', 'archive' FROM p WHERE canonical IS NOT NULL
UNION ALL SELECT chain, 'unknown', unknown, 'full_inventory', 'repo-data' FROM p WHERE unknown IS NOT NULL""")
def s14_discovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that lie in two archives and in the data, and the ones that count for each chain."""
    path = fresh_path(spark, "sources")
    k, name = col("k"), F.concat(F.lit("c"), col("k").cast("string"))
    chains = spark.read.parquet(f"{sf_dir}/events.parquet").select((col("user_id") % 40).alias("k")).distinct()
    at = lambda *parts: F.concat(*(F.lit(p) if p else name for p in parts))
    places = F.array_compact(F.array(
        F.when(k % 2 == 0, at("one/", "", "/classified/", "", "_stale_blocks.csv")), F.when(k % 3 == 0, at("one/", "", "/", "", "_stale_blocks.csv")), F.when(k % 7 == 0, at("two/", "", "_stale_blocks.csv")), F.when(k % 5 < 3, at("data/", "", "_stale_blocks.csv")),
        F.when(k % 4 == 1, at("data/validated-stales/", "", "_validated_stales.csv")), F.when(k % 7 == 0, at("two/", "", "/classified/", "", "_canonical_blocks.csv")), F.when((k % 3 == 0) & (k % 4 == 1), at("data/", "", "_unknown_blocks.csv")), at("data/", "", "_notes.csv"),
    ))
    files = chains.select(F.explode(places).alias("place"))
    for r in files.select("place").collect():  # a few for each of forty chains at most; only names count
        sink = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['place']}")
        out = sink.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(sink)
        out.write(bytearray(b"hash\n"))
        out.close()
    found = sources(chains.select(name.alias("chain")), listing(spark, [f"{path}/{r}" for r in ("one", "two", "data")]), f"{path}/data")
    shown = F.regexp_replace("path", "^.*/(one|two|data)/", "$1/")
    return found.select("chain", "role", shown.alias("path"), "source_kind", "provenance")
