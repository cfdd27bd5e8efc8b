"""Queries of readers, writers, parsers and the stream, each against the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hexbytes as X
from ..functions import parsers as P
from ..functions.retarget import compact_bits
from ..sources import blkdat, files, sinks
from ..sources.folder import fresh_path
from ..streaming.tips import chain_tips
from .evidence import events, headers, with_h
from .registry import Registry

R = Registry()
query = R.query
col = F.col
MAGIC = "f9beb4d9"


@query(with_h("SELECT id::VARCHAR AS id, chain, hash, '' AS absent, declared FROM h"))
def s01_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, read back as strings; a column that the file lacks is empty, and so is an empty text."""
    path = fresh_path(spark, "csv")
    headers(spark, sf_dir).select("id", "declared", "hash", "chain").write.option("header", True).option("emptyValue", "").csv(path)
    return files.read_text_table(spark, path, ["id", "chain", "hash", "absent", "declared"]).drop("source_path")


@query(with_h("SELECT height::VARCHAR AS height, prev, count(*) AS n FROM h GROUP BY 1, 2"))
def s02_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tsv")
    headers(spark, sf_dir).select("height", "prev").write.option("header", True).option("sep", "\t").csv(path)
    rows = files.require_columns(files.read_text_table(spark, path, ["height", "prev"], sep="\t"), ["height", "prev"])
    return rows.groupBy("height", "prev").agg(F.count(F.lit(1)).alias("n"))


@query(with_h("SELECT hash, height, bits, script FROM h WHERE id % 10 <> 0"))
def s03_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested blocks as gzipped JSON lines; every tenth line is broken and left out."""
    path = fresh_path(spark, "json")
    block = F.to_json(F.struct("hash", "height", F.struct(F.struct("bits").alias("parent_block"), F.struct(F.array(F.struct("script")).alias("vin")).alias("coinbasetx")).alias("auxpow")))
    headers(spark, sf_dir).select(F.when(col("id") % 10 == 0, F.lit("{broken")).otherwise(block).alias("value")).write.option("compression", "gzip").text(path)
    schema = T.StructType.fromDDL("hash string, height bigint, auxpow struct<parent_block: struct<bits: string>, coinbasetx: struct<vin: array<struct<script: string>>>>")
    rows = files.read_json_blocks(spark, path, schema)
    return rows.select("hash", "height", col("auxpow.parent_block.bits").alias("bits"), col("auxpow.coinbasetx.vin")[0]["script"].alias("script"))


@query("SELECT event_id AS id, sha256('b' || event_id) AS payload FROM events")
def s04_framed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block files built from events and split into frames again; noise stands between the frames."""
    payload = F.sha2(F.concat(F.lit("b"), col("event_id").cast("string")), 256)
    frame = F.concat(F.lit("00ff" + MAGIC), X.le32(F.lit(40)), X.rev(F.lpad(F.lower(F.hex(col("event_id"))), 16, "0"), 8), payload)
    e = events(spark, sf_dir).select(F.floor(col("event_id") / 500).alias("file"), "event_id", frame.alias("frame"))
    whole = e.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "frame")))["frame"], "").alias("hex"))
    blocks = files.frames(whole.select(col("file").cast("string").alias("path"), F.unhex("hex").alias("content")), bytes.fromhex(MAGIC))
    h = F.lower(F.hex("block"))
    return blocks.select(X.le_int(F.substring(h, 1, 14), 7).alias("id"), F.substring(h, 17, 64).alias("payload"))


def _block_files(spark: SparkSession, sf_dir: str, bad: Column) -> str:
    """A folder of masked block files of 500 events each, with two bytes of noise before every frame; a frame that is ``bad`` tells a size of none."""
    path = fresh_path(spark, "blocks")
    i = col("event_id")
    payload = F.sha2(F.concat(F.lit("b"), i.cast("string")), 256)
    size = X.le32(F.when(bad, 0).otherwise(40))
    frame = F.concat(F.lit("00ff" + MAGIC), size, X.rev(F.lpad(F.lower(F.hex(i)), 16, "0"), 8), payload)
    frames = events(spark, sf_dir).select(F.floor(i / 500).cast("int").alias("file"), i.alias("number"), frame.alias("frame"))
    blkdat.write_blocks(frames, path, bytes.fromhex("0123456789abcdef")).collect()  # a row for each file
    return path


def _frames_read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    h = F.lower(F.hex("block"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return blkdat.read_blocks(spark, path, MAGIC, **options).select(X.le_int(F.substring(h, 1, 14), 7).alias("id"), name.alias("file"), "offset", F.substring(h, 17, 64).alias("payload"))


@query("SELECT event_id AS id, printf('blk%05d.dat', event_id // 500) AS file, (event_id % 500) * 50 + 2 AS offset, sha256('b' || event_id) AS payload FROM events")
def s05_masked_block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real files, read by ranges that cut frames, unmasked by the key beside them."""
    return _frames_read(spark, _block_files(spark, sf_dir, F.lit(False)), rangeBytes=4096)


@query("SELECT event_id AS id, printf('blk%05d.dat', event_id // 500) AS file, (event_id % 500) * 50 + 2 AS offset, sha256('b' || event_id) AS payload FROM events WHERE NOT ((event_id // 500) % 3 = 0 AND event_id % 500 >= 250)")
def s04_stopped_block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of no bytes in the middle of every third file: what comes after it in its file is left out."""
    bad = (F.floor(col("event_id") / 500) % 3 == 0) & (col("event_id") % 500 == 250)
    return _frames_read(spark, _block_files(spark, sf_dir, bad), rangeBytes=10_000, onBadFrame="stop")


@query("SELECT (event_id % 400)::VARCHAR AS key, max(printf('%08x', event_id)) AS value FROM events GROUP BY 1")
def s07_json_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects in several files, the last file wins; here each file holds the ids of one block of 400."""
    path = fresh_path(spark, "maps")
    e = events(spark, sf_dir).select((col("event_id") % 400).cast("string").alias("k"), F.lower(F.lpad(F.hex("event_id"), 8, "0")).alias("v"), F.floor(col("event_id") / 400).alias("file"))
    maps = e.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    maps.withColumn("part", F.lpad(col("file").cast("string"), 8, "0")).select("part", "value").write.partitionBy("part").text(path)
    return files.read_json_map(spark, path + "/*/*.txt")


@query("SELECT chain, CASE WHEN chain IN ('chain0', 'chain3', 'chain6') THEN 'archive/' || chain ELSE 'repo/' || chain END AS path, CASE WHEN chain IN ('chain0', 'chain3', 'chain6') THEN 0 ELSE 2 END AS precedence FROM (SELECT DISTINCT 'chain' || (user_id % 7) AS chain FROM events)")
def s14_source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = events(spark, sf_dir).select((col("user_id") % 7).alias("k")).distinct()
    named = F.concat(F.lit("chain"), col("k").cast("string"))
    repo = chains.select(named.alias("chain"), F.lit(2).alias("precedence"), F.concat(F.lit("repo/"), named).alias("path"))
    archive = chains.where("k % 3 = 0").select(named.alias("chain"), F.lit(0).alias("precedence"), F.concat(F.lit("archive/"), named).alias("path"))
    return files.best_source(repo.unionByName(archive))


@query(with_h("SELECT id::VARCHAR AS id, '' AS absent, coalesce(CASE WHEN id % 2 = 0 THEN chain END, '') AS chain FROM h"))
def k01_projection_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir).select(F.when(col("id") % 2 == 0, col("chain")).alias("chain"), "id", "hash")
    path = fresh_path(spark, "fields")
    sinks.distinct_destinations([path])
    sinks.project(h, ["id", "absent", "chain"]).write.parquet(path)
    return spark.read.parquet(path)


@query(with_h("SELECT CASE id % 4 WHEN 0 THEN 'canonical' WHEN 1 THEN 'stale' WHEN 2 THEN 'unknown' ELSE 'error_block' END AS classification, count(*) AS n, min(height) AS lowest FROM h GROUP BY 1"))
def k02_class_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = col("id") % 4
    path = fresh_path(spark, "buckets")
    sinks.write_buckets(headers(spark, sf_dir).withColumn("classification", F.when(i == 0, "canonical").when(i == 1, "stale").when(i == 2, "unknown").otherwise("error_block")), path)
    return spark.read.parquet(path).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.min("height").alias("lowest"))


@query(with_h("SELECT chain, count(*) AS n FROM h GROUP BY chain"))
def k03_atomic_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published twice over one path: the second replaces the first."""
    path = fresh_path(spark, "published")
    counts = headers(spark, sf_dir).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    for part in (counts.limit(1), counts):
        sinks.publish(part, path + ".staging", path)
    return spark.read.parquet(path)


@query(with_h("""SELECT chain, '{' || CASE WHEN count_if(id % 2 = 0) > 0 THEN '"even":' || count_if(id % 2 = 0) ELSE '' END || CASE WHEN count_if(id % 2 = 0) > 0 AND count_if(id % 2 = 1) > 0 THEN ',' ELSE '' END
 || CASE WHEN count_if(id % 2 = 1) > 0 THEN '"odd":' || count_if(id % 2 = 1) ELSE '' END || '}' AS counts FROM h GROUP BY chain"""))
def k05_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir).withColumn("classification", F.when(col("id") % 2 == 0, "even").otherwise("odd"))
    return sinks.manifest(h)


@query(with_h("SELECT 'chain' || k AS view, count(*) AS n FROM h, range(2) r(j), LATERAL (SELECT (birth_rank + j) % 7 AS k) GROUP BY 1"))
def k07_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat(F.lit("chain"), col("birth_rank").cast("string"), F.lit("|chain"), ((col("birth_rank") + 1) % 7).cast("string"))
    path = fresh_path(spark, "views")
    sinks.split_views(headers(spark, sf_dir).select("id", names.alias("source_chains"), "birth_rank"), "source_chains", path)
    return spark.read.parquet(path).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


def _transactions(h: DataFrame) -> DataFrame:
    """A coinbase transaction per header: one input with the script (or four bytes), two outputs, every other with witness."""
    script = F.when(F.length("script").between(1, 400), col("script")).otherwise("00112233")
    size = F.lpad(F.lower(F.hex(F.floor(F.length("_s") / 2).cast("bigint"))), 2, "0")
    le64 = lambda v: X.rev(F.lpad(F.lower(F.hex(v)), 16, "0"), 8)
    out = lambda v, s: F.concat(le64(v), F.lit(f"{len(s) // 2:02x}{s}"))
    wit = col("id") % 2 == 0
    h = h.withColumn("_s", script)
    raw = F.concat(
        F.lit("02000000"), F.when(wit, "0001").otherwise(""), F.lit("01" + "00" * 32 + "ffffffff"), size, "_s", F.lit("ffffffff"), F.lit("02"),
        out(col("id") * 1000, "76a914" + "11" * 20 + "88ac"), out(col("height"), "6a04deadbeef"), F.when(wit, "0120" + "00" * 32).otherwise(""), X.le32(col("t")),
    )
    return h.select("id", "_s", F.unhex(raw).alias("raw"))


@query(with_h("SELECT id, 2 AS version, 1 AS n_inputs, CASE WHEN script = '' THEN '00112233' ELSE script END AS script, id * 1000 AS first_value, height AS second_value, t AS locktime, id % 2 = 0 AS has_witness FROM h"))
def e02_transaction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transactions(headers(spark, sf_dir)).select("id", P.transaction("raw").alias("t"))
    return t.select("id", "t.version", "t.n_inputs", "t.script", col("t.values")[0].alias("first_value"), col("t.values")[1].alias("second_value"), "t.locktime", "t.has_witness")


@query("WITH b AS (SELECT event_id AS id, printf('%02x', (4 + event_id % 28)::BIGINT) || printf('%06x', 32768 + (event_id * 7919) % 8355840) AS bits FROM events) SELECT id, bits FROM b")
def e10_compact_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets to their compact form: the inverse of e09 for bits that are normal."""
    i = col("event_id")
    bits = F.lower(F.concat(F.lpad(F.hex(4 + i % 28), 2, "0"), F.lpad(F.hex(32_768 + (i * 7919) % 8_355_840), 6, "0")))
    return events(spark, sf_dir).select(i.alias("id"), compact_bits(X.target(bits)).alias("bits"))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h20 = F.substring(F.sha2(F.concat(F.lit("a"), col("event_id").cast("string")), 256), 1, 40)
    h32 = F.sha2(F.concat(F.lit("a"), col("event_id").cast("string")), 256)
    k = col("event_id") % 5
    script = F.when(k == 0, F.concat(F.lit("76a914"), h20, F.lit("88ac"))).when(k == 1, F.concat(F.lit("a914"), h20, F.lit("87"))).when(k == 2, F.concat(F.lit("0014"), h20)).when(k == 3, F.concat(F.lit("5120"), h32)).otherwise("6a")
    return events(spark, sf_dir).select(col("event_id").alias("id"), script.alias("script"))


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '3' WHEN 2 THEN 'bc1q' WHEN 3 THEN 'bc1p' END AS kind, CASE event_id % 5 WHEN 0 THEN '76a914' || substr(sha256('a' || event_id), 1, 40) || '88ac' WHEN 1 THEN 'a914' || substr(sha256('a' || event_id), 1, 40) || '87'
 WHEN 2 THEN '0014' || substr(sha256('a' || event_id), 1, 40) WHEN 3 THEN '5120' || sha256('a' || event_id) END AS back FROM events""")
def e23_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output scripts to addresses and back."""
    a = _scripts(spark, sf_dir).withColumn("address", P.address("script"))
    kind = F.when(F.startswith("address", F.lit("bc1")), F.substring("address", 1, 4)).otherwise(F.substring("address", 1, 1))
    return a.select("id", kind.alias("kind"), P.output_script("address").alias("back"))


@query(with_h("SELECT chain, count(*) AS n, max(height) AS tip_height, max_by(hash, height) AS tip_hash FROM h GROUP BY chain"))
def s12_chain_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header stream: staged in files, ingested some at a time, state kept by chain."""
    path = fresh_path(spark, "stream")
    rows = headers(spark, sf_dir).select("chain", "height", "hash", col("id").alias("place"))
    rows.repartition(8).write.parquet(f"{path}/in")
    return chain_tips(spark, f"{path}/in", rows.schema, f"{path}/checkpoint", f"{path}/out")
