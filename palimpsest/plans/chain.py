"""Queries of chains of headers in their order: the next bits, validation as a stream, reference tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.retarget import Era, next_bits
from ..functions.sqlnames import register
from ..operators.matching import asof_backward
from ..sources.folder import fresh_path, written
from ..sources.reference import refresh_reference
from ..streaming.pending import settled
from ..streaming.validated import Rules, validated
from .evidence import C, E, by_case, canonical, epochs, events, headers, with_h
from .registry import Registry

R = Registry()
query = R.query
col = F.col


def sql_next(bits: str, span: str, divisor: str, least: int = 31) -> str:
    """The compact form of target * span // divisor for bits with an exponent of 11 or more, at most ``least`` bytes wide: eight bytes below the mantissa decide its digits."""
    x = f"((('0x' || substr({bits}, 3))::HUGEINT * ({span}) * 18446744073709551616::HUGEINT) // ({divisor}))"
    text = f"ltrim(printf('%015x', ({x} // 1152921504606846976::HUGEINT)::BIGINT) || printf('%015x', ({x} % 1152921504606846976::HUGEINT)::BIGINT), '0')"
    size = f"((length({text}) + 1) // 2 + ('0x' || substr({bits}, 1, 2))::INT - 11)"
    head = f"substr(CASE WHEN length({text}) % 2 = 1 THEN '0' ELSE '' END || {text}, 1, 6)"
    return f"CASE WHEN {size} > {least} THEN '2000ffff' WHEN {head} >= '8' THEN printf('%02x', {size} + 1) || '00' || substr({head}, 1, 4) ELSE printf('%02x', {size}) || {head} END"


_SPAN = "CASE WHEN height < 48950 THEN greatest(302400, least(4838400, legacy)) WHEN height < 71700 THEN greatest(5917, least(6084, ten)) ELSE greatest(37, least(39, two)) END"
_DIVISOR = "CASE WHEN height < 48950 THEN 1209600 WHEN height < 71700 THEN 6000 ELSE 38 END"


@query(f"""WITH b AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 2016 * (1 + event_id % 24) WHEN 1 THEN 2017 * (1 + event_id % 24) + event_id % 2000 WHEN 2 THEN 48960 + 10 * (event_id % 2274) WHEN 3 THEN 71701 + event_id % 180000
   WHEN 4 THEN CASE event_id % 3 WHEN 0 THEN 48950 WHEN 1 THEN 71700 ELSE 260500 END ELSE 0 END AS height,
  printf('%02x', 11 + event_id % 21) || printf('%06x', 32768 + (event_id * 7919) % 8355840) AS bits, (event_id * 7919) % 8000000 AS legacy, 5800 + event_id % 400 AS ten, 30 + event_id % 15 AS two FROM events)
SELECT id, height, CASE WHEN height = 48950 THEN '1908cf19' WHEN height = 71700 THEN '185c7bae' WHEN height = 260500 THEN '2000ffff' WHEN height <= 0 THEN NULL WHEN (height < 48950 AND height % 2016 <> 0) OR (height BETWEEN 48951 AND 71699 AND height % 10 <> 0) THEN bits
 ELSE {sql_next("bits", _SPAN, _DIVISOR)} END AS next_bits FROM b""")
def e10_next_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits that follow, in three eras and at the heights where they are set: 256-bit products and quotients."""
    i = col("event_id")
    height = by_case(
        i % 6, 2016 * (1 + i % 24), 2017 * (1 + i % 24) + i % 2000, 48_960 + 10 * (i % 2274), 71_701 + i % 180_000, by_case(i % 3, F.lit(48_950), F.lit(71_700), otherwise=F.lit(260_500)), otherwise=F.lit(0)
    )
    bits = F.lower(F.concat(F.lpad(F.hex(11 + i % 21), 2, "0"), F.lpad(F.hex(32_768 + (i * 7919) % 8_355_840), 6, "0")))
    t = F.unix_timestamp("ts")
    first = {2016: t - (i * 7919) % 8_000_000, 10: t - (5800 + i % 400), 2: t - (30 + i % 15)}
    rows = events(spark, sf_dir).select(i.alias("id"), height.cast("bigint").alias("height"), bits.alias("bits"), t.alias("t"), *(v.alias(f"first{k}") for k, v in first.items()))
    return rows.select("id", "height", next_bits(col("height"), col("bits"), col("t"), {k: col(f"first{k}") for k in first}).alias("next_bits"))


#: Ids of a page of headers at most.
PAGE_IDS = 1_000_000
#: The rules of the chains below: every 12 headers, by the time of the 12 before, of which 11 lie between the first and the last.
STEADY = Rules((Era(None, 12, 12, 6600 // 4, 6600 * 4, 6600),), {})

# Of each 21 events seven are headers of one chain and two are headers of each of seven others.
_PAGES = """g AS (SELECT event_id AS id, event_id // 21 AS block, event_id % 21 AS slot FROM events),
q AS (SELECT id, CASE WHEN slot % 3 = 0 THEN 'hot' ELSE 'chain' || ((slot - slot // 3 - 1) // 2) END AS chain, CASE WHEN slot % 3 = 0 THEN block * 7 + slot // 3 ELSE block * 2 + (slot - slot // 3 - 1) % 2 END AS height FROM g),
r AS (SELECT chain, height, sha256(chain || ':' || height) AS hash, CASE WHEN id % 1501 = 11 THEN '' ELSE sha256(chain || ':' || (height - 1)) END AS prev, 600 * height + CASE WHEN id % 1009 = 7 THEN 90000 ELSE 0 END AS t, CASE WHEN id % 1997 = 5 THEN '1c7fffff' ELSE '1d00ffff' END AS bits FROM q)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the columns of a page. A third of all headers are of one chain; some are broken."""
    i, slot = col("id"), col("id") % 21
    e = events(spark, sf_dir).select(col("event_id").alias("id")).withColumns({"block": F.floor(i / 21), "rest": slot - F.floor(slot / 3) - 1})
    hot = slot % 3 == 0
    e = e.withColumns({
        "chain": F.when(hot, "hot").otherwise(F.concat(F.lit("chain"), F.floor(col("rest") / 2).cast("string"))),
        "height": F.when(hot, col("block") * 7 + F.floor(slot / 3)).otherwise(col("block") * 2 + col("rest") % 2),
    })
    name = lambda h: F.sha2(F.concat(col("chain"), F.lit(":"), h.cast("string")), 256)
    return e.select(
        "id", "chain", "height", name(col("height")).alias("hash"), F.when(i % 1501 == 11, "").otherwise(name(col("height") - 1)).alias("prev"),
        (600 * col("height") + F.when(i % 1009 == 7, 90_000).otherwise(0)).cast("bigint").alias("t"), F.when(i % 1997 == 5, "1c7fffff").otherwise("1d00ffff").alias("bits"),
    )


@query(f"""WITH {_PAGES}, w AS (SELECT *, lag(hash) OVER c AS last_hash, lag(bits) OVER c AS last_bits, greatest(1650, least(26400, lag(t) OVER c - lag(t, 12) OVER c)) AS span FROM r WINDOW c AS (PARTITION BY chain ORDER BY height)),
x AS (SELECT *, CASE WHEN height = 0 THEN 'accepted' WHEN prev <> last_hash THEN 'broken link' WHEN bits <> CASE WHEN height % 12 <> 0 THEN last_bits ELSE {sql_next("last_bits", "span", "6600")} END THEN 'bits mismatch' ELSE 'accepted' END AS own FROM w),
y AS (SELECT *, coalesce(max((own <> 'accepted')::INT) OVER (PARTITION BY chain ORDER BY height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM x)
SELECT chain, height, hash, CASE WHEN stopped = 1 THEN 'out of order' ELSE own END AS status FROM y""")
def s12_validated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of headers, ingested in two runs: links and bits in order, with the state of each chain kept between batches and runs. A page has a million headers at most, in
    several files."""
    path = fresh_path(spark, "pages")
    least, most = events(spark, sf_dir).agg(F.min("event_id"), F.max("event_id")).first()
    ids = (most or 0) - (least or 0) + 1
    of_run, files = max(2, -(-ids // 2 // PAGE_IDS)), min(8, 1 + ids // 4 // 20_000)
    page = F.floor((col("id") - (least or 0)) * 2 * of_run / ids).cast("int")
    rows = pages(spark, sf_dir).withColumn("page", page)
    rows.write.partitionBy("page").parquet(f"{path}/headers")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/headers")
    for run in (0, 1):
        for n in range(run * of_run, (run + 1) * of_run):  # the files of a page are written after those of the one before
            rows.where(col("page") == n).drop("id", "page").repartition(files).write.mode("append").parquet(f"{path}/in")
        out = validated(spark, f"{path}/in", f"{path}/checkpoint", f"{path}/out", STEADY, files=files)
    return out


@query(with_h("""SELECT 'epoch' AS part, height, bits, hash, CASE WHEN height <= 320000 THEN 1 ELSE 2 END AS refresh FROM s WHERE height % 4 = 0 AND height <= 400000
 UNION ALL SELECT 'horizon', max(height), max_by(bits, height), max_by(hash, height), NULL FROM s WHERE height <= 400000 HAVING max(height) % 4 <> 0
 UNION ALL SELECT 'manifest', 400000, count(*)::VARCHAR, NULL, 2 FROM s WHERE height % 4 = 0 AND height <= 400000""", C, "s AS (SELECT height, min_by(bits, hash) AS bits, min(hash) AS hash FROM c GROUP BY height)"))
def s18_epoch_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference of epochs refreshed twice: the second call keeps what the first one published and fetches the rest."""
    c = written(canonical(written(headers(spark, sf_dir), "headers")), "canonical")
    source = written(c.groupBy("height").agg(*(F.min_by(x, "hash").alias(x) for x in ("bits", "time")), F.min("hash").alias("hash")), "chain")
    path = fresh_path(spark, "reference")
    for tip in (320_006, 400_006):
        told = refresh_reference(spark, source, path, tip, interval=4)
    epochs = told["epochs"].select(F.lit("epoch").alias("part"), col("height").cast("bigint").alias("height"), "bits", "hash", "refresh")
    horizon = told["headers"].join(told["epochs"].select("height"), "height", "left_anti").select(F.lit("horizon").alias("part"), col("height").cast("bigint").alias("height"), "bits", "hash", F.lit(None).cast("int").alias("refresh"))
    manifest = told["manifest"].select(F.lit("manifest").alias("part"), col("final").cast("bigint").alias("height"), col("epoch_rows").cast("string").alias("bits"), F.lit(None).cast("string").alias("hash"), "refresh")
    return epochs.unionByName(horizon).unionByName(manifest)


_KNOWN = "kn AS (SELECT *, (height - 217728) // 2016 AS k FROM e WHERE (height - 217728) // 2016 < 90), ho AS (SELECT max(time) AS last, max(time) FILTER (k < 50) AS first FROM kn)"


@query(with_h("""SELECT id, CASE WHEN t > last THEN NULL WHEN a.bits = eb THEN 'weak_btc_orphan' ELSE 'excluded' END AS verdict, CASE WHEN t <= first THEN 0 WHEN t <= last THEN 1 END AS refresh
 FROM (SELECT h.id, h.t, h.bits, kn.bits AS eb FROM h ASOF LEFT JOIN kn ON h.t >= kn.time) a, ho""", E, _KNOWN))
def f15_pending_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the reference's horizon wait; two refreshes decide those that they reach, and the rest still waits."""
    h = written(headers(spark, sf_dir).select("id", "t", "bits"), "waiting")
    reference = written(epochs(h).withColumnRenamed("bits", "epoch_bits"), "epochs")
    path = fresh_path(spark, "refreshes")

    def decide(rows: DataFrame, known: DataFrame) -> DataFrame:
        last = known.agg(F.max("time")).first()[0]
        found = asof_backward(rows, "t", known, "time")
        verdict = F.when(col("t") > last, F.lit(None).cast("string")).when(col("bits") == col("epoch_bits"), "weak_btc_orphan").otherwise("excluded")
        return found.select(*rows.columns, verdict.alias("verdict"))

    for low, high in ((0, 50), (50, 90)):
        k = (col("height") - 217_728) / 2016
        reference.where((k >= low) & (k < high)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        decided, pending = settled(spark, h, f"{path}/in", reference.schema, decide, path)
    told = decided.select("id", "verdict", "refresh")
    return told.unionByName(pending.select("id", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("refresh")))


@query(with_h("SELECT id, hash, t, bits, prev, hash <= CASE bits WHEN '207fffff' THEN '7fffff' || repeat('0', 58) WHEN '1f7fffff' THEN '007fffff' || repeat('0', 56) ELSE '00000000ffff' || repeat('0', 52) END AS meets FROM h"))
def e07_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields, hash and work in SQL text over functions by name."""
    register(spark)
    headers(spark, sf_dir).select("id", "header_hex").createOrReplaceTempView("palimpsest_headers")
    told = "header_hash(header_hex) AS hash, header_time(header_hex) AS t, header_bits(header_hex) AS bits, header_parent(header_hex) AS prev"
    return spark.sql(f"SELECT id, {told}, meets_target(header_hash(header_hex), header_bits(header_hex)) AS meets FROM palimpsest_headers")
