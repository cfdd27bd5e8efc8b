"""Header evidence over the driver's tables, in Spark and as SQL text.

Each event becomes one 80-byte header with a chain, a height, a coinbase script and a declared height; three
siblings share a predecessor. The canonical snapshot is a fixed subset and some of the predecessors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hexbytes import display_hash, le32, push_prefix, shift_left, turned


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def by_case(number: Column, *values: object, otherwise: object) -> Column:
    """The value at ``number``, or ``otherwise``."""
    out = F.when(number == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(number == i, v)
    return out.otherwise(otherwise)


def headers(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """id, chain, birth_rank, height, t, version, bits, prev, merkle, header_hex, hash, script, declared. ``spread``: the events, narrow rows in small files that give fewer tasks than
    there are cores, are dealt over all cores first, as making a header takes far longer than moving an event."""
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", "event_type", F.unix_timestamp("ts").alias("t"))
    if spread:
        e = e.repartition(4 * spark.sparkContext.defaultParallelism, "id")
    i = F.col("id")
    e = e.withColumns({
        "version": by_case(i % 11, F.lit(1), F.lit(2), F.lit(3), F.lit(-1), otherwise=F.lit(4)).cast("bigint"),
        "bits": by_case(i % 4, F.lit("207fffff"), F.lit("1f7fffff"), F.lit("207fffff"), otherwise=F.lit("1d00ffff")),
        "chain": F.concat(F.lit("chain"), (F.col("user_id") % 7).cast("string")),
        "birth_rank": F.col("user_id") % 7,
        "height": 220_000 + (i * 53) % 180_000,
        "_prev": F.sha2(F.concat(F.lit("p"), F.floor(i / 3).cast("string")), 256),
        "_merkle": F.sha2(F.concat(F.lit("m"), i.cast("string")), 256),
    })
    bits = by_case(i % 4, F.lit("ffff7f20"), F.lit("ffff7f1f"), F.lit("ffff7f20"), otherwise=F.lit("ffff001d"))
    header = F.concat(le32(F.col("version")), "_prev", "_merkle", le32(F.col("t")), bits, le32(i))
    e = e.withColumns({"prev": turned(F.col("_prev")), "merkle": turned(F.col("_merkle")), "header_hex": header})
    push = lambda h: F.concat(push_prefix(h), F.lit("deadbeef"))
    h = F.col("height")
    committed = F.concat(push_prefix(h), F.lit("fabe6d6d"), F.col("_merkle"), le32(shift_left(F.lit(1).cast("bigint"), (i % 5).cast("int"))), le32(i * 7919))
    script = by_case(i % 6, F.lit(""), push(h), push(h + 1), committed, F.repeat(F.lit("ab"), 120), otherwise=F.lit("ab"))
    declared = by_case(i % 9, F.lit(""), F.lit("x1"), (h + 5).cast("string"), otherwise=h.cast("string"))
    return e.withColumns({"hash": display_hash(F.col("header_hex")), "script": script, "declared": declared}).drop("user_id", "_prev", "_merkle")


def canonical(h: DataFrame) -> DataFrame:
    """hash, height, prev, time, mediantime, bits, confirmations: each hash once."""
    i, g = F.col("id"), F.floor(F.col("id") / 3)
    own = h.where(i % 7 == 0).select("hash", "height", "prev", F.col("t").alias("time"), (F.col("t") - 3600).alias("mediantime"), "bits", F.when(i % 35 == 0, -1).otherwise(1 + i % 100).alias("confirmations"))
    parents = h.where((i % 3 == 0) & (g % 2 == 0)).select(
        F.col("prev").alias("hash"),
        (F.col("height") - 1).alias("height"),
        turned(F.sha2(F.concat(F.lit("q"), g.cast("string")), 256)).alias("prev"),
        (F.col("t") - 600).alias("time"),
        (F.col("t") + F.when(g % 8 == 2, 50).otherwise(-4000)).alias("mediantime"),
        F.lit("207fffff").alias("bits"),
        F.when(g % 10 == 0, F.lit(-1).cast("bigint")).otherwise(g).alias("confirmations"),
    )
    return own.unionByName(parents)


def epochs(h: DataFrame) -> DataFrame:
    """height, time, bits of 100 difficulty epochs that span the headers' times."""
    span = h.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    k = F.col("k")
    return span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")).select(
        (217_728 + k * 2016).cast("bigint").alias("height"),
        (F.col("lo") + k * (F.floor((F.col("hi") - F.col("lo")) / 100) + 1)).alias("time"),
        by_case(k % 3, F.lit("207fffff"), F.lit("1f7fffff"), otherwise=F.lit("1d00ffff")).alias("bits"),
    )


# --- the same as SQL text ---


def sql_rev(x: str) -> str:
    return f"list_aggregate(list_reverse(regexp_extract_all({x}, '..')), 'string_agg', '')"


def sql_dsha(x: str) -> str:
    return f"sha256(unhex(sha256(unhex({x}))))"


def sql_le32(x: str) -> str:
    return sql_rev(f"printf('%08x', ({x})::BIGINT & 4294967295)")


def sql_push3(x: str) -> str:
    return f"('03' || {sql_rev(f"printf('%06x', ({x})::BIGINT)")})"


def sql_u32(x: str) -> str:
    return f"('0x' || {sql_rev(x)})::BIGINT"


H = f"""h0 AS (
  SELECT event_id AS id, event_type, epoch_us(ts) // 1000000 AS t,
    (CASE event_id % 11 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN -1 ELSE 4 END)::BIGINT AS version,
    CASE event_id % 4 WHEN 1 THEN '1f7fffff' WHEN 3 THEN '1d00ffff' ELSE '207fffff' END AS bits,
    'chain' || (user_id % 7) AS chain, user_id % 7 AS birth_rank,
    220000 + (event_id * 53) % 180000 AS height,
    sha256('p' || (event_id // 3)) AS pi, sha256('m' || event_id) AS mi
  FROM events),
h1 AS (SELECT *, {sql_le32("version")} || pi || mi || {sql_le32("t")} || {sql_rev("bits")} || {sql_le32("id")} AS header_hex FROM h0),
h AS (
  SELECT id, event_type, t, version, bits, chain, birth_rank, height, header_hex, {sql_rev("pi")} AS prev, {sql_rev("mi")} AS merkle,
    {sql_rev(sql_dsha("header_hex"))} AS hash,
    CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN {sql_push3("height")} || 'deadbeef' WHEN 2 THEN {sql_push3("height + 1")} || 'deadbeef'
      WHEN 3 THEN {sql_push3("height")} || 'fabe6d6d' || mi || {sql_le32("1 << (id % 5)")} || {sql_le32("id * 7919")}
      WHEN 4 THEN repeat('ab', 120) ELSE 'ab' END AS script,
    CASE id % 9 WHEN 0 THEN '' WHEN 1 THEN 'x1' WHEN 2 THEN (height + 5)::VARCHAR ELSE height::VARCHAR END AS declared
  FROM h1)"""

C = f"""c AS (
  SELECT hash, height, prev, t AS time, t - 3600 AS mediantime, bits, CASE WHEN id % 35 = 0 THEN -1 ELSE 1 + id % 100 END AS confirmations FROM h WHERE id % 7 = 0
  UNION ALL
  SELECT prev, height - 1, {sql_rev("sha256('q' || (id // 3))")}, t - 600, t + CASE WHEN (id // 3) % 8 = 2 THEN 50 ELSE -4000 END, '207fffff', CASE WHEN (id // 3) % 10 = 0 THEN -1 ELSE id // 3 END
  FROM h WHERE id % 3 = 0 AND (id // 3) % 2 = 0)"""

E = """e AS (
  SELECT 217728 + k * 2016 AS height, lo + k * ((hi - lo) // 100 + 1) AS time, CASE k % 3 WHEN 0 THEN '207fffff' WHEN 1 THEN '1f7fffff' ELSE '1d00ffff' END AS bits
  FROM (SELECT min(t) AS lo, max(t) AS hi FROM h), range(100) r(k))"""


def with_h(body: str, *more: str) -> str:
    return "WITH " + ", ".join([H, *more]) + " " + body
