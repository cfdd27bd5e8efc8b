"""Queries of reports, assembled data sets, classifier outputs, and readers of what older tools left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hexbytes as X
from ..functions import parsers as P
from ..functions.retarget import LIMIT
from ..operators.assembly import assembled, upserted
from ..operators.legacy import standardised
from ..operators.matching import lagged
from ..operators.reports import anomalies, child_coverage
from ..sources import files, sinks
from ..sources.family import publish_family, read_family
from ..sources.folder import fresh_path, written
from .evidence import events, headers, sql_dsha, sql_le32, sql_rev, with_h
from .files import _transactions
from .pipelines import _FULL, classes, stored
from .registry import Registry

R = Registry()
query = R.query
col = F.col

_ANOMALIES = """r AS (SELECT id, prev AS hash, CASE WHEN id % 7 = 0 THEN 'p0' ELSE 'p1' END AS pre, CASE WHEN id % 5 < 4 THEN 'stale' ELSE 'unknown' END AS kind, bits, CASE WHEN id % 50 = 0 THEN 'bad header' WHEN id % 75 = 0 THEN 'bad script' END AS fault, CASE WHEN id % 3 = 0 THEN '207fffff' END AS expected FROM h),
ea AS (SELECT id, 'conflicting_prev' AS kind, hash AS key, pre AS value FROM r UNION ALL SELECT id, 'mixed_classification', hash, kind FROM r UNION ALL SELECT id, 'malformed', fault, NULL FROM r WHERE fault IS NOT NULL
  UNION ALL SELECT id, 'epoch_mismatch', bits || ' for ' || expected, NULL FROM r WHERE bits <> expected)"""


@query(with_h("SELECT kind, key, count(*) AS n, coalesce(string_agg(DISTINCT value, '|' ORDER BY value), '') AS variants, min(id) AS first_row, array_to_string(list_slice(list_sort(list(id)), 1, 20), '|') AS samples FROM ea GROUP BY kind, key HAVING kind IN ('malformed', 'epoch_mismatch') OR count(DISTINCT value) > 1", _ANOMALIES))
def a05_anomaly_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of contradictions in one pass; some groups hold a sixth of all rows."""
    i = col("id")
    rows = headers(spark, sf_dir).select("id", col("prev").alias("hash"), F.when(i % 7 == 0, "p0").otherwise("p1").alias("prev"), F.when(i % 5 < 4, "stale").otherwise("unknown").alias("classification"), "bits")
    return anomalies(written(rows, "rows"), F.when(i % 50 == 0, "bad header").when(i % 75 == 0, "bad script"), F.when(i % 3 == 0, "207fffff"))


@query(with_h("""SELECT chain, count(*) AS total_rows, count_if(whole) AS hydrated_rows, count_if(NOT whole) AS unrecoverable_rows, '{' || concat_ws(',', CASE WHEN count_if(NOT whole AND id % 8 = 0) > 0 THEN '"no source":' || count_if(NOT whole AND id % 8 = 0) END, CASE WHEN count_if(NOT whole AND id % 8 <> 0) > 0 THEN '"pruned":' || count_if(NOT whole AND id % 8 <> 0) END) || '}' AS reasons,
 min(time) FILTER (whole) AS min_child_time, max(time) FILTER (whole) AS max_child_time, CASE WHEN count_if(whole) = 0 THEN 'not_applicable' WHEN count_if(whole AND NOT bare) <> count_if(whole) THEN 'incomplete' WHEN min(time - t) FILTER (whole) = 0 AND max(time - t) FILTER (whole) = 0 THEN 'degenerate' ELSE 'non_degenerate' END AS delta_status,
 count_if(whole AND NOT bare) || '/' || count_if(whole) AS delta_coverage, min(time - t) FILTER (whole AND NOT bare) AS min_delta, max(time - t) FILTER (whole AND NOT bare) AS max_delta
 FROM (SELECT id, chain, t, id % 4 <> 0 AND chain <> 'chain2' AS whole, CASE WHEN chain = 'chain0' THEN t ELSE t + id % 7 - 3 END AS time, chain = 'chain1' AND id % 11 = 0 AS bare FROM h) GROUP BY chain"""))
def a08_child_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far child headers are known, chain by chain, and whether their times say anything."""
    i, chain = col("id"), col("chain")
    rows = headers(spark, sf_dir).select(
        "id", "chain", F.when((i % 4 == 0) | (chain == "chain2"), " ").otherwise("ab").alias("child_header_hex"), F.when(chain == "chain0", col("t")).otherwise(col("t") + i % 7 - 3).cast("string").alias("child_block_time"),
        F.when((chain == "chain1") & (i % 11 == 0), "").otherwise(col("t").cast("string")).alias("btc_time"),
    )
    return child_coverage(rows, ("child_header_hex", "child_block_time"), F.when(i % 8 == 0, "no source").otherwise("pruned"))


_ASSEMBLED = """sd AS (SELECT *, id % 7 = 0 AS own, CASE id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS grp FROM h WHERE id % 5 < 4),
am AS (SELECT height, hash, CASE WHEN own THEN header_hex WHEN id % 20 = 1 OR id % 22 = 2 OR id % 28 = 3 THEN NULL ELSE header_hex END AS header_hex, CASE WHEN own THEN 'own' WHEN grp IN ('A', 'B') AND id % 20 <> 1 AND id % 22 <> 2 AND id % 28 <> 3 THEN bits ELSE '' END AS expected_nbits, CASE WHEN NOT own AND grp = 'A' THEN CASE WHEN id % 20 = 1 OR id % 22 = 2 OR id % 28 = 3 THEN NULL ELSE script END ELSE 'seed' END AS script,
 CASE WHEN own THEN 'sweep:' || id WHEN grp = 'A' THEN 'full-evidence:' || chain WHEN grp = 'B' THEN 'full-evidence:rsk' WHEN grp = 'C' THEN 'upstream' WHEN id % 20 = 1 OR id % 22 = 2 OR id % 28 = 3 THEN NULL ELSE 'node ' || id % 3 END AS provenance, CASE WHEN own THEN 'self' ELSE grp END AS source_group,
 CASE WHEN NOT own AND (id % 20 = 1 OR id % 22 = 2 OR id % 28 = 3) THEN 'no header in ' || CASE grp WHEN 'A' THEN 'the evidence of ' || chain WHEN 'B' THEN 'the evidence of rsk' WHEN 'C' THEN 'upstream' ELSE 'what was recovered' END END AS error, id FROM sd)"""


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = col("id")
    h = stored(spark, sf_dir)
    seeds = h.where("id % 5 < 4").select("height", "hash", F.when(i % 7 == 0, col("header_hex")).alias("header_hex"), F.lit("own").alias("expected_nbits"), F.lit("seed").alias("script"), F.when(i % 7 == 0, F.concat(F.lit("sweep:"), i.cast("string"))).otherwise("committed").alias("provenance"))
    group = F.when(i % 4 == 0, "A").when(i % 4 == 1, "B").when(i % 4 == 2, "C")
    chain = F.when(i % 4 == 0, col("chain")).when(i % 4 == 1, "rsk")
    groups = h.where("id % 4 < 3").select("height", "hash", group.alias("source_group"), chain.alias("chain"))
    there = h.where("id % 20 <> 1 and id % 22 <> 2 and id % 28 <> 3")
    evidence = there.where("id % 4 < 2").select(chain.alias("chain"), "height", "hash", "header_hex", F.concat(F.lit(" "), "bits").alias("expected_nbits"), "script")
    upstream = there.where("id % 4 = 2").select("height", "hash", "header_hex")
    recovered = there.where("id % 4 = 3").select("height", "hash", "header_hex", F.concat(F.lit("node "), (i % 3).cast("string")).alias("source"))
    return assembled(seeds, groups, evidence, upstream, recovered, ("sweep:",))


@query(with_h("SELECT height, hash, header_hex, expected_nbits, script, provenance, source_group, error FROM am", _ASSEMBLED))
def j17_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put together from the source that their group names; what a source lacks is told."""
    return _assembled(spark, sf_dir)


@query(with_h("SELECT height, hash, header_hex, provenance FROM am WHERE error IS NULL UNION ALL SELECT height, hash, 'old', 'upstream:' || id FROM h WHERE id % 10 IN (0, 4) AND NOT EXISTS (SELECT 1 FROM am WHERE am.id = h.id AND error IS NULL)", _ASSEMBLED))
def p10_upserted_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set of error blocks: rows assembled without a fault take the place of upstream's, whose others stay; published as a whole."""
    path = fresh_path(spark, "error_blocks")
    rows = _assembled(spark, sf_dir).where("error is null").select("height", "hash", "header_hex", "provenance")
    older = stored(spark, sf_dir).where("id % 10 in (0, 4)").select("height", "hash", F.lit("old").alias("header_hex"), F.concat(F.lit("upstream:"), col("id").cast("string")).alias("provenance"))
    publish_family({"error_blocks": upserted(older, rows, ["height", "hash"])}, path)
    return read_family(spark, path)["error_blocks"]


_OUTPUTS = """ot AS (SELECT classification AS table_name, id, btc_height, CASE WHEN classification IN ('canonical', 'unknown') THEN '' ELSE coalesce(validation_status, '') END AS validation_status, CASE WHEN classification IN ('canonical', 'unknown') THEN '' ELSE coalesce(expected_nbits, '') END AS expected_nbits, CASE WHEN classification = 'error_block' THEN rules ELSE '' END AS rules FROM z)"""


@query(with_h("SELECT table_name, id::VARCHAR AS id, btc_height::VARCHAR AS btc_height, validation_status, expected_nbits, rules FROM ot UNION ALL SELECT 'validated', id::VARCHAR, btc_height::VARCHAR, validation_status, expected_nbits, '' FROM ot WHERE table_name = 'stale' AND validation_status = 'VALID'", *_FULL, _OUTPUTS).replace("btc_height::VARCHAR", "coalesce(btc_height::VARCHAR, '')"))
def k02_published_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's five tables, published at once: gate columns blank where the class is final, rules on error blocks alone."""
    path = fresh_path(spark, "classes")
    columns = ["id", "btc_height", "classification", "validation_status", "expected_nbits"]
    rows = classes(stored(spark, sf_dir)).withColumn("rules_violated", F.array_join("rules_violated", "|"))
    publish_family(sinks.classifier_outputs(rows, columns), path)
    told = read_family(spark, path)
    parts = [df.select(F.lit(name).alias("table_name"), "id", "btc_height", "validation_status", "expected_nbits", (col("rules_violated") if "rules_violated" in df.columns else F.lit("")).alias("rules")) for name, df in told.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(with_h("""SELECT count_if(classification = 'canonical') AS canonical, count_if(classification = 'stale') AS stale, count_if(classification = 'unknown') AS unknown, count_if(classification = 'error_block') AS error_block, count_if(classification = 'stale' AND s = 'VALID') AS valid, count_if(s LIKE 'REJECTED%') AS rejected,
 count_if(s LIKE 'REJECTED%' AND classification = 'stale') AS rejected_stale, count_if(s LIKE 'REJECTED%' AND classification = 'error_block') AS rejected_error_block, count_if(s LIKE 'REJECTED%' AND classification = 'unknown') AS rejected_unknown, count_if(classification = 'stale' AND s LIKE 'UNKNOWN%') AS validation_unknown FROM (SELECT *, coalesce(validation_status, '') AS s FROM z)""", *_FULL))
def k02_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classifier tells of its outputs."""
    return sinks.classifier_counts(classes(stored(spark, sf_dir)))


@query(with_h("SELECT 'chain' || k AS view, count(*) AS n FROM h, range(2) r(j), LATERAL (SELECT (birth_rank + j) % 7 AS k) WHERE id % 3 < 2 AND k < 6 GROUP BY 1"))
def k07_replaced_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views made anew: those of the first time that have no rows any more are gone."""
    names = F.concat(F.lit("chain"), col("birth_rank").cast("string"), F.lit("|chain"), ((col("birth_rank") + 1) % 7).cast("string"))
    path = fresh_path(spark, "views")
    rows = headers(spark, sf_dir).select("id", names.alias("source_chains"))
    sinks.replace_views(rows, "source_chains", path)
    left = F.array_join(F.filter(F.split("source_chains", "\\|"), lambda c: c != "chain6"), "|")
    sinks.replace_views(rows.where("id % 3 < 2").withColumn("source_chains", left).where("source_chains <> ''"), "source_chains", path)
    return spark.read.parquet(path).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


# --- spans, sizes, targets ---


@query(with_h("SELECT id, CASE WHEN s2016 IS NOT NULL THEN least(greatest(s2016, 302400), 4838400) END AS legacy, CASE WHEN s10 IS NOT NULL THEN least(greatest(s10, 5917), 6084) END AS ten, CASE WHEN s2 IS NOT NULL THEN least(greatest(s2, 37), 39) END AS two FROM (SELECT id, t - lag(t, 2016) OVER w AS s2016, t - lag(t, 10) OVER w AS s10, t - lag(t, 2) OVER w AS s2 FROM h WINDOW w AS (PARTITION BY chain ORDER BY height, id))"))
def w04_trailing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clamped time over the last 2,016, ten and two headers of a chain."""
    h = written(headers(spark, sf_dir).select("id", "chain", "height", "t"), "times")
    out = h.select("id")
    for name, n, low, high in (("legacy", 2016, 302_400, 4_838_400), ("ten", 10, 5_917, 6_084), ("two", 2, 37, 39)):
        span = col("t") - col("before")
        clamped = F.when(span.isNotNull(), F.least(F.greatest(span, F.lit(low)), F.lit(high)))
        out = out.join(lagged(h, "chain", ["height", "id"], n, before="t").select("id", clamped.alias(name)), "id")
    return out


_SIZES = "CASE id % 8 WHEN 0 THEN printf('%02x', id % 253) WHEN 1 THEN 'fd' || {a} WHEN 2 THEN 'fe' || {b} WHEN 3 THEN 'ff' || {c} WHEN 4 THEN 'fd' || substr({a}, 1, 2) WHEN 5 THEN '' WHEN 6 THEN 'fffeffffffffffffff' ELSE 'fe' || {b} || 'aa' END"


@query(f"""WITH v AS (SELECT event_id AS id, event_id * 7 % 70000 AS n FROM events), s AS (SELECT id, n, n % 65536 AS a, CASE WHEN id % 3 = 0 THEN n ELSE n + 65536 END AS b, CASE WHEN id % 5 = 0 THEN n ELSE n + 4294967296 END AS c FROM v)
SELECT id, CASE id % 8 WHEN 0 THEN (id % 253)::VARCHAR WHEN 1 THEN a::VARCHAR WHEN 2 THEN b::VARCHAR WHEN 3 THEN c::VARCHAR WHEN 6 THEN '18446744073709551614' WHEN 7 THEN b::VARCHAR END AS value,
 CASE id % 8 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 9 WHEN 6 THEN 9 WHEN 7 THEN 5 END AS bytes,
 CASE id % 8 WHEN 1 THEN CASE WHEN a < 253 THEN 'not the shortest form' END WHEN 2 THEN CASE WHEN b < 65536 THEN 'not the shortest form' WHEN b > 100000 THEN 'above the maximum' END WHEN 3 THEN CASE WHEN c < 4294967296 THEN 'not the shortest form' ELSE 'above the maximum' END
  WHEN 4 THEN 'cut short' WHEN 5 THEN 'cut short' WHEN 6 THEN 'above the maximum' WHEN 7 THEN CASE WHEN b < 65536 THEN 'not the shortest form' WHEN b > 100000 THEN 'above the maximum' END END AS fault FROM s""")
def e01_shortest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact sizes with a maximum: cut short, longer than they need be, too large."""
    i, n = col("id"), col("n")
    le = lambda v, size: X.rev(F.lpad(F.lower(F.hex(v.cast("bigint"))), 2 * size, "0"), size)
    e = events(spark, sf_dir).select(col("event_id").alias("id"), (col("event_id") * 7 % 70_000).alias("n"))
    a, b, c = n % 65_536, F.when(i % 3 == 0, n).otherwise(n + 65_536), F.when(i % 5 == 0, n).otherwise(n + 2**32)
    k = i % 8
    coded = (
        F.when(k == 0, le(i % 253, 1)).when(k == 1, F.concat(F.lit("fd"), le(a, 2))).when(k == 2, F.concat(F.lit("fe"), le(b, 4))).when(k == 3, F.concat(F.lit("ff"), le(c, 8)))
        .when(k == 4, F.concat(F.lit("fd"), F.substring(le(a, 2), 1, 2))).when(k == 5, "").when(k == 6, "fffeffffffffffffff").otherwise(F.concat(F.lit("fe"), le(b, 4), F.lit("aa")))
    )
    return e.select("id", X.compact_size(coded, F.lit(100_000)).alias("s")).select("id", col("s.value").cast("string").alias("value"), "s.bytes", "s.fault")


_LE64 = lambda v: sql_rev(f"printf('%016x', ({v})::BIGINT)")
_SCRIPT = "CASE WHEN script = '' THEN '00112233' ELSE script END"
_RAW = f"'0200000001' || repeat('00', 32) || 'ffffffff' || printf('%02x', (length({_SCRIPT}) // 2)::BIGINT) || {_SCRIPT} || 'ffffffff02' || {_LE64('id * 1000')} || '1976a914{'11' * 20}88ac' || {_LE64('height')} || '066a04deadbeef' || {sql_le32('t')}"


@query(with_h(f"SELECT id, {sql_rev(sql_dsha(_RAW))} AS txid FROM h"))
def e02_transaction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction ids, which leave out the marker and the witness that every other transaction has."""
    return _transactions(headers(spark, sf_dir)).select("id", P.transaction("raw").alias("t")).select("id", "t.txid")


_ADDRESS = P.address_of(bytes.fromhex(f"76a914{'11' * 20}88ac"))


@query(with_h(f"SELECT id, '{_ADDRESS}:' || (id * 1000) AS by_address, '76a914{'11' * 20}88ac;6a04deadbeef' AS scripts, '76a914{'11' * 20}88ac:' || (id * 1000) || '|6a04deadbeef:' || height AS by_script, '76a914{'11' * 20}88ac' AS spendable FROM h"))
def e26_decoded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of decoded transactions in three encodings, and back without those that nobody can spend."""
    t = _transactions(headers(spark, sf_dir)).select("id", P.transaction("raw").alias("t")).select("id", F.posexplode(F.arrays_zip("t.scripts", "t.values")).alias("place", "o")).select("id", "place", "o.scripts", "o.values")
    each = t.withColumn("address", P.address("scripts"))
    text = lambda c: F.concat(c, F.lit(":"), col("values").cast("string"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", c.alias("x")))), lambda s: s["x"])
    got = each.groupBy("id").agg(F.array_join(ordered(text(col("address"))), "|").alias("by_address"), F.array_join(ordered(col("scripts")), ";").alias("scripts"), F.array_join(ordered(text(col("scripts"))), "|").alias("by_script"))
    parts = F.transform(F.split("by_script", "\\|"), lambda p: F.split(p, ":")[0])
    return got.withColumn("spendable", F.array_join(F.filter(parts, lambda p: ~p.startswith("6a")), ";"))


_TARGETS = "ltrim(printf('%06x', {m}) || repeat('00', greatest(e - 3, 0)), '0')"
_EXPANDED = f"CASE WHEN e <= 3 THEN lpad(printf('%x', ({{m}}) >> (8 * greatest(3 - e, 0))), 64, '0') WHEN length({_TARGETS}) <= 64 THEN lpad({_TARGETS}, 64, '0') END"


@query(f"""WITH b AS (SELECT event_id AS id, event_id % 36 AS e, ((event_id * 7919) % 16777216)::BIGINT AS w FROM events), c AS (SELECT *, w % 8388608 AS m, w >= 8388608 AS neg FROM b),
d AS (SELECT *, {_EXPANDED.format(m="m")} AS p, {_EXPANDED.format(m="w")} AS q, repeat('f', 64) AS wide FROM c)
SELECT id, CASE WHEN neg AND m > 0 THEN '-' || CASE WHEN e <= 2 THEN lpad(printf('%x', -((-m) >> (8 * (3 - e)))), 64, '0') ELSE coalesce(p, wide) END ELSE coalesce(p, wide) END AS signed, CASE WHEN NOT neg THEN coalesce(p, wide) END AS strict, coalesce(p, wide) AS unsigned,
 CASE WHEN NOT neg AND p > repeat('0', 64) THEN p END AS bounded, CASE WHEN NOT neg AND p > repeat('0', 64) AND p <= '{LIMIT}' THEN p END AS limited, coalesce(q, wide) AS masked FROM d""")
def e09_target_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact bits as six readers take them, with signs, zeros, and more than 256 bits."""
    i = col("event_id")
    bits = F.lower(F.concat(F.lpad(F.hex(i % 36), 2, "0"), F.lpad(F.hex((i * 7919) % 16_777_216), 6, "0")))
    return events(spark, sf_dir).select(i.alias("id"), bits.alias("bits")).select("id", X.target_variants(col("bits"), LIMIT).alias("v")).select("id", "v.*")


@query(with_h("SELECT id, CASE id % 6 WHEN 1 THEN height WHEN 2 THEN height + 1 WHEN 3 THEN height END AS pushed, CASE WHEN id % 5 = 0 THEN 255 + 65536 * (id % 256) WHEN id % 5 = 1 THEN NULL WHEN id % 5 = 2 THEN id % 256 WHEN id % 5 = 3 THEN NULL ELSE 1099511627775 END AS other FROM h"))
def e12_audit_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height pushes as auditors read them: the headers' own, and some with a sign, too long, too short, or cut."""
    i = col("id")
    byte = F.lpad(F.lower(F.hex(i % 256)), 2, "0")
    other = F.when(i % 5 == 0, F.concat(F.lit("03ff00"), byte)).when(i % 5 == 1, F.lit("06" + "01" * 6)).when(i % 5 == 2, F.concat(F.lit("01"), byte)).when(i % 5 == 3, "04aabb").otherwise("05ffffffffff")
    return headers(spark, sf_dir).select("id", X.pushed_height_audit(col("script")).alias("pushed"), X.pushed_height_audit(other).alias("other"))


@query(with_h("SELECT hash AS btc_header_hash, prev AS btc_prev_hash, t::VARCHAR AS btc_time, bits AS btc_bits, height::VARCHAR AS child_height FROM h"))
def e41_old_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three old layouts in one schema: other names, decimals and written times, the header alone."""
    h, i = headers(spark, sf_dir), col("id")
    one = h.where(i % 3 == 0).select("hash", "prev", col("t").alias("time"), col("bits").alias("nbits"), "height")
    two = h.where(i % 3 == 1).select(F.upper("hash").alias("parent_hash"), col("prev").alias("parent_prev"), F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd HH:mm:ss").alias("parent_time"), F.conv("bits", 16, 10).alias("parent_bits"), F.concat(F.lit(" "), col("height").cast("string")).alias("block"))
    three = h.where(i % 3 == 2).select(F.upper("header_hex").alias("parent_header"), col("height").alias("child_block"))
    return standardised(one, "renamed").unionByName(standardised(two, "decimal")).unionByName(standardised(three, "header"))


# --- readers ---


@query(with_h("SELECT prev AS parent, min_by(hash, (id % 4) * 10000000 + id) AS hash FROM h WHERE id % 9 <> 0 GROUP BY prev"))
def s03_first_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as gzipped JSON lines in four folders, whose files are in order by their names; of those that name one parent the first counts, and broken lines don't."""
    path = fresh_path(spark, "blocks")
    i = col("id")
    line = F.when(i % 9 == 0, "{broken").otherwise(F.to_json(F.struct("hash", F.struct(col("prev").alias("parent")).alias("auxpow"))))
    h = written(headers(spark, sf_dir).select((i % 4).alias("file"), "id", line.alias("value")), "lines")
    for n in range(4):
        h.where(col("file") == n).orderBy("id").select("value").write.option("compression", "gzip").text(f"{path}/{n}")
    rows = files.first_parents(spark, f"{path}/*", T.StructType.fromDDL("hash string, auxpow struct<parent: string>"), "auxpow.parent")
    return rows.select(col("auxpow.parent").alias("parent"), "hash")


@query(with_h("SELECT height, hash, bits FROM h WHERE id % 3 = 0"))
def s07_header_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in JSON lists, a file for each chain and 100,000 ids."""
    path = fresh_path(spark, "lists")
    rows = headers(spark, sf_dir).where("id % 3 = 0").select("chain", F.floor(col("id") / 100_000).alias("part"), F.struct("height", "hash", "bits").alias("row"))
    rows.groupBy("chain", "part").agg(F.to_json(F.collect_list("row")).alias("value")).select(F.concat_ws("-", "chain", col("part").cast("string")).alias("file"), "value").write.partitionBy("file").text(path)
    return files.read_json_list(spark, f"{path}/*/*.txt", T.StructType.fromDDL("height bigint, hash string, bits string"))


@query(with_h("SELECT hash AS key, CASE id % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' WHEN 2 THEN 'unknown' ELSE 'present' END AS state, CASE WHEN id % 4 = 3 THEN '{\"height\":' || height || '}' END AS detail FROM h"))
def s07_cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches of main-chain lookups: true or an object, false, and null are three states; the last file counts, a null too."""
    path = fresh_path(spark, "caches")
    i = col("id")
    value = F.when(i % 4 == 0, "true").when(i % 4 == 1, "false").when(i % 4 == 2, "null").otherwise(F.concat(F.lit('{"height":'), col("height").cast("string"), F.lit("}")))
    h = headers(spark, sf_dir).select(F.floor(i / 20_000).cast("int").alias("group"), F.concat(F.lit('"'), "hash", F.lit('":'), value).alias("now"), F.concat(F.lit('"'), "hash", F.lit('":false')).alias("before"))
    lines = h.groupBy("group").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("now"), ","), F.lit("}")).alias("now"), F.concat(F.lit("{"), F.array_join(F.collect_list("before"), ","), F.lit("}")).alias("before"))
    lines = written(lines, "lines")
    for turn, name in enumerate(("before", "now")):
        lines.select("group", col(name).alias("value")).repartition("group").write.partitionBy("group").text(f"{path}/{turn}")
    return files.read_cache(spark, f"{path}/*/*/*.txt")


@query(with_h("SELECT id, CASE id % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'not found' END AS state, CASE WHEN id % 3 = 0 THEN id % 64 END AS size FROM h"))
def s08_census_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A census of markers as a file, by hashes in internal order."""
    path = fresh_path(spark, "census")
    h = stored(spark, sf_dir).select("id", "hash")
    size = F.when(col("id") % 3 == 0, col("id") % 64)
    h.where("id % 3 <> 2").select(F.unhex(X.rev(col("hash"), 32)).alias("hash"), size.alias("size")).write.parquet(path)
    return files.in_census(h, files.read_census(spark, path)).select("id", "state", "size")


@query("SELECT event_id // 50 AS height, count(*) AS events, sha256(string_agg('e' || event_id, '' ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def s06_block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each block, read as bytes by the height in its name."""
    path = fresh_path(spark, "blocks")
    e = events(spark, sf_dir).select(F.floor(col("event_id") / 50).alias("height"), "event_id")
    blocks = e.groupBy("height").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("e"), x.cast("string"))), "")
    files.write_block_files(blocks.select("height", F.encode(text, "utf-8").alias("content")), path)
    read = files.block_files(spark, path)
    return read.select("height", F.regexp_count(F.decode("content", "utf-8"), F.lit("e")).cast("bigint").alias("events"), F.sha2("content", 256).alias("digest"))
