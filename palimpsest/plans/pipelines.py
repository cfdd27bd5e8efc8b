"""Queries of the composite pipelines, each with the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hexbytes as X
from ..functions import proofs as B
from ..operators import claims as K
from ..operators import classifier as A
from ..operators import evidence_rows as V
from ..operators import gates as G
from ..operators.ancestry import walk
from ..operators.relevance import relevance, with_epoch_bits
from ..sources import sinks
from ..sources.discovery import listing, sources
from ..sources.family import publish_family, read_family
from ..sources.folder import delete, drop, fresh_path, written
from .evidence import C, E, by_case, canonical, epochs, headers, sql_dsha, sql_rev, with_h
from .registry import Registry
from .relational import _BITS_AT, _EPOCH_JOIN, _LENGTH, _PARENT, _TIME, _VERSION, _expected, _parents, _push_sql, _rules, _rules_sql

R = Registry()
query = R.query
col = F.col

_MEETS = "hash <= CASE bits WHEN '207fffff' THEN '7fffff' || repeat('0', 58) WHEN '1f7fffff' THEN '007fffff' || repeat('0', 56) ELSE '00000000ffff' || repeat('0', 52) END"
_BITS_GATE = "CASE WHEN expected IS NULL THEN 'UNKNOWN: canonical bits unavailable' WHEN bits = expected THEN 'VALID' ELSE 'REJECTED: bits mismatch (got ' || bits || ', expected ' || expected || ')' END"


def _classes_sql(context: str, rules: str) -> list[str]:
    """The tables of the classifier; its last, z, has a row for each header that meets its own target."""
    return [C, _PARENT, _BITS_AT, f"""k0 AS (SELECT h.id, h.chain, h.hash, h.prev, h.bits, h.t, h.version, h.script, h.declared, h.height AS own, coalesce(mh, parent_height + 1) AS height, mh, parent_height, parent_confirmations, mtp
 FROM (SELECT * FROM h WHERE {_MEETS}) h LEFT JOIN p USING (prev) LEFT JOIN (SELECT hash, height AS mh FROM c WHERE confirmations > 0) m USING (hash)),
k1 AS (SELECT k0.*, expected, CASE WHEN mh IS NOT NULL THEN 'canonical' WHEN parent_height IS NOT NULL THEN 'stale' ELSE 'unknown' END AS kind FROM k0 LEFT JOIN (SELECT height AS xh, expected FROM x) ON xh = k0.height),
k2 AS (SELECT k1.*, {_BITS_GATE} AS b, CASE WHEN parent_confirmations <= 0 THEN '{G.PLACEMENT}' ELSE {context} END AS ctx, {rules} AS proven FROM k1),
k3 AS (SELECT k2.*, CASE WHEN kind = 'stale' THEN CASE WHEN ctx = '{G.PLACEMENT}' THEN ctx WHEN ctx IS NULL OR (b LIKE 'REJECTED%' AND ctx LIKE 'UNKNOWN%') THEN b ELSE ctx END END AS status FROM k2),
k4 AS (SELECT k3.*, CASE WHEN status LIKE 'REJECTED%' THEN CASE WHEN status = '{G.PLACEMENT}' THEN 'unknown' WHEN status LIKE 'REJECTED: bits mismatch%' THEN 'unknown' WHEN expected IS NULL THEN NULL WHEN expected <> bits THEN 'unknown' WHEN len(proven) > 0 THEN 'error_block' END END AS route FROM k3),
z AS (SELECT id, chain, hash, bits, height AS btc_height, coalesce(route, kind) AS classification, status AS validation_status, CASE WHEN route = 'error_block' THEN array_to_string(proven, '|') END AS rules, CASE WHEN kind = 'stale' THEN expected END AS expected_nbits FROM k4)"""]  # fmt: skip


_FULL = _classes_sql(f"coalesce({_TIME}, {_VERSION}, {_LENGTH}, {_push_sql(True, 'own')})", _rules_sql("false", "own"))
_NO_COINBASE = _classes_sql(f"coalesce({_TIME}, {_VERSION})", f"list_filter(list_slice({_rules_sql('false', 'own')}, 1, 9), lambda r: r = 'time_below_mtp' OR r LIKE '%version%')")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers as a table: their columns are long expressions on the events, which every join and filter would repeat."""
    return written(headers(spark, sf_dir, spread=True), "headers")


def classes(h: DataFrame, coinbase_rules: bool = True) -> DataFrame:
    return A.classified(h.drop("height"), canonical(h), _expected(h), coinbase_rules=coinbase_rules)


@query(with_h("SELECT id, chain, classification, btc_height, validation_status, rules FROM z", *_FULL))
def p01_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own work and first row of each hash, canonical and parent lookups, context gates, routing of rejected rows."""
    return classes(stored(spark, sf_dir)).select("id", "chain", "classification", "btc_height", "validation_status", F.array_join("rules_violated", "|").alias("rules"))


@query(with_h("SELECT id, classification, btc_height, CASE WHEN classification = 'canonical' THEN 'VALID (canonical block)' ELSE validation_status END AS validation_status, CASE WHEN classification = 'canonical' THEN true ELSE bits = expected_nbits END AS nbits_match, btc_height >= 478559 AS post_bch_fork FROM z WHERE classification = 'canonical' OR (classification = 'stale' AND validation_status LIKE 'VALID%')", *_FULL))
def p02_family_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a family of chains publishes: canonical parents and valid stale ones, with the fork annotation, as two tables at once."""
    path = fresh_path(spark, "family")
    rows = written(A.published(classes(stored(spark, sf_dir))).select("id", "classification", "btc_height", "validation_status", "nbits_match", "post_bch_fork"), "published")
    publish_family({k: rows.where(col("classification") == k) for k in ("canonical", "stale")}, path)
    told = read_family(spark, path)
    return told["canonical"].unionByName(told["stale"])


@query(with_h("SELECT id, classification, btc_height, validation_status, rules FROM z", *_NO_COINBASE))
def p03_classifier_without_coinbase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier for chains that don't keep the coinbase: its rules are left out."""
    return classes(stored(spark, sf_dir), False).select("id", "classification", "btc_height", "validation_status", F.array_join("rules_violated", "|").alias("rules"))


_GRAPH = "sha256('f' || id) || sha256('g' || id)"
_CUT = "(2 + id % 20)"
_TOLD = sql_rev(sql_dsha(f"sha256(unhex(substr({_GRAPH}, 1, 2 * {_CUT}))) || sha256(unhex(substr({_GRAPH}, 2 * {_CUT} + 1)))"))
_HEADER = f"substr(header_hex, 1, 72) || {sql_dsha(f"'aabb' || {_TOLD} || 'cc'")} || substr(header_hex, 137, 24)"


@query(with_h(f"""SELECT id, CASE id % 5 WHEN 4 THEN 'parse_fail' WHEN 3 THEN 'no_supplement' WHEN 2 THEN 'recon_fail' ELSE CASE WHEN NOT ({_MEETS}) THEN 'pow_fail' WHEN found THEN 'pow_pass_btc' ELSE 'pow_pass_nonbtc' END END AS outcome
 FROM (SELECT id, prev IN (SELECT hash FROM c) AS found, bits, {sql_rev(sql_dsha("hx"))} AS hash FROM (SELECT *, {_HEADER} AS hx FROM h))""", C))
def p04_split_header_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers stored in parts: put together, own work, then the parent lookup."""
    i, k = col("id"), col("id") % 5
    of = lambda tag: F.sha2(F.concat(F.lit(tag), i.cast("string")), 256)
    one = lambda x: F.sha2(F.unhex(x), 256)
    whole = headers(spark, sf_dir)
    h = whole.select("id", "header_hex", F.concat(of("f"), of("g")).alias("graph"), (2 + i % 20).cast("int").alias("cut"))
    told = X.rev(X.dsha(F.concat(one(F.substr("graph", F.lit(1), 2 * col("cut"))), one(F.substr("graph", 2 * col("cut") + 1)))), 32)
    head, tail = F.substring("header_hex", 1, 72), F.substring("header_hex", 137, 24)
    h = h.withColumn("header", F.concat(head, X.dsha(F.concat(F.lit("aabb"), told, F.lit("cc"))), tail))
    blob = F.when(k != 4, F.concat(head, F.lit("02aabb01cc00"), tail))
    rows = h.select("id", blob.alias("blob"), F.when(k != 3, col("graph")).alias("graph"), F.when(k == 2, of("other")).otherwise(X.display_hash(col("header"))).alias("expected"))
    rows = rows.withColumn("s", B.split_header(F.unhex("blob"), F.unhex("graph"), F.unhex("expected"))).withColumn("f", X.header_fields(col("s.header")))
    parents = canonical(whole).select(col("hash").alias("prev"), F.lit(True).alias("found"))
    rows = rows.withColumn("prev", col("f.prev_hash")).join(parents, "prev", "left")
    outcome = F.when(col("blob").isNull(), "parse_fail").when(col("graph").isNull(), "no_supplement").when(col("s.header").isNull(), "recon_fail").when(~X.meets(col("f.hash"), X.target(col("f.bits"))), "pow_fail").when(col("found"), "pow_pass_btc").otherwise("pow_pass_nonbtc")
    return rows.select("id", outcome.alias("outcome"))


_KIND = "CASE id % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'canonical' WHEN 2 THEN 'near' WHEN 3 THEN 'stale_descendant' ELSE 'unknown' END"
_STATUS = "CASE WHEN id % 7 = 3 AND id % 2 = 0 THEN 'VALID_STALE_DESCENDANT' WHEN id % 7 = 0 AND id % 3 = 1 THEN 'REJECTED: x' WHEN id % 7 = 0 AND id % 3 = 2 THEN 'VALID: y' ELSE '' END"
_RELEVANCE = f"""q AS (SELECT a.id, a.hash, a.bits, a.t, {_KIND} AS kind, {_STATUS} AS status, id % 7 = 3 AS sidecar, m.hash IS NOT NULL AS main, id % 31 = 5 AS rejected, id % 37 = 6 AS known, CASE WHEN id % 11 = 4 THEN '207fffff' END AS strict_bits, CASE WHEN id % 41 = 5 THEN 'x_out_of_epoch_cache_range' END AS note,
  CASE WHEN a.t <= last THEN epoch_bits END AS eb, CASE WHEN a.t <= last THEN bb.bits END AS nb, CASE WHEN a.t <= last THEN ab.bits END AS na, last, {_MEETS.replace("hash", "a.hash").replace("CASE bits", "CASE a.bits")} AS meets
  FROM (SELECT h.*, e.height AS epoch_height, e.bits AS epoch_bits FROM h ASOF LEFT JOIN e ON h.t >= e.time) a CROSS JOIN (SELECT max(time) AS last FROM e) LEFT JOIN (SELECT hash FROM c WHERE confirmations > 0) m USING (hash)
  LEFT JOIN e bb ON bb.height = epoch_height - 2016 LEFT JOIN e ab ON ab.height = epoch_height + 2016),
v AS (SELECT id, CASE WHEN id % 101 = 0 THEN 'excluded|malformed_prev_hash' WHEN NOT meets THEN 'excluded|pow_target_mismatch' WHEN sidecar AND status = 'VALID_STALE_DESCENDANT' THEN '|valid_stale_descendant' WHEN sidecar THEN 'excluded|known_rejected_stale_descendant'
  WHEN kind = 'stale' AND status LIKE 'REJECTED%' THEN 'excluded|validation_rejected' WHEN kind = 'canonical' THEN 'excluded|source_canonical' WHEN kind = 'near' THEN 'excluded|source_near' WHEN kind = 'stale' AND main THEN 'excluded|known_mainchain' WHEN kind = 'stale' THEN '|valid_direct_stale'
  WHEN rejected THEN 'excluded|known_rejected_stale_descendant' WHEN known THEN 'excluded|known_stale_hash' WHEN main THEN 'excluded|known_mainchain' WHEN note IS NOT NULL THEN 'pending|above_nbits_height_horizon' WHEN strict_bits = bits THEN 'strict_btc_orphan|strict_height_nbits_match' WHEN strict_bits IS NOT NULL THEN 'excluded|non_btc_epoch_bits'
  WHEN t > last THEN 'pending|above_nbits_time_horizon' WHEN bits IN (eb, nb, na) THEN 'weak_btc_orphan|timestamp_epoch_nbits_match' WHEN eb IS NOT NULL THEN 'excluded|non_btc_epoch_bits' ELSE 'excluded|insufficient_evidence' END AS w FROM q)"""


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chain, bucket, reason; the bucket of accepted rows is null."""
    i = col("id")
    h = stored(spark, sf_dir)
    rows = with_epoch_bits(h, "t", epochs(h))
    main = canonical(h).where("confirmations > 0").select("hash", F.lit(True).alias("main"))
    rows = rows.join(main, "hash", "left")
    kind = by_case(i % 7, F.lit("stale"), F.lit("canonical"), F.lit("near"), F.lit("stale_descendant"), otherwise=F.lit("unknown"))
    status = F.when((i % 7 == 3) & (i % 2 == 0), "VALID_STALE_DESCENDANT").when((i % 7 == 0) & (i % 3 == 1), "REJECTED: x").when((i % 7 == 0) & (i % 3 == 2), "VALID: y").otherwise("")
    prev = F.when(i % 101 == 0, "short").otherwise(col("prev"))
    strict, note = F.when(i % 11 == 4, "207fffff"), F.when(i % 41 == 5, "x_out_of_epoch_cache_range")
    verdict = relevance(col("hash"), prev, col("bits"), col("t"), kind, status, i % 7 == 3, col("main"), i % 37 == 6, i % 31 == 5, strict, note, col("epoch_bits"), col("near_bits"), col("last_epoch"))
    return rows.select("id", "chain", verdict.alias("v")).select("id", "chain", "v.bucket", "v.reason")


@query(with_h("SELECT h.chain, nullif(split_part(w, '|', 1), '') AS bucket, split_part(w, '|', 2) AS reason, count(*) AS n FROM v JOIN h USING (id) GROUP BY GROUPING SETS ((1, 2, 3), (1), (2, 3))", C, E, _RELEVANCE))
def p05_relevance_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's bucket and reason, counted by chain and over all."""
    rows = _relevant(spark, sf_dir)
    return rows.groupingSets([[col("chain"), col("bucket"), col("reason")], [col("chain")], [col("bucket"), col("reason")]], "chain", "bucket", "reason").agg(F.count(F.lit(1)).alias("n"))


_NODES = "n AS (SELECT id, CASE WHEN id % 40 = 0 THEN -1 - id ELSE id - 1 END AS prev, hash, bits, 300000 + id % 40 + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS pushed FROM h)"
_PROMOTED = f"""{_NODES}, d AS (SELECT n.id, n.id - n.id % 40 + CASE WHEN n.id % 40 > 20 THEN 20 ELSE 0 END AS root, CASE WHEN n.id % 40 > 20 THEN n.id % 40 - 20 ELSE n.id % 40 END AS depth, hash, bits, pushed FROM n WHERE n.id % 40 NOT IN (0)),
g AS (SELECT d.*, CASE WHEN root % 3 <> 1 OR root % 40 = 20 THEN 300000 + root % 40 END AS root_height FROM d),
pr AS (SELECT id, root, root_height + depth AS btc_height, list_filter([CASE WHEN NOT ({_MEETS}) THEN 'pow_target_mismatch' END, CASE WHEN root_height IS NOT NULL AND bits <> '207fffff' THEN 'nbits_epoch_mismatch' END, CASE WHEN root_height IS NULL THEN 'missing_root_height' END,
  CASE WHEN pushed <> root_height + depth THEN 'bip34_height_mismatch' END], lambda r: r IS NOT NULL) AS failures FROM g)"""


def _descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks of 40 blocks with a known root at their start and one in their middle; a third of the first roots have no height."""
    i = col("id")
    pushed = 300_000 + i % 40 + F.when(i % 17 == 0, 1).otherwise(0)
    n = stored(spark, sf_dir).select(i.alias("node"), F.when(i % 40 == 0, -1 - i).otherwise(i - 1).alias("prev"), "hash", "bits", pushed.alias("pushed"))
    stops = n.where("node % 40 in (0, 20)").select("node", F.lit("known").alias("kind"))
    walks = walk(n.select("node", "prev"), stops)
    roots = stops.where("node % 3 <> 1 or node % 40 = 20").select("node", (300_000 + col("node") % 40).alias("height"))
    bits = spark.range(290_304, 310_464, 2016).select(col("id").alias("epoch"), F.lit("207fffff").alias("expected"))
    return K.promoted(walks, n.drop("prev"), roots, bits, col("pushed"))


@query(with_h("SELECT id AS node, root, btc_height, CASE WHEN len(failures) = 0 THEN 'VALID_STALE_DESCENDANT' ELSE 'REJECTED: ' || array_to_string(failures, '|') END AS validation_status FROM pr", _PROMOTED))
def p06_ancestry_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown rows that descend from a known stale root, with inferred heights and verdicts."""
    return _descendants(spark, sf_dir).select("node", col("terminal").alias("root"), "btc_height", "validation_status")


@query(with_h("SELECT id AS node, CASE WHEN failures = ['bip34_height_mismatch'] THEN CASE WHEN root % 120 = 0 THEN 'confirmed_height_mismatch' ELSE 'unproven_place' END ELSE 'other_failures' END AS verdict FROM pr WHERE len(failures) > 0", _PROMOTED))
def p12_height_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected descendants: does the rejection stand on the height push alone, and is the root's parent on the main chain?"""
    rows = _descendants(spark, sf_dir).where(F.size("failures") > 0)
    parents = rows.select("terminal").distinct().select("terminal", (col("terminal") % 120 == 0).alias("main"))
    verdict = K.audit_verdict(col("failures"), col("root_height").isNotNull(), col("main"))
    return rows.join(parents, "terminal", "left").select("node", verdict.alias("verdict"))


ALPHA = V.Source("alpha", "full_inventory", "alpha.csv", "full", "archive", "alpha_height")
BETA = V.Source("beta", "validated_stales", "beta.csv", "stales", "repo-data")


def _alpha(h: DataFrame) -> DataFrame:
    """A source with its own columns: hashes of every third row are missing, every 50th header is broken, a coinbase in bytes."""
    i = col("id")
    tx = F.concat(F.lit("0200000001" + "00" * 32 + "ffffffff0403aabbccffffffff01"), X.rev(F.lpad(F.lower(F.hex(i)), 16, "0"), 8), F.lit("0251ac"), F.lit("00000000"))
    return h.where("id % 2 = 0").select(
        i.cast("string").alias("source_row_number"), F.when(i % 3 != 0, F.upper("hash")).alias("btc_hash"), F.when(i % 50 == 0, "zz").otherwise(col("header_hex")).alias("header"),
        (col("height") - 7).alias("alpha_height"), (col("height") + 1).alias("other_height"), by_case(i % 8, F.lit("Orphan"), F.lit(""), F.lit("canonical"), F.lit(""), F.lit("stale"), otherwise=F.lit(" Unknown ")).alias("classification"),
        F.when(i % 8 == 4, "REJECTED_x").otherwise("VALID: a").alias("validation_status"), F.when(i % 10 == 0, tx).when(i % 10 == 2, "00ff").alias("full_coinbase_hex"), (col("height") - 1).alias("btc_parent_height"),
    )


def _beta(h: DataFrame) -> DataFrame:
    return h.where("id % 2 = 1").select(col("id").cast("string").alias("source_row_number"), col("header_hex").alias("btc_header_hex"), col("height").alias("btc_stale_height"), (col("height") - 9).alias("beta_height"), F.lit("VALID: b").alias("validation_status"), col("hash").alias("beta_block_hash"), (col("t") + 1).alias("child_block_time"))


_ALPHA_KIND = "CASE id % 8 WHEN 2 THEN 'canonical' WHEN 4 THEN 'stale' ELSE 'unknown' END"
_ALPHA_HASH = "CASE WHEN id % 3 <> 0 THEN hash WHEN id % 50 = 0 THEN '' ELSE hash END"


@query(with_h("SELECT id, CASE WHEN id % 2 = 0 THEN height - 7 ELSE height - 9 END::VARCHAR AS child_height, CASE WHEN id % 2 = 0 THEN '' ELSE hash END AS child_hash FROM h"))
def e35_child_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child's height and hash, from whatever columns a source has."""
    h = headers(spark, sf_dir)
    parts = [df.select(col("source_row_number").cast("bigint").alias("id"), V.child_height(df, s).alias("child_height"), V.child_hash(df, s).alias("child_hash")) for df, s in ((_alpha(h), ALPHA), (_beta(h), BETA))]
    return parts[0].unionByName(parts[1])


@query(with_h(f"""SELECT id::VARCHAR AS source_row_number, 'alpha' AS chain, CASE WHEN id % 8 = 4 THEN (height)::VARCHAR ELSE '' END AS btc_height, {_ALPHA_HASH} AS btc_header_hash, CASE WHEN id % 50 = 0 THEN '' ELSE prev END AS btc_prev_hash, CASE WHEN id % 50 = 0 THEN '' ELSE t::VARCHAR END AS btc_time,
 CASE WHEN id % 50 = 0 THEN '' ELSE bits END AS btc_bits, CASE WHEN id % 10 = 0 THEN '03aabbcc' ELSE '' END AS coinbase_scriptsig_hex, CASE WHEN id % 10 = 0 THEN '51ac:' || id ELSE '' END AS coinbase_outputs, {_ALPHA_KIND} AS classification,
 CASE WHEN id % 8 = 4 THEN 'REJECTED_x' ELSE '' END AS validation_status, CASE WHEN id % 8 = 4 THEN 'REJECTED_x' ELSE '' END AS rejection_reason,
 array_to_string(list_filter([CASE WHEN id % 50 = 0 AND id % 3 = 0 THEN 'missing_or_malformed_btc_header_hash' END, CASE WHEN id % 50 = 0 THEN 'malformed_btc_header_hex' END, CASE WHEN id % 10 = 2 THEN 'malformed_full_coinbase_hex' END], lambda r: r IS NOT NULL), '|') AS errors FROM h WHERE id % 2 = 0"""))
def e37_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source in the common schema, with labels of what is wrong in each row."""
    rows = V.normalised(_alpha(headers(spark, sf_dir)), ALPHA)
    return rows.select("source_row_number", "chain", "btc_height", "btc_header_hash", "btc_prev_hash", "btc_time", "btc_bits", "coinbase_scriptsig_hex", "coinbase_outputs", "classification", "validation_status", "rejection_reason", F.array_join("errors", "|").alias("errors"))


# Rows of an export before hydration: of alpha's inventory, which has heights for its canonical rows, and of its canonical companion; of beta's published stales and its unknown companion.
_EXPORT = f"""a AS (SELECT id::VARCHAR AS source_row_number, id, 'alpha' AS chain, CASE WHEN id % 8 IN (2, 4) THEN height::VARCHAR ELSE '' END AS btc_height, {_ALPHA_HASH} AS btc_hash, {_ALPHA_KIND} AS kind, CASE WHEN id % 8 = 4 THEN 'REJECTED_x' ELSE '' END AS status, id AS child, 'archive' AS provenance FROM h WHERE id % 2 = 0),
k AS (SELECT 'c' || id AS source_row_number, id, 'alpha' AS chain, (height + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END)::VARCHAR AS btc_height, hash AS btc_hash, 'canonical' AS kind, '' AS status, id AS child, 'repo-data' AS provenance FROM h WHERE (id % 8 = 2 AND id % 5 < 2) OR (id % 8 = 1 AND id % 5 = 0)),
y AS (SELECT * FROM a UNION ALL SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.kind = 'canonical' AND a.btc_height = k.btc_height AND a.btc_hash = k.btc_hash)
  UNION ALL SELECT id::VARCHAR, id, 'beta', height::VARCHAR, hash, 'stale', 'VALID: b', id, 'repo-data' FROM h WHERE id % 2 = 1
  UNION ALL SELECT 'u' || id, id, 'beta', '', hash, 'unknown', '', id, 'repo-data' FROM h WHERE id % 16 = 3),
o AS (SELECT y.*, CASE WHEN chain = 'beta' OR btc_hash = '' THEN 'not a target' WHEN id % 2 = 1 OR id % 12 >= 10 THEN CASE WHEN kind = 'canonical' THEN 'canonical_unhydrated' ELSE 'missing_identity' END
  WHEN id % 12 = 8 THEN CASE WHEN kind = 'canonical' THEN 'canonical_unhydrated' ELSE 'height_mismatch' END ELSE 'hydrated' END AS outcome, own FROM y JOIN (SELECT id, hash AS own FROM h) USING (id)),
w AS (SELECT source_row_number, id, chain, btc_height, btc_hash AS btc_header_hash, kind AS classification, status AS validation_status, CASE WHEN outcome = 'hydrated' THEN sha256('child' || id) WHEN id % 2 = 1 AND chain = 'beta' AND source_row_number NOT LIKE 'u%' THEN own ELSE '' END AS child_block_hash, outcome, provenance, CASE WHEN source_row_number NOT LIKE 'u%' THEN 'not a target' WHEN id % 3 = 0 THEN 'hash mismatch' ELSE 'hydrated' END AS header_outcome FROM o)"""


def _laid_out(h: DataFrame, root: str) -> None:
    """Source files as an archive and the repository's data hold them: an inventory in the archive, with an older one in the data that doesn't count; published stales; companions of both kinds."""
    i = col("id")
    put = lambda df, place: df.write.option("header", True).option("emptyValue", "").csv(f"{root}/{place}")
    inventory = _alpha(h)
    heights = F.when(col("source_row_number").cast("bigint") % 8 == 2, col("alpha_height") + 7)
    put(inventory.withColumn("btc_height", heights), "archive/alpha/classified/alpha_stale_blocks.csv")
    put(inventory.limit(3), "data/alpha_stale_blocks.csv")
    companion = h.where("(id % 8 = 2 and id % 5 < 2) or (id % 8 = 1 and id % 5 = 0)")
    put(companion.select(F.concat(F.lit("c"), i).alias("source_row_number"), F.upper("hash").alias("btc_header_hash"), (col("height") + F.when(i % 5 == 1, 1).otherwise(0)).alias("btc_height"), (col("height") - 7).alias("alpha_height"), F.lit("canonical").alias("classification")), "data/alpha_canonical_blocks.csv")
    put(_beta(h), "data/validated-stales/beta_validated_stales.csv")
    put(h.where("id % 16 = 3").select(F.concat(F.lit("u"), i).alias("source_row_number"), col("hash").alias("btc_header_hash")), "data/beta_unknown_blocks.csv")


def exported(spark: SparkSession, roots: list[str], data_root: str, chains: list[str], height_columns: dict[str, str]) -> DataFrame:
    """The rows of all chains in one schema, from the files that are found under ``roots``: each chain's inventory, or else its published stales, with its companions."""
    names = spark.createDataFrame([(c,) for c in chains], "chain string")
    told = {(r["chain"], r["role"]): r for r in sources(names, listing(spark, roots), data_root).collect()}  # a few for each chain
    parts = []
    for chain in chains:
        rows = {}
        for role in ("primary", "canonical", "unknown"):
            r = told.get((chain, role))
            if r is not None and r["path"] is not None:
                table = spark.read.option("header", True).csv(r["path"])
                rows[role] = V.normalised(table, V.Source(chain, r["source_kind"], r["path"].rpartition("/")[2], r["artifact_scope"], r["provenance"], height_columns.get(chain)))
        if rows:
            primary = rows.get("primary", next(iter(rows.values())).limit(0))
            parts.append(V.with_companions(primary, rows.get("canonical"), rows.get("unknown")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the headers that sources are laid out from, as a table."""
    return written(headers(spark, sf_dir, spread=True).select("id", "height", "t", "hash", "header_hex"), "headers", "zstd")


def _export(h: DataFrame, root: str) -> DataFrame:
    """The rows that are found in the sources, which are laid out under ``root``, with headers for beta's unknown ones, some of them wrong, and child identities, of which there are two files; the last one's count."""
    spark = h.sparkSession
    _laid_out(h, root)
    rows = exported(spark, [f"{root}/archive", f"{root}/data"], f"{root}/data", ["alpha", "beta"], {"alpha": "alpha_height"})
    unknown = h.where("id % 16 = 3").select("id", "hash", "header_hex")
    right = unknown.where("id % 3 <> 0").select("hash", "header_hex", F.lit(0).alias("ordinal"), col("id").alias("place"))
    later = unknown.where("id % 3 <> 2").select("hash", F.when(col("id") % 3 == 0, F.concat(F.lit("fe"), F.substring("header_hex", 3, 158))).otherwise(col("header_hex")).alias("header_hex"), F.lit(1).alias("ordinal"), col("id").alias("place"))
    rows = V.with_headers(rows, right.unionByName(later), "beta")
    ids = h.where("id % 2 = 0 and id % 12 < 10").select(F.lit("alpha").alias("chain"), col("hash").alias("btc_header_hash"), (col("height") - 7 + F.when(col("id") % 12 == 8, 1).otherwise(0)).cast("string").alias("child_height"), F.sha2(F.concat(F.lit("child"), col("id").cast("string")), 256).alias("child_block_hash"), col("t").cast("string").alias("child_block_time"))
    older = ids.withColumn("child_block_hash", F.sha2("child_block_hash", 256)).withColumn("file", F.lit(1))
    return V.hydrated(rows, older.unionByName(ids.withColumn("file", F.lit(2))), ())


_SHOWN = ["source_row_number", "chain", "btc_height", "btc_header_hash", "classification", "validation_status", "child_block_hash", "outcome", "provenance", "header_outcome"]


@query(with_h(f"SELECT {', '.join(_SHOWN)} FROM w", _EXPORT))
def p07_full_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-evidence export: sources and companions as they are found, in one schema, with child identities; published with its counts, in its 25 columns, and read back. What the next step
    doesn't read is deleted before it."""
    path, root = fresh_path(spark, "evidence"), fresh_path(spark, "sources")
    h = _narrow(spark, sf_dir)
    rows = written(sinks.project(_export(h, root), [*V.FIELDS, "outcome", "header_outcome"]), "export", "zstd")
    delete(spark, root)
    drop(h)
    publish_family({"evidence": rows, "counts": sinks.manifest(rows)}, path)
    drop(rows)
    return read_family(spark, path)["evidence"].select(*_SHOWN)


@query(with_h("SELECT chain, '{' || array_to_string(list_sort(list('\"' || classification || '\":' || n)), ',') || '}' AS counts FROM (SELECT chain, classification, count(*) AS n FROM w GROUP BY 1, 2) GROUP BY chain", _EXPORT))
def p07_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that are published beside the export."""
    return sinks.manifest(_export(_narrow(spark, sf_dir), fresh_path(spark, "sources")))


@query(with_h("""SELECT source_row_number, btc_header_hash, CASE classification WHEN 'canonical' THEN 'canonical' WHEN 'stale' THEN 'stale' ELSE CASE WHEN id % 5 = 0 AND chain = 'alpha' THEN 'valid_stale_descendant' WHEN id % 18 = 0 OR id % 9 = 3 THEN 'strict_btc_orphan' ELSE 'weak_btc_orphan' END END AS verdict, CASE WHEN classification = 'unknown' AND id % 5 = 0 AND chain = 'alpha' THEN 'VALID_STALE_DESCENDANT' ELSE validation_status END AS validation_status
 FROM w WHERE classification = 'canonical' OR (classification = 'stale' AND validation_status LIKE 'VALID%') OR (classification = 'unknown' AND btc_header_hash <> '' AND ((id % 5 = 0 AND chain = 'alpha') OR id % 9 IN (0, 3)))""", _EXPORT))
def p08_monitor_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the full export that a monitor admits. Some hashes have both verdicts."""
    h = stored(spark, sf_dir)
    observed = h.where("id % 5 = 0 and id % 2 = 0").select(F.lit("alpha").alias("chain"), col("hash").alias("btc_header_hash"))
    told = lambda rows, verdict: h.where(rows).select(col("hash").alias("btc_header_hash"), F.lit(verdict).alias("verdict"))
    verdicts = told("id % 9 in (0, 3)", "weak_btc_orphan").unionByName(told("id % 18 = 0 or id % 9 = 3", "strict_btc_orphan")).unionByName(told("id % 9 = 5", "excluded"))
    return V.admitted(_export(h, fresh_path(spark, "sources")), observed, verdicts).select("source_row_number", "btc_header_hash", "verdict", "validation_status")


_CLAIMED = "CASE WHEN id % 11 = 0 THEN ['time_below_mtp'] WHEN id % 13 = 0 THEN list_slice(derived, 2, 9) ELSE derived END"
_CLAIMS_SQL = f"""dv AS (SELECT id, height, hash, {_rules_sql()} AS derived FROM {_EPOCH_JOIN}), cl AS (SELECT *, {_CLAIMED} AS claimed FROM dv WHERE len(derived) > 0),
fl AS (SELECT *, list_concat(list_transform(list_filter(claimed, lambda r: NOT list_contains(derived, r)), lambda r: 'not proven: ' || r), list_transform(list_filter(derived, lambda r: NOT list_contains(claimed, r)), lambda r: 'not claimed: ' || r),
  CASE WHEN len(claimed) = 0 THEN ['no rule claimed'] WHEN id % 19 = 0 THEN ['reason is not the first rule'] ELSE [] END) AS failures FROM cl)"""


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a rule, with claims of which some are wrong."""
    r = _rules(stored(spark, sf_dir)).where(F.size("rules") > 0)
    claimed = F.when(col("id") % 11 == 0, F.array(F.lit(G.MTP))).when(col("id") % 13 == 0, F.slice("rules", 2, 9)).otherwise(col("rules"))
    r = r.select("id", "chain", "height", "hash", "header_hex", "rules", claimed.alias("claimed"))
    reason = F.when(col("id") % 19 == 0, "another").otherwise(F.get("claimed", F.lit(0)))
    return r.withColumn("failures", K.claim_failures(col("claimed"), col("rules"), reason))


@query(with_h("SELECT id, array_to_string(derived, '|') AS derived, array_to_string(failures, '|') AS failures FROM fl", C, _PARENT, E, _CLAIMS_SQL))
def p09_error_block_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim is derived again from the bytes, and rules that the bytes prove must be claimed."""
    return _claimed(spark, sf_dir).select("id", F.array_join("rules", "|").alias("derived"), F.array_join("failures", "|").alias("failures"))


@query(with_h("SELECT id, height, hash, CASE id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS source_group FROM fl WHERE len(failures) = 0", C, _PARENT, E, _CLAIMS_SQL))
def p10_error_block_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set of error blocks: rows without a failure, with their source group, published as a whole."""
    path = fresh_path(spark, "error_blocks")
    groups = spark.createDataFrame([(0, "A"), (1, "B")], "k long, source_group string")
    rows = _claimed(spark, sf_dir).where(F.size("failures") == 0).withColumn("k", col("id") % 2).join(F.broadcast(groups), "k")
    sinks.publish(rows.select("id", "height", "hash", "source_group"), path + ".staging", path)
    return spark.read.parquet(path)


@query(with_h(f"""SELECT sweep, id FROM (SELECT 'version' AS sweep, * FROM sw WHERE ({_VERSION}) LIKE 'REJECTED%' UNION ALL SELECT 'length', * FROM sw WHERE ({_LENGTH}) LIKE 'REJECTED%' UNION ALL SELECT 'time', * FROM sw WHERE ({_TIME}) IS NOT NULL UNION ALL SELECT 'push', * FROM sw WHERE ({_push_sql(False)}) LIKE 'REJECTED: height push%')""",
 C, _PARENT, _BITS_AT, f"sw AS (SELECT h.*, mtp, expected FROM h LEFT JOIN p USING (prev) LEFT JOIN (SELECT height AS xh, expected FROM x) ON xh = height WHERE id % 25 <> 0 AND {_MEETS} AND {_MEETS.replace('CASE bits', 'CASE expected')} AND expected IS NOT NULL)"))
def p11_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sweeps for rows that break a rule, meet their own and the main chain's target, and aren't known yet."""
    h = stored(spark, sf_dir)
    rows = written(h.join(_parents(h), "prev", "left").join(_expected(h), "height", "left"), "context")
    known = h.where("id % 25 = 0").select("height", "hash")
    findings = {
        "version": G.version_gate(col("height"), col("header_hex")).startswith("REJECTED"),
        "length": G.length_gate(col("script")).startswith("REJECTED"),
        "time": G.time_gate(col("t"), col("mtp")).startswith("REJECTED"),
        "push": G.height_gate(col("height"), col("header_hex"), F.lit(None).cast("string"), col("script")).startswith("REJECTED: height push"),
    }
    parts = [K.swept(rows, f, known, name).select("sweep", "id") for name, f in findings.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(with_h(f"""SELECT id, CASE WHEN id % 4 = 1 THEN 'block_not_found' WHEN id % 4 = 2 THEN 'no_parent_header' WHEN id % 8 = 3 THEN 'parent_mismatch:' || {sql_rev(sql_dsha("header_hex"))} ELSE '' END AS note, CASE WHEN id % 4 = 0 OR id % 8 = 7 THEN sha256('child' || id) END AS child_block_hash
 FROM (SELECT id, CASE WHEN id % 8 = 3 THEN 'ff' || substr(header_hex, 3) ELSE header_hex END AS header_hex FROM h WHERE id % 5 <> 0 AND NOT (id % 8 = 3 AND starts_with(header_hex, 'ff')))"""))
def j21_identity_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child blocks of a snapshot must derive the parent's hash again; what doesn't gets a note."""
    i = col("id")
    h = headers(spark, sf_dir).where(~((i % 8 == 3) & col("header_hex").startswith("ff")))
    evidence = h.select(i.cast("string").alias("chain"), col("hash").alias("btc_header_hash"), (col("height") - 7).alias("child_height"), F.when(i % 5 == 0, "canonical").otherwise("stale").alias("classification"))
    header = F.when(i % 4 == 2, "").when(i % 8 == 3, F.concat(F.lit("ff"), F.substring("header_hex", 3, 158))).otherwise(col("header_hex"))
    blocks = h.where("id % 4 <> 1").select(i.cast("string").alias("chain"), (col("height") - 7).alias("height"), F.sha2(F.concat(F.lit("child"), i.cast("string")), 256).alias("block_hash"), header.alias("parent_header"))
    return K.recovered(K.recovery_targets(evidence), blocks).select(col("chain").cast("bigint").alias("id"), "note", "child_block_hash")
