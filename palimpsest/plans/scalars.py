"""Queries of the protocol's scalar operators, one row per header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hexbytes as X
from ..functions.hexbytes import shift_left
from ..functions.registry import CHAIN_IDS, TAGS, tags
from .evidence import H, by_case, events, headers, sql_dsha, sql_le32, sql_push3, sql_rev, sql_u32, with_h
from .registry import Registry

R = Registry()
query = R.query


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN event_id % 253 WHEN 1 THEN 253 + event_id % 1000 WHEN 2 THEN 65536 + event_id ELSE 4294967296 + event_id END AS value,
 CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 9 END AS size FROM events""")
def e01_compact_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes a number as a compact size, then decodes the bytes."""
    i = F.col("id")
    e = events(spark, sf_dir).select(F.col("event_id").alias("id")).withColumn("v", by_case(i % 4, i % 253, 253 + i % 1000, 65_536 + i, otherwise=4_294_967_296 + i))
    v = F.col("v")
    le = lambda size: X.rev(F.lpad(F.lower(F.hex("v")), 2 * size, "0"), size)
    coded = F.when(v < 253, le(1)).when(v < 65_536, F.concat(F.lit("fd"), le(2))).when(v < 2**32, F.concat(F.lit("fe"), le(4))).otherwise(F.concat(F.lit("ff"), le(8)))
    e = e.withColumn("b", coded)
    first, body = F.substring("b", 1, 2), lambda size: F.substring("b", 3, 2 * size)
    size = F.when(first == "fd", 3).when(first == "fe", 5).when(first == "ff", 9).otherwise(1)
    value = F.when(first == "fd", X.le_int(body(2), 2)).when(first == "fe", X.le_int(body(4), 4)).when(first == "ff", X.le_int(body(8), 8)).otherwise(X.big_endian(first))
    return e.select("id", value.alias("value"), size.alias("size"))


@query(with_h("SELECT id, version, prev AS prev_hash, merkle AS merkle_root, t AS time, bits, id AS nonce, hash FROM h"))
def e04_header_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("id", X.header_fields(F.col("header_hex")).alias("f")).select("id", "f.*")


@query(with_h("SELECT id, id % 5 <> 0 AS authentic, id % 5 <> 1 AS well_formed, t % 4294967296 AS child_time FROM h WHERE id % 5 <> 2 UNION ALL SELECT id, NULL, true, NULL FROM h WHERE id % 5 = 2"))
def e05_child_authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header must hash to the id it is claimed for. Of five rows one claims another id, one a longer text that begins with
    the id, and one has a header that is cut short."""
    i = F.col("id") % 5
    h = headers(spark, sf_dir).select(
        "id",
        by_case(i, F.concat(F.lit("00"), F.substring(F.reverse("hash"), 1, 62)), F.concat("hash", F.lit("00")), otherwise=F.col("hash")).alias("claimed"),
        F.when(i == 2, F.substring("header_hex", 1, 158)).otherwise(F.col("header_hex")).alias("header_hex"),
    )
    f = X.header_fields(F.col("header_hex"))
    return h.select("id", (f["hash"] == F.substring("claimed", 1, 64)).alias("authentic"), X.is_hex(F.col("claimed"), 32).alias("well_formed"), f["time"].alias("child_time"))


@query(with_h("SELECT id, CASE WHEN id % 4 <> 3 THEN header_hex END AS rebuilt, CASE WHEN id % 4 <> 3 THEN id % 4 <> 2 END AS same FROM h"))
def e06_header_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded and serialised again, against another header's bytes in every fourth row; a malformed header gives nothing."""
    i = F.col("id") % 4
    h = headers(spark, sf_dir).select("id", F.when(i == 3, F.concat(F.lit("zz"), F.substring("header_hex", 3, 158))).otherwise(F.col("header_hex")).alias("header_hex"))
    h = h.select("id", F.when(i == 2, F.concat(F.substring("header_hex", 1, 158), F.lit("zz"))).otherwise(F.col("header_hex")).alias("told"), X.header_fields(F.col("header_hex")).alias("f")).select("id", "told", "f.*")
    made = X.header_of(*(F.col(c) for c in ("version", "prev_hash", "merkle_root", "time", "bits", "nonce")))
    return h.select("id", made.alias("rebuilt"), (made == F.col("told")).alias("same"))


@query(with_h(f"SELECT id, {sql_dsha('header_hex')} AS internal, {sql_rev(sql_dsha('header_hex'))} AS display FROM h"))
def e07_double_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("id", X.dsha(F.col("header_hex")).alias("internal"), X.display_hash(F.col("header_hex")).alias("display"))


@query(with_h(f"SELECT id, {sql_rev('hash')} AS internal, hash AS display FROM h"))
def e08_byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("id", X.rev(F.col("hash"), 32).alias("internal"), X.rev_any(X.rev_any(F.col("hash"))).alias("display"))


_BITS = "printf('%02x', (1 + event_id % 36)::BIGINT) || printf('%06x', (event_id * 7919) % 16777216)"


@query(f"""WITH b AS (SELECT event_id AS id, 1 + event_id % 36 AS e, (event_id * 7919) % 16777216 AS m, {_BITS} AS bits FROM events),
d AS (SELECT *, ltrim(printf('%06x', m) || repeat('00', greatest(e - 3, 0)), '0') AS digits FROM b)
SELECT id, bits, CASE WHEN m >= 8388608 THEN NULL WHEN e <= 3 THEN lpad(printf('%x', m >> (8 * greatest(3 - e, 0))), 64, '0') WHEN length(digits) > 64 THEN repeat('f', 64) ELSE lpad(digits, 64, '0') END AS target FROM d""")
def e09_compact_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of 1 to 36 bytes: negative ones are null, those over 256 bits are all ones."""
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"))
    i = F.col("id")
    bits = F.lower(F.concat(F.lpad(F.hex(1 + i % 36), 2, "0"), F.lpad(F.hex((i * 7919) % 16_777_216), 6, "0")))
    return e.select("id", bits.alias("bits")).select("id", "bits", X.target(F.col("bits")).alias("target"))


@query(with_h("""SELECT id, hash <= CASE bits WHEN '207fffff' THEN '7fffff' || repeat('0', 58) WHEN '1f7fffff' THEN '007fffff' || repeat('0', 56) ELSE '00000000ffff' || repeat('0', 52) END AS meets FROM h"""))
def e11_proof_of_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("id", X.meets(F.col("hash"), X.target(F.col("bits"))).alias("meets"))


@query(with_h("SELECT id, CASE id % 6 WHEN 1 THEN height WHEN 2 THEN height + 1 WHEN 3 THEN height END AS pushed FROM h"))
def e12_height_push_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("id", X.pushed_height(F.col("script")).alias("pushed"))


@query(with_h(f"SELECT id, {sql_push3('height')} AS prefix, starts_with(script, {sql_push3('height')}) AS matches FROM h"))
def e13_height_push_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = X.push_prefix(F.col("height"))
    return headers(spark, sf_dir).select("id", prefix.alias("prefix"), F.startswith("script", prefix).alias("matches"))


@query(with_h(f"""SELECT id, CASE WHEN id % 6 = 3 THEN 'present' ELSE 'absent' END AS status, CASE WHEN id % 6 = 3 THEN 4 END AS at, CASE WHEN id % 6 = 3 THEN {sql_rev('merkle')} END AS root,
 CASE WHEN id % 6 = 3 THEN 1 << (id % 5) END AS size, CASE WHEN id % 6 = 3 THEN (id * 7919) & 4294967295 END AS nonce FROM h"""))
def e14_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("id", X.marker(F.col("script")).alias("m")).select("id", "m.status", F.col("m.offset").alias("at"), "m.root", "m.size", "m.nonce")


_TAG_SQL = " UNION ALL ".join(f"SELECT {i} AS ordinal, '{t}' AS tag, '{c}' AS class, '{p}' AS prefix" for i, (t, c, p) in enumerate(TAGS))
_SCRIPT_SQL = f"""s AS (SELECT event_id AS id, sha256('t' || event_id) AS junk, event_id % 14 AS k FROM events),
g AS ({_TAG_SQL}),
r AS (SELECT id, CASE WHEN k < 12 THEN (SELECT prefix FROM g WHERE ordinal = k) ELSE '' END || junk AS payload, k FROM s),
o AS (SELECT id, k, payload, CASE WHEN k = 13 THEN '6a' || printf('%02x', (length(payload) // 2 + 9)::BIGINT) || payload WHEN id % 2 = 0 THEN '6a4c' || printf('%02x', (length(payload) // 2)::BIGINT) || payload ELSE '6a' || printf('%02x', (length(payload) // 2)::BIGINT) || payload END AS script FROM r)"""


def _tagged_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP_RETURN scripts with each tag, without one, and cut short."""
    k = F.col("id") % 14
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"))
    payload = F.concat(by_case(k, *(F.lit(p) for _, _, p in TAGS), otherwise=F.lit("")), F.sha2(F.concat(F.lit("t"), F.col("id").cast("string")), 256))
    size = lambda more: F.lpad(F.lower(F.hex((F.length("payload") / 2).cast("bigint") + more)), 2, "0")
    script = F.when(k == 13, F.concat(F.lit("6a"), size(9), "payload")).when(F.col("id") % 2 == 0, F.concat(F.lit("6a4c"), size(0), "payload")).otherwise(F.concat(F.lit("6a"), size(0), "payload"))
    return e.withColumn("payload", payload).select("id", script.alias("script"))


@query(f"WITH {_SCRIPT_SQL} SELECT id, CASE WHEN k <> 13 THEN payload END AS payload FROM o")
def e15_op_return_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged_scripts(spark, sf_dir).select("id", X.op_return_payload(F.col("script")).alias("payload"))


@query(f"""WITH {_SCRIPT_SQL} SELECT o.id, coalesce(min_by(g.tag, g.ordinal), CASE WHEN any_value(k) = 13 THEN 'malformed' ELSE 'unknown' END) AS tag, min_by(g.class, g.ordinal) AS class,
 CASE WHEN min(g.ordinal) IS NULL AND any_value(k) <> 13 THEN substr(any_value(payload), 1, 8) END AS first_bytes, CASE WHEN any_value(k) = 13 THEN any_value(script) END AS raw
FROM o LEFT JOIN g ON k <> 13 AND starts_with(payload, prefix) GROUP BY o.id""")
def e16_tag_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tag whose prefix fits; a broadcast prefix join, then the least ordinal. What has no tag is told by its first bytes,
    what is malformed as it is."""
    s = _tagged_scripts(spark, sf_dir).withColumn("payload", X.op_return_payload(F.col("script")))
    hit = s.join(F.broadcast(tags(spark)), F.startswith("payload", F.col("prefix")), "left")
    best = hit.groupBy("id").agg(F.min_by("tag", "ordinal").alias("tag"), F.min_by("class", "ordinal").alias("class"), F.first("payload").alias("payload"), F.first("script").alias("script"))
    malformed = F.col("payload").isNull()
    return best.select("id", F.coalesce("tag", F.when(malformed, "malformed").otherwise("unknown")).alias("tag"), "class", F.when(F.col("tag").isNull() & ~malformed, F.substring("payload", 1, 8)).alias("first_bytes"), F.when(malformed, F.col("script")).alias("raw"))


_STEP = "((({}) * 1103515245 + 12345) & 4294967295)"
_SLOT = _STEP.format(f"({_STEP.format('n')} + chain_id) & 4294967295") + " % (1 << depth)"


@query(f"""WITH a AS (SELECT event_id AS id, (event_id * 7919) & 4294967295 AS n, event_id % 97 AS chain_id, event_id % 9 AS depth FROM events)
SELECT id, {_SLOT} AS slot, chain_id % (1 << depth) AS residue FROM a""")
def e18_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of a chain id, and the residue recovered from the slot."""
    i = F.col("event_id")
    a = events(spark, sf_dir).select(i.alias("id"), (i * 7919).bitwiseAND(F.lit(X.MASK32).cast("bigint")).alias("n"), (i % 97).alias("chain_id"), (i % 9).cast("int").alias("depth"))
    a = a.withColumn("slot", X.slot(F.col("n"), F.col("chain_id"), F.col("depth")))
    return a.select("id", "slot", X.residue(F.col("n"), F.col("slot"), F.col("depth")).alias("residue"))


_CHAINS_SQL = ", ".join(f"({k}, '{name}', {i})" for k, (name, i) in enumerate(CHAIN_IDS))


@query(f"""WITH a AS (SELECT event_id AS id, event_id % 6 AS depth, event_id % (1 << (event_id % 6)) AS residue FROM events), g AS (SELECT * FROM (VALUES {_CHAINS_SQL}) r(k, name, chain_id))
SELECT id, string_agg(name, ',' ORDER BY k) AS candidates, count(chain_id) AS n FROM a LEFT JOIN g ON chain_id % (1 << depth) = residue GROUP BY id""")
def e19_residue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered chains whose id is congruent to a residue, in the registry's order; it is one array, so nothing is joined."""
    a = events(spark, sf_dir).select(F.col("event_id").alias("id"), shift_left(F.lit(1).cast("bigint"), (F.col("event_id") % 6).cast("int")).alias("m"))
    a = a.withColumn("residue", F.col("id") % F.col("m"))
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(i).cast("bigint").alias("chain_id")) for name, i in CHAIN_IDS))
    found = F.filter(known, lambda c: F.pmod(c["chain_id"], F.col("m")) == F.col("residue"))
    return a.select("id", F.when(F.size(found) > 0, F.array_join(found["name"], ",")).alias("candidates"), F.size(found).cast("bigint").alias("n"))


def _fold_sql() -> str:
    cur = "sha256('l' || event_id)"
    for k in range(3):
        sib = f"sha256('s{k}' || event_id)"
        cur = f"CASE WHEN (event_id >> {k}) & 1 = 1 THEN {sql_dsha(f'({sib} || {cur})')} ELSE {sql_dsha(f'({cur} || {sib})')} END"
    return cur


@query(f"SELECT event_id AS id, {_fold_sql()} AS root FROM events")
def e20_merkle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    of = lambda tag: F.sha2(F.concat(F.lit(tag), i), 256)
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), X.merkle_fold(of("l"), F.array(*(of(f"s{k}") for k in range(3))), F.col("event_id")).alias("root"))


@query("""WITH a AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 << (event_id % 5) ELSE event_id % 40 END AS size, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS depth FROM events)
SELECT id, CASE WHEN size IS NULL THEN 'missing_parent_commitment' WHEN size < 0 THEN 'invalid_negative_size' WHEN depth IS NULL AND size = 0 THEN 'legacy_single_slot_unverified' WHEN depth IS NULL THEN 'census_only_size_without_branch'
 WHEN size = 0 AND depth = 0 THEN 'legacy_single_slot_verified' WHEN size = 0 THEN 'zero_size_branch_mismatch' WHEN size = 1 << depth THEN 'matched' WHEN bit_count(size) <> 1 THEN 'non_power_of_two_size' ELSE 'size_branch_mismatch' END AS status FROM a""")
def e21_size_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    none = F.lit(None).cast("bigint")
    size = by_case(i % 7, none, F.lit(-1), F.lit(0), shift_left(F.lit(1).cast("bigint"), (i % 5).cast("int")), otherwise=i % 40)
    a = events(spark, sf_dir).select(i.alias("id"), size.alias("size"), F.when(i % 3 != 0, (i % 5).cast("int")).alias("depth"))
    return a.select("id", X.size_status(F.col("size"), F.col("depth")).alias("status"))


@query(f"""WITH {H}, m AS (SELECT id, 1 << (id % 5) AS size, (id * 7919) & 4294967295 AS n, id % 5 AS depth, id % 97 AS chain_id FROM h WHERE id % 6 = 3)
SELECT id, 'matched' AS status, {_SLOT} AS slot, chain_id % (1 << depth) AS residue FROM m""")
def e22_chain_id_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the marker in a script: size status, the chain's slot, and the residue that the slot implies."""
    h = headers(spark, sf_dir).select("id", X.marker(F.col("script")).alias("m")).where("m.status = 'present'")
    h = h.select("id", "m.*").withColumn("depth", (F.col("id") % 5).cast("int")).withColumn("slot", X.slot(F.col("nonce"), F.col("id") % 97, F.col("depth")))
    return h.select("id", X.size_status(F.col("size"), F.col("depth")).alias("status"), "slot", X.residue(F.col("nonce"), F.col("slot"), F.col("depth")).alias("residue"))


@query("""WITH a AS (SELECT o_orderkey AS id, string_agg('addr' || l_suppkey || ':' || l_quantity::BIGINT, '|' ORDER BY l_linenumber, l_partkey, 'addr' || l_suppkey || ':' || l_quantity::BIGINT) AS outs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT id, outs, list_aggregate(list_transform(string_split(outs, '|'), lambda x: string_split(x, ':')[1]), 'string_agg', ';') AS scripts FROM a""")
def e26_output_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addr:value|... and its addresses alone, joined by semicolons."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber", "l_partkey")
    out = F.concat(F.lit("addr"), F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("bigint").cast("string"))
    got = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", out.alias("o")))).alias("o"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    got = got.join(orders, "id", "left_semi").select("id", F.array_join("o.o", "|").alias("outs"))
    return got.select("id", "outs", F.array_join(F.transform(F.split("outs", "\\|"), lambda x: F.split(x, ":")[0]), ";").alias("scripts"))


@query("""WITH v AS (SELECT event_id AS id, (event_id * 65599) % 4294967296 AS v FROM events) SELECT id, (v >> 16) & 65535 AS chain_id, (v & 256) <> 0 AS merged, (v & 3584) >> 9 AS algo FROM v""")
def e29_version_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    bit = lambda m: F.lit(m).cast("bigint")
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), ((F.col("event_id") * 65_599) % 2**32).alias("v"))
    return e.select("id", F.shiftright(v, 16).bitwiseAND(bit(65_535)).alias("chain_id"), (v.bitwiseAND(bit(256)) != 0).alias("merged"), F.shiftright(v.bitwiseAND(bit(3584)), 9).alias("algo"))


@query(with_h("""SELECT id, CASE id % 3 WHEN 0 THEN bits WHEN 1 THEN printf('%08x', id * 65537) END AS bits FROM h"""))
def e31_bits_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex in any case, or decimal where the caller says so; other texts are null."""
    i = F.col("id")
    raw = by_case(i % 3, F.concat(F.lit(" "), F.upper("bits")), (i * 65_537).cast("string"), otherwise=F.lit("zz"))
    return headers(spark, sf_dir).select("id", X.bits_text(raw, i % 3 == 1).alias("bits"))


@query(with_h("SELECT id, hash, CASE WHEN id % 9 > 1 THEN height + CASE WHEN id % 9 = 2 THEN 5 ELSE 0 END END AS number FROM h"))
def e32_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    return h.select("id", X.hash_text(F.concat(F.lit("  "), F.upper("hash"))).alias("hash"), X.whole_number(F.col("declared")).alias("number"))


@query(with_h("SELECT id, hash AS btc_header_hash, t AS btc_time FROM h"))
def e33_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alias that the table has; where its text is empty, the value comes from the header's bytes."""
    h = headers(spark, sf_dir).select("id", "header_hex", F.when(F.col("id") % 2 == 0, F.col("hash")).otherwise(F.lit(" ")).alias("btc_hash"))
    alias = next(c for c in ("btc_header_hash", "btc_hash", "hash") if c in h.columns)
    f = X.header_fields(F.col("header_hex"))
    return h.select("id", F.coalesce(F.nullif(F.trim(alias), F.lit("")), f["hash"]).alias("btc_header_hash"), f["time"].alias("btc_time"))


@query(with_h("SELECT id, CASE WHEN id % 9 > 2 THEN height WHEN id % 9 = 2 THEN height + 5 WHEN (id // 3) % 2 = 0 AND id % 3 = 0 THEN height WHEN (id // 3) % 2 = 0 THEN (220000 + ((id // 3) * 159) % 180000) ELSE CASE id % 6 WHEN 1 THEN height WHEN 2 THEN height + 1 WHEN 3 THEN height END END AS resolved FROM h"))
def e34_height_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared height, else the parent's plus one, else the pushed one."""
    from .evidence import canonical

    h = headers(spark, sf_dir)
    parents = canonical(h).select(F.col("hash").alias("prev"), F.col("height").alias("parent_height"))
    joined = h.join(parents, "prev", "left")
    return joined.select("id", F.coalesce(X.whole_number(F.col("declared")), F.col("parent_height") + 1, X.pushed_height(F.col("script"))).alias("resolved"))


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'canonical' WHEN 2 THEN 'unknown' WHEN 3 THEN 'stale' ELSE 'unknown' END AS classification,
 CASE event_id % 5 WHEN 3 THEN 'REJECTED_nbits' END AS rejection_reason, event_id % 5 = 0 AS valid FROM events""")
def e36_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings unified; a rejected status is also the reason; statuses are tested by prefix."""
    i = F.col("event_id")
    e = events(spark, sf_dir).select(i.alias("id"), by_case(i % 5, F.lit("Stale "), F.lit("canonical"), F.lit(""), F.lit("STALE"), otherwise=F.lit("orphan")).alias("c"), by_case(i % 5, F.lit("VALID: ok"), F.lit(""), F.lit(""), F.lit("REJECTED_nbits"), otherwise=F.lit("")).alias("s"))
    c = F.lower(F.trim("c"))
    return e.select("id", F.when(c.isin("", "orphan"), "unknown").otherwise(c).alias("classification"), F.when(F.startswith("s", F.lit("REJECTED")), F.col("s")).alias("rejection_reason"), F.startswith("s", F.lit("VALID")).alias("valid"))


@query("SELECT event_id AS id, epoch_us(date_trunc('second', ts)) // 1000000 AS seconds FROM events")
def e38_display_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A displayed UTC time back to seconds."""
    shown = F.date_format("ts", "yyyy-MM-dd, HH:mm:ss 'UTC'")
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.unix_timestamp(F.to_timestamp(shown, "yyyy-MM-dd, HH:mm:ss 'UTC'")).alias("seconds"))


@query("SELECT event_id AS id, 'data/chain' || (user_id % 7) || '/rows.csv' AS path FROM events")
def e39_path_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/home/user"), F.col("user_id").cast("string"), F.lit("/work/data/chain"), (F.col("user_id") % 7).cast("string"), F.lit("/rows.csv"))
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.regexp_replace(path, "^.*/(data/)", "$1").alias("path"))


@query(with_h("SELECT id, CASE WHEN t BETWEEN (SELECT min(t) + 86400 FROM h) AND (SELECT min(t) + 864000 FROM h) THEN 'true' ELSE '' END AS in_window FROM h"))
def e40_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    first = h.agg(F.min("t").alias("t0"))
    return h.join(F.broadcast(first)).select("id", F.when(F.col("t").between(F.col("t0") + 86_400, F.col("t0") + 864_000), "true").otherwise("").alias("in_window"))


@query(with_h("SELECT hash AS btc_header_hash, prev AS btc_prev_hash, t AS btc_time, bits AS btc_bits, chain || ':' || height AS source FROM h"))
def e41_legacy_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old layout's names and encodings to the shared schema."""
    names = {"hash": "btc_header_hash", "prev": "btc_prev_hash", "t": "btc_time", "bits": "btc_bits"}
    h = headers(spark, sf_dir).withColumn("source", F.concat_ws(":", "chain", F.col("height").cast("string")))
    return h.select(*names, "source").withColumnsRenamed(names)
