"""Evidence rows of many sources in one schema of 25 text columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hexbytes import header_fields, is_hex
from ..functions.proofs import coinbase

# The schema's columns, and the columns of sources that they are read from, in order of preference.
FIELDS = [
    "chain", "source_kind", "source_path", "source_row_number", "artifact_scope", "provenance", "child_height", "child_block_hash", "child_header_hex", "child_block_time", "child_nbits",
    "btc_height", "btc_header_hash", "btc_prev_hash", "btc_time", "btc_bits", "btc_nonce", "btc_header_hex", "coinbase_scriptsig_hex", "coinbase_outputs", "full_coinbase_hex",
    "classification", "validation_status", "expected_nbits", "rejection_reason",
]
HASHES, HEADERS, BITS = ("btc_header_hash", "btc_hash", "hash"), ("btc_header_hex", "header"), ("btc_bits", "btc_bits_hex")
HEIGHTS = ("btc_height", "btc_stale_height", "height", "btc_canonical_height")
NO_CHILD_HEIGHTS = {*HEIGHTS, "btc_parent_height", "btc_bip34_height", "root_stale_height", "stale_fork_depth"}


@dataclass(frozen=True)
class Source:
    chain: str
    kind: str = "full_inventory"
    path: str = ""
    scope: str = ""
    provenance: str = ""
    height_column: str | None = None
    whole_bundle: bool = False


def _texts(df: DataFrame) -> dict[str, Column]:
    return {c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns}


def first_column(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The text of the first of ``names`` that the table has; empty if it has none."""
    texts = _texts(df)
    return next((texts[n] for n in names if n in texts), F.lit(""))


def filled(*choices: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices), F.lit(""))


def child_height(df: DataFrame, source: Source) -> Column:
    """The chain's own column, else the first filled height column that isn't the parent chain's, else child_height."""
    texts = _texts(df)
    own = [texts[source.height_column]] if source.height_column in texts else []
    others = [texts[c] for c in df.columns if c.endswith("_height") and c not in NO_CHILD_HEIGHTS]
    return filled(*own, *others, texts.get("child_height", F.lit("")))


def child_hash(df: DataFrame, source: Source) -> Column:
    return F.lower(first_column(df, (f"{source.chain}_block_hash", f"{source.chain.replace('-', '_')}_block_hash", "child_block_hash", "block_hash")))


def bundle_fault(h: Column, header: Column, time: Column, bits: Column, whole: bool) -> Column:
    """Why a child's fields disagree with its header; null if they agree. All four must be there if ``whole``, else those that are are
    checked."""
    f = header_fields(header)
    some = (h != "") | (header != "") | (time != "") | (bits != "")
    missing = (h == "") | (header == "") | (time == "") | (bits == "")
    checks = F.coalesce(
        F.when((h != "") & ~is_hex(h, 32), "malformed child hash"),
        F.when((header != "") & f.isNull(), "malformed child header"),
        F.when((h != "") & (header != "") & (f["hash"] != h), "child header hashes to another block"),
        F.when((time != "") & (header != "") & (f["time"].cast("string") != time), "child time differs from its header"),
        F.when((bits != "") & (header != "") & (f["bits"] != bits), "child bits differ from its header"),
    )
    return F.when(F.lit(whole) & missing, "incomplete child bundle").when(some, checks)


def normalised(df: DataFrame, source: Source, row_number: str = "source_row_number") -> DataFrame:
    """``df`` in FIELDS, with ``errors`` (an array of labels) and ``child_fault``. Columns that a source lacks are filled from the
    header's or the coinbase's bytes; provenance of a table that is already in this schema is kept."""
    texts = _texts(df)
    at = lambda c: texts.get(c, F.lit(""))
    again = set(FIELDS) <= set(df.columns)
    kept = lambda c, value: filled(at(c), value) if again else value
    header = first_column(df, HEADERS)
    f = header_fields(F.substring(F.lower(header), 1, 160))
    told = lambda c, bytes_say: F.when(is_hex(c, 32), c).otherwise(F.coalesce(bytes_say, F.lit("")))
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lowered = F.lower(at("classification"))
    kind = F.when((lowered == "") & F.lit(source.kind == "validated_stales"), "stale").when(lowered.isin("", "orphan"), "unknown").otherwise(lowered)
    full = at("full_coinbase_hex")
    wanted = (full != "") & ((at("coinbase_scriptsig_hex") == "") | (at("coinbase_outputs") == ""))
    rows = df.withColumn("_c", coinbase(F.when(wanted & is_hex(full), F.unhex(full))))
    outputs = F.array_join(F.transform("_c.outputs", lambda o: F.concat(o["script"], F.lit(":"), o["value"].cast("string"))), "|")
    status = at("validation_status")
    reason = filled(at("rejection_reason"), F.when(F.startswith(F.upper(status), F.lit("REJECTED")), status).otherwise(""))
    primary = kind.isin("canonical", "unknown")  # what these classes say of stale validation is no evidence
    parent = at("btc_parent_height").try_cast("bigint")
    height = F.when(kind == "stale", F.coalesce((parent + 1).cast("string"), at("btc_bip34_height"))).otherwise("")
    bundle = {"child_block_hash": child_hash(df, source), "child_header_hex": F.lower(first_column(df, ("child_header_hex",))), "child_block_time": first_column(df, ("child_block_time",)), "child_nbits": F.lower(first_column(df, ("child_nbits",)))}
    own_hash = told(F.lower(first_column(df, HASHES)), f["hash"])
    values = {
        "chain": F.lit(source.chain), "source_kind": kept("source_kind", F.lit(source.kind)), "source_path": kept("source_path", F.lit(source.path)), "source_row_number": kept("source_row_number", at(row_number)),
        "artifact_scope": kept("artifact_scope", F.lit(source.scope)), "provenance": kept("provenance", F.lit(source.provenance)), "child_height": child_height(df, source), **bundle,
        "btc_height": filled(first_column(df, HEIGHTS), height), "btc_header_hash": own_hash, "btc_prev_hash": told(F.lower(first_column(df, ("btc_prev_hash",))), f["prev_hash"]),
        "btc_time": filled(first_column(df, ("btc_time",)), number(f["time"])), "btc_bits": filled(F.lower(first_column(df, BITS)), F.coalesce(f["bits"], F.lit(""))), "btc_nonce": filled(at("btc_nonce"), number(f["nonce"])), "btc_header_hex": header,
        "coinbase_scriptsig_hex": filled(at("coinbase_scriptsig_hex"), F.coalesce("_c.script", F.lit(""))), "coinbase_outputs": filled(at("coinbase_outputs"), F.coalesce(outputs, F.lit(""))), "full_coinbase_hex": full,
        "classification": kind, "validation_status": F.when(primary, "").otherwise(status), "expected_nbits": F.when(primary, "").otherwise(at("expected_nbits")), "rejection_reason": F.when(primary, "").otherwise(reason),
    }
    errors = F.array_compact(F.array(
        F.when(~is_hex(own_hash, 32), "missing_or_malformed_btc_header_hash"),
        F.when((header != "") & f.isNull(), "malformed_btc_header_hex"),
        F.when(wanted & F.col("_c.script").isNull(), "malformed_full_coinbase_hex"),
    ))
    fault = bundle_fault(*bundle.values(), source.whole_bundle)
    return rows.select(*(values[c].alias(c) for c in FIELDS), errors.alias("errors"), fault.alias("child_fault"))


def with_companions(primary: DataFrame, canonical: DataFrame | None = None, unknown: DataFrame | None = None) -> DataFrame:
    """The rows of a chain's primary table, which all stay, and those of its companions. A canonical companion's canonical rows go where the primary table has a canonical row of
    the same (btc_height, btc_header_hash), in any case of letters. An unknown companion beside a primary table that holds unknown rows itself fails the query."""
    out = primary
    if canonical is not None:
        key = lambda df: [df["chain"].alias("_chain"), df["btc_height"].alias("_height"), F.lower(F.trim(df["btc_header_hash"])).alias("_hash")]
        seen = primary.where("classification = 'canonical'").select(*key(primary)).distinct()
        same = (F.col("chain") == F.col("_chain")) & (F.col("btc_height") == F.col("_height")) & (F.lower(F.trim("btc_header_hash")) == F.col("_hash")) & (F.col("classification") == "canonical")
        out = out.unionByName(canonical.join(seen, same, "left_anti"))
    if unknown is not None:
        mixed = primary.where("classification = 'unknown'").select(F.col("chain").alias("_chain")).distinct().withColumn("_mixed", F.lit(True))
        held = unknown.join(F.broadcast(mixed), F.col("chain") == F.col("_chain"), "left")
        checked = F.when(F.col("_mixed"), F.raise_error(F.lit("unknown rows stand in the inventory and beside it")).cast("string")).otherwise(F.col("chain"))
        out = out.unionByName(held.withColumn("chain", checked).select(unknown.columns))
    return out


def with_headers(rows: DataFrame, candidates: DataFrame, chain: str) -> DataFrame:
    """``rows`` whose missing headers of one ``chain`` are filled from ``candidates`` (hash, header_hex, ordinal of the file, place in it), with ``header_outcome``: not a target, hydrated, missing, or
    hash mismatch. Files are taken in order until every wanted hash is found; of what they hold the last row counts, and only a header that hashes to the row's hash is written."""
    wanted = (F.col("chain") == chain) & (F.col("btc_header_hex") == "") & is_hex(F.col("btc_header_hash"), 32)
    targets = rows.where(wanted).select(F.col("btc_header_hash").alias("_hash")).distinct()
    c = candidates.where(F.trim("header_hex") != "").select(F.lower(F.trim("hash")).alias("_hash"), F.trim("header_hex").alias("_header"), F.struct("ordinal", "place").alias("_at"))
    first = targets.join(c, "_hash", "left").groupBy("_hash").agg(F.min("_at.ordinal").alias("first"))
    last = first.agg(F.when(F.count_if(F.col("first").isNull()) == 0, F.max("first")).alias("_last"))  # one row
    read = c.join(targets, "_hash", "left_semi").crossJoin(F.broadcast(last)).where("_last is null or _at.ordinal <= _last")
    told = read.groupBy("_hash").agg(F.max_by("_header", "_at").alias("_header"))
    joined = rows.where(wanted).join(told, F.col("btc_header_hash") == F.col("_hash"), "left")
    good = F.coalesce(header_fields(F.substring(F.lower("_header"), 1, 160))["hash"] == F.col("btc_header_hash"), F.lit(False))
    joined = joined.withColumn("header_outcome", F.when(F.col("_header").isNull(), "missing").when(good, "hydrated").otherwise("hash mismatch"))
    joined = joined.withColumn("btc_header_hex", F.when(F.col("header_outcome") == "hydrated", F.col("_header")).otherwise(F.col("btc_header_hex"))).select(*rows.columns, "header_outcome")
    others = rows.where(~F.coalesce(wanted, F.lit(False)))  # wide rows, which a join would shuffle for nothing
    return others.withColumn("header_outcome", F.lit("not a target")).unionByName(joined)


#: Verdicts on unknown rows, the strongest first.
STRENGTH = ("strict_btc_orphan", "weak_btc_orphan")


def hydrated(rows: DataFrame, identity: DataFrame, live: tuple[str, ...]) -> DataFrame:
    """``rows`` with child hashes from ``identity`` (chain, btc_header_hash, child_height, child_block_hash, child_block_time), and the
    ``outcome`` of each. Rows that have a hash are left alone unless their chain is live; heights must agree. Of identities of one hash
    the one with the greatest ``file`` counts, where there is such a column; without one, identities that differ fail the query."""
    values = ("child_height", "child_block_hash", "child_block_time")
    one = F.struct(*(F.col(c).alias(f"_{c}") for c in values))
    if "file" in identity.columns:
        last = F.max(F.struct("file", one.alias("one")))["one"]
    else:
        last = F.when(F.min(one).eqNullSafe(F.max(one)), F.min(one)).otherwise(F.raise_error(F.lit("a child has two identities")).cast(T.StructType([T.StructField(f"_{c}", identity.schema[c].dataType) for c in values])))
    i = identity.groupBy("chain", "btc_header_hash").agg(last.alias("_last")).select("chain", "btc_header_hash", "_last.*", F.lit(True).alias("_found"))
    with_identity = identity.select("chain").distinct().withColumn("_known", F.lit(True))
    is_live = F.col("chain").isin(*live)
    target = F.coalesce((is_live | (F.coalesce("_known", F.lit(False)) & (F.col("child_block_hash") == ""))) & is_hex(F.col("btc_header_hash"), 32), F.lit(True))
    told = rows.join(F.broadcast(with_identity), "chain", "left")  # a row for each chain
    joined = told.where(target).join(i, ["chain", "btc_header_hash"], "left")
    others = told.where(~target).select(*rows.columns, F.lit("not a target").alias("outcome"))  # wide rows, which a join would shuffle for nothing
    number = lambda c: F.col(c).try_cast("bigint")
    agree = F.coalesce((number("_child_height") >= 0) & (number("child_height") == number("_child_height")), F.lit(False))
    canonical = F.col("classification") == "canonical"
    clash = (F.col("child_header_hex") != "") & ((F.col("child_block_hash") != F.lower("_child_block_hash")) | ((F.col("child_block_time") != "") & (F.col("child_block_time") != F.col("_child_block_time"))))
    outcome = (
        F.when(F.col("_found").isNull(), F.when(canonical, "canonical_unhydrated").otherwise("missing_identity"))
        .when(~agree, F.when(canonical, "canonical_unhydrated").otherwise("height_mismatch"))
        .when(clash, F.raise_error(F.lit("a child identity disagrees with the source's own bundle")).cast("string"))
        .otherwise("hydrated")
    )
    joined = joined.withColumn("outcome", outcome)
    hit = F.col("outcome") == "hydrated"
    joined = joined.withColumn("child_block_hash", F.when(hit, F.col("_child_block_hash")).otherwise(F.col("child_block_hash")))
    joined = joined.withColumn("child_block_time", F.when(hit & (F.col("child_block_time") == ""), F.col("_child_block_time")).otherwise(F.col("child_block_time")))
    return others.unionByName(joined.select(*rows.columns, "outcome"))


def admitted(rows: DataFrame, observed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows that a monitor publishes, with their ``verdict``: canonical ones; stale ones that are VALID; unknown ones that were
    observed as descendants (chain, btc_header_hash) or have a verdict (btc_header_hash, verdict). Others go. Of several verdicts on a hash the
    strongest counts; what is neither strict nor weak is none."""
    seen = observed.select("chain", "btc_header_hash", F.lit(True).alias("_seen")).distinct()
    told = verdicts.where(F.col("verdict").isin(*STRENGTH)).groupBy("btc_header_hash").agg(F.min_by("verdict", F.array_position(F.array(*map(F.lit, STRENGTH)), F.col("verdict"))).alias("_verdict"))
    joined = rows.join(seen, ["chain", "btc_header_hash"], "left").join(told, "btc_header_hash", "left")
    c, s = F.col("classification"), F.col("validation_status")
    verdict = F.when(c == "canonical", "canonical").when((c == "stale") & F.startswith(s, F.lit("VALID")), "stale").when((c == "stale_descendant") & (s == "VALID_STALE_DESCENDANT"), "stale_descendant")
    verdict = verdict.when((c == "unknown") & F.col("_seen"), "valid_stale_descendant").when(c == "unknown", F.col("_verdict"))
    out = joined.withColumn("verdict", verdict).where("verdict is not null")
    status = F.when(F.col("verdict") == "valid_stale_descendant", "VALID_STALE_DESCENDANT").otherwise(s)
    return out.withColumn("validation_status", status).select(*rows.columns, "verdict")
