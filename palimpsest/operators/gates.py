"""Consensus gates with three outcomes: null (passes), a text that starts with REJECTED, or one that starts with UNKNOWN.

Missing context is UNKNOWN and never becomes a rejection. Each gate is one Column; a chain of gates is a coalesce.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexbytes import big_endian, is_hex, meets, push_prefix, pushed_height, signed32, target, turned, whole_number
from ..functions.registry import HEIGHT_PUSH, HEIGHT_PUSH_V2, INTERVAL, VERSION_3, VERSION_4

RETARGET, MTP = "nbits_retarget_not_applied", "time_below_mtp"
PLACEMENT = "REJECTED: predecessor is not the active-chain block before this height"


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def bits_gate(height: Column, bits: Column, expected: Column) -> Column:
    """VALID, REJECTED or UNKNOWN by the main chain's bits at the height."""
    return (
        F.when(height.isNull(), "UNKNOWN: missing height")
        .when(expected.isNull(), "UNKNOWN: canonical bits unavailable")
        .when(bits == expected, "VALID")
        .otherwise(_text("REJECTED: bits mismatch (got ", F.coalesce(bits, F.lit("")), ", expected ", expected, ")"))
    )


def _version_of(header: Column) -> Column:
    """The version alone: the struct of all fields would hash the header wherever a gate names it."""
    return F.when(is_hex(header, 80), signed32(big_endian(turned(F.substring(header, 1, 8)))))


def required_version(height: Column) -> Column:
    return F.when(height >= VERSION_4, 4).when(height >= VERSION_3, 3).when(height >= HEIGHT_PUSH, 2)


@dataclass(frozen=True)
class Evidence:
    """What gates ask of a row: its height, the header's version, the declared height (``told`` if there is a text, ``number`` if it is one), and of the script
    whether it is missing, whole bytes, how many, the height that it pushes and whether it starts with the exact push of its own."""

    height: Column
    version: Column
    told: Column
    number: Column
    missing: Column
    whole: Column
    size: Column
    decoded: Column
    pushes: Column


def evidence(height: Column, header: Column, declared: Column, script: Column) -> Evidence:
    return Evidence(
        height=height,
        version=_version_of(header),
        told=F.coalesce(F.trim(declared), F.lit("")) != "",
        number=whole_number(declared),
        missing=F.coalesce(script, F.lit("")) == "",
        whole=is_hex(script),
        size=F.floor(F.length(script) / 2),
        decoded=pushed_height(script),
        pushes=F.startswith(F.lower(script), push_prefix(height)),
    )


def bound(rows: DataFrame, height: Column, header: Column, declared: Column, script: Column) -> tuple[DataFrame, Evidence]:
    """``rows`` with the evidence as columns of their own, and the evidence that names them: gates that name a field many times would else repeat how it is
    found, until a stage's code is too large to compile. ``unbound`` takes the columns off."""
    found = evidence(height, header, declared, script).__dict__
    return rows.withColumns({f"_evidence_{k}": v for k, v in found.items()}), Evidence(**{k: F.col(f"_evidence_{k}") for k in found})


def unbound(rows: DataFrame) -> DataFrame:
    return rows.drop(*(f"_evidence_{k}" for k in Evidence.__dataclass_fields__))


def version_gate(height: Column, header: Column) -> Column:
    return _version_gate(height, _version_of(header))


def _version_gate(height: Column, version: Column) -> Column:
    required = required_version(height)
    return F.when(
        required.isNotNull(),
        F.when(version.isNull(), "UNKNOWN: malformed header").when(version < required, _text("REJECTED: version ", version, " below ", required)),
    )


def time_gate(time: Column, parent_mtp: Column) -> Column:
    """Skipped (null) where no parent time is given."""
    u32 = lambda x: x.between(0, 0xFFFFFFFF)
    verdict = F.when(~u32(parent_mtp), "UNKNOWN: parent median time unavailable").when(time.isNull() | ~u32(time), "UNKNOWN: malformed time").when(time <= parent_mtp, _text("REJECTED: time ", time, " not above ", parent_mtp))
    return F.when(parent_mtp.isNotNull(), verdict)


def length_gate(script: Column) -> Column:
    """Two to one hundred bytes; an empty script is missing evidence."""
    return _length_gate(F.coalesce(script, F.lit("")) == "", is_hex(script), F.floor(F.length(script) / 2))


def _length_gate(missing: Column, whole: Column, size: Column) -> Column:
    return F.when(missing, "UNKNOWN: missing script").when(~whole, "UNKNOWN: malformed script").when(~size.between(2, 100), _text("REJECTED: script length ", size))


def height_gate(height: Column, header: Column, declared: Column, script: Column) -> Column:
    """The height push, in the order of its two activation heights."""
    return push_gate(evidence(height, header, declared, script))


def push_gate(e: Evidence) -> Column:
    """As ``height_gate``, of evidence that is bound."""
    bad_header = F.when(e.version.isNull(), "UNKNOWN: malformed header")
    late = e.height >= HEIGHT_PUSH
    verdict = (
        F.when(e.told & (e.number.isNull() | (e.number < 0)), "REJECTED: malformed declared height")
        .when(e.missing, F.coalesce(F.when(~late, bad_header), F.lit("REJECTED: missing script for height")))
        .when(~e.whole, F.coalesce(F.when(~late, bad_header), F.lit("REJECTED: malformed script")))
        .when(
            ~e.pushes,
            F.coalesce(bad_header, F.when(e.decoded.isNull(), F.lit("REJECTED: missing height push")), _text("REJECTED: height push mismatch (got ", e.decoded, ", expected ", e.height, ")")),
        )
        .when(e.told & e.decoded.isNotNull() & (e.number != e.decoded), _text("REJECTED: declared height ", e.number, " disagrees with push ", e.decoded))
    )
    return (
        F.when(e.height < HEIGHT_PUSH_V2, F.lit(None).cast("string"))
        .when(late & e.version.isNull(), bad_header)
        .when(late & (e.version < 2), _text("REJECTED: version ", e.version, " below 2"))
        .when(~late & (e.version < 2), F.lit(None).cast("string"))
        .otherwise(verdict)
    )


def first_failure(e: Evidence, time: Column, parent_mtp: Column) -> Column:
    return F.coalesce(time_gate(time, parent_mtp), _version_gate(e.height, e.version), _length_gate(e.missing, e.whole, e.size), push_gate(e))


def retarget_gate(height: Column, bits: Column, expected: Column, previous: Column) -> Column:
    """Whether a header at an interval's start kept the bits of the interval before; null off such starts or without both."""
    return F.when(height % INTERVAL == 0, (bits != expected) & (bits == previous))


def violations(e: Evidence, time: Column, parent_mtp: Column, retarget: Column) -> Column:
    """All rules that the evidence proves broken, in the order of precedence. Unusable evidence proves nothing, and what is declared counts for nothing."""
    height = e.height
    version_error = _version_gate(height, e.version)
    early = height < HEIGHT_PUSH
    name = lambda kind: F.when(early, f"bip34_v2_coinbase_height_{kind}").otherwise(f"bip34_coinbase_height_{kind}")
    version_rule = F.when(height >= VERSION_4, "bip65_block_version_below_4").when(height >= VERSION_3, "bip66_block_version_below_3").otherwise("bip34_block_version_below_2")
    length_rule = F.when(e.whole & (e.size > 100), "coinbase_scriptsig_length_above_100").when(e.whole & ~e.missing & (e.size < 2), "coinbase_scriptsig_length_below_2")
    # a push is judged from its activation on, where the version allows it; then it is missing or another height's
    judged = (height >= HEIGHT_PUSH_V2) & (e.version >= 2) & version_error.isNull() & e.whole & ~e.missing & ~e.pushes
    push_rule = F.when(judged, F.when(e.decoded.isNull(), name("missing")).otherwise(name("mismatch")))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(retarget, F.lit(False)), RETARGET),
            F.when(time_gate(time, parent_mtp).startswith("REJECTED"), MTP),
            F.when(version_error.startswith("REJECTED"), version_rule),
            length_rule,
            push_rule,
        )
    )


def placement_gate(prev: Column, parent_height: Column, parent_confirmations: Column, height: Column) -> Column:
    """Placement on the main chain: the parent must be known, active, and one below."""
    return (
        F.when(F.coalesce(prev, F.lit("")) == "", "UNKNOWN: missing predecessor")
        .when(parent_height.isNull() | (parent_confirmations <= 0), PLACEMENT)
        .when(parent_height + 1 != height, "UNKNOWN: parent height disagrees")
    )


def routed(status: Column, rules: Column, bits: Column, expected: Column, hash_display: Column) -> Column:
    """Where a rejected row goes: unknown, error_block, or unchanged (null)."""
    contaminated = F.when(status.startswith("REJECTED: bits mismatch"), True).when(F.coalesce(bits, F.lit("")).isin("") | F.coalesce(expected, F.lit("")).isin(""), F.lit(None)).otherwise(bits != expected)
    excused = F.array_contains(rules, RETARGET) & meets(hash_display, target(expected))
    return F.when(status == PLACEMENT, "unknown").when(contaminated.isNull(), F.lit(None).cast("string")).when(contaminated & ~F.coalesce(excused, F.lit(False)), "unknown").when(F.size(rules) > 0, "error_block")
