"""Functions that SQL text can call, by name: the analyzer puts their bodies in place of the calls, so nothing leaves the JVM and pushdown sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_REVERSED = r"regexp_replace(reverse({}), '(.)(.)', '$2$1')"
_NUMBER = "CAST(conv({}, 16, 10) AS BIGINT)"

#: name and parameters, type, body.
FUNCTIONS = (
    ("reversed_hex(digits STRING)", "STRING", _REVERSED.format("digits")),
    ("double_hash(digits STRING)", "STRING", "sha2(unhex(sha2(unhex(digits), 256)), 256)"),
    ("header_hash(header STRING)", "STRING", "reversed_hex(double_hash(substring(header, 1, 160)))"),
    ("header_time(header STRING)", "BIGINT", _NUMBER.format("reversed_hex(substring(header, 137, 8))")),
    ("header_bits(header STRING)", "STRING", "reversed_hex(substring(header, 145, 8))"),
    ("header_parent(header STRING)", "STRING", "reversed_hex(substring(header, 9, 64))"),
    (
        "compact_target(bits STRING)",
        "STRING",
        f"""CASE WHEN bits NOT RLIKE '^[0-9a-fA-F]{{8}}$' OR {_NUMBER.format("substring(bits, 3, 6)")} >= 8388608 THEN NULL
        WHEN {_NUMBER.format("substring(bits, 1, 2)")} <= 3 THEN lpad(lower(substring(bits, 3, 2 * CAST({_NUMBER.format("substring(bits, 1, 2)")} AS INT))), 64, '0')
        WHEN length(ltrim('0', concat(substring(bits, 3, 6), repeat('00', CAST({_NUMBER.format("substring(bits, 1, 2)")} AS INT) - 3)))) > 64 THEN repeat('f', 64)
        ELSE lpad(lower(ltrim('0', concat(substring(bits, 3, 6), repeat('00', CAST({_NUMBER.format("substring(bits, 1, 2)")} AS INT) - 3)))), 64, '0') END""",
    ),
    ("meets_target(hash STRING, bits STRING)", "BOOLEAN", "coalesce(hash <= compact_target(bits) AND compact_target(bits) > repeat('0', 64), false)"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions of this module known to the session; they are temporary, and again is no harm."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
