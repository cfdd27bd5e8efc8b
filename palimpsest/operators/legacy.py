"""Old layouts of candidate rows in the shared schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexbytes import bits_text, hash_text, header_fields, whole_number

SHARED = ["btc_header_hash", "btc_prev_hash", "btc_time", "btc_bits", "child_height"]


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))


def _field(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(header_fields(F.lower(F.col("parent_header")))[name].cast("string"), F.lit(""))


#: Of each layout, where the shared columns come from: other names; bits as a decimal and the time as text; or the parent's header alone.
LAYOUTS: dict[str, dict[str, Callable[[], Column]]] = {
    "renamed": {"btc_header_hash": _col("hash"), "btc_prev_hash": _col("prev"), "btc_time": _col("time"), "btc_bits": _col("nbits"), "child_height": _col("height")},
    "decimal": {
        "btc_header_hash": lambda: F.coalesce(hash_text(F.col("parent_hash")), F.lit("")),
        "btc_prev_hash": lambda: F.coalesce(hash_text(F.col("parent_prev")), F.lit("")),
        "btc_time": lambda: F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.col("parent_time"), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("string"), F.lit("")),
        "btc_bits": lambda: F.coalesce(bits_text(F.col("parent_bits"), F.lit(True)), F.lit("")),
        "child_height": lambda: F.coalesce(whole_number(F.col("block")).cast("string"), F.lit("")),
    },
    "header": {"btc_header_hash": _field("hash"), "btc_prev_hash": _field("prev_hash"), "btc_time": _field("time"), "btc_bits": _field("bits"), "child_height": _col("child_block")},
}


def standardised(rows: DataFrame, layout: str) -> DataFrame:
    """SHARED as texts, empty where the old row has nothing that fits."""
    return rows.select(*(LAYOUTS[layout][c]().alias(c) for c in SHARED))
