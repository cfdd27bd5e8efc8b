"""Difficulty of the next block: targets of 256 bits multiplied and divided in limbs, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hexbytes import target

#: A limb is seven hex digits: its product with 31 bits, and a remainder of 31 bits before it, fit a signed 64-bit number.
LIMB, DIGITS, LIMBS = 28, 7, 11


def scaled(target_hex: Column, by: Column, over: Column | int) -> Column:
    """target * by // over, of a target of up to 64 hex digits and two numbers from 1 up to 31 bits, as 77 hex digits. The products of limbs
    are carried upward, then divided from the highest down, as one does on paper. The arguments are found once for a row, not at each limb."""
    big = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    told = F.struct(F.lpad(target_hex, LIMB * LIMBS // 4, "0").alias("wide"), big(by).alias("by"), big(over).alias("over"))
    return once(told, lambda v: _scaled(v["wide"], v["by"], v["over"]))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is found once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def _scaled(wide: Column, by: Column, over: Column) -> Column:
    big = lambda x: F.lit(x).cast("bigint")
    limbs = F.array(*(F.conv(F.substring(wide, 1 + DIGITS * i, DIGITS), 16, 10).cast("bigint") for i in range(LIMBS - 1, -1, -1)))  # lowest first
    full = F.lit((1 << LIMB) - 1).cast("bigint")
    start = F.struct(big(0).alias("carry"), F.array().cast("array<bigint>").alias("limbs"))

    def multiply(a: Column, x: Column) -> Column:
        whole = x * by + a["carry"]
        return F.struct(F.shiftright(whole, LIMB).alias("carry"), F.concat(F.array(whole.bitwiseAND(full)), a["limbs"]).alias("limbs"))

    def divide(a: Column, x: Column) -> Column:
        whole = a["rest"] * (1 << LIMB) + x
        quotient = F.lpad(F.lower(F.hex(F.call_function("div", whole, over))), DIGITS, "0")
        return F.struct((whole % over).alias("rest"), F.concat(a["digits"], quotient).alias("digits"))

    product = F.aggregate(limbs, start, multiply, lambda a: a["limbs"])
    return F.aggregate(product, F.struct(big(0).alias("rest"), F.lit("").alias("digits")), divide, lambda a: a["digits"])


def compact_bits(target_hex: Column) -> Column:
    """A target's compact form, with a mantissa whose sign bit is clear; digits beyond the first three bytes are lost."""
    size = lambda digits: F.floor((F.length(digits) + 1) / 2).cast("int")
    head = lambda digits: F.rpad(F.substring(F.lpad(digits, 2 * size(digits), F.lit("0")), 1, 6), 6, "0")
    byte = lambda n: F.lpad(F.lower(F.hex(n)), 2, "0")
    form = lambda v: F.when(v["head"] >= "8", F.concat(byte(v["size"] + 1), F.lit("00"), F.substring(v["head"], 1, 4))).otherwise(F.concat(byte(v["size"]), v["head"]))
    return once(once(F.ltrim(F.lower(target_hex), F.lit("0")), lambda d: F.struct(size(d).alias("size"), head(d).alias("head"))), form)


@dataclass(frozen=True)
class Era:
    """Below the height ``until`` (None: without end), every ``every``-th block changes the target by the time that the ``back`` blocks before it
    took, held between ``low`` and ``high``, over ``divisor``."""

    until: int | None
    every: int
    back: int
    low: int
    high: int
    divisor: int


# A merge-mined chain's rules, the heights at which its bits are set, and its largest target.
ERAS = (Era(48_950, 2016, 2016, 302_400, 4_838_400, 1_209_600), Era(71_700, 10, 10, 5_917, 6_084, 6_000), Era(None, 1, 2, 37, 39, 38))
SET_BITS = {48_950: "1908cf19", 71_700: "185c7bae", 260_500: "2000ffff"}
LIMIT = "00" + "ff" * 31


def next_bits(height: Column, bits: Column, time: Column, first_times: dict[int, Column], eras: tuple[Era, ...] = ERAS, set_bits: dict[int, str] = SET_BITS, limit: str = LIMIT) -> Column:
    """The bits that a block at ``height`` must have, from the ``bits`` and ``time`` of the block before it and, by eras' ``back``, the time of the block so many places before it. Null
    where one that counts is null, or the target before is malformed, zero, or above the limit."""
    before = target(bits)
    usable = (before > "0" * 64) & (before <= limit)

    def of(era: Era) -> Column:
        span = F.greatest(F.lit(era.low), F.least(F.lit(era.high), time - first_times[era.back]))
        new = F.substring(scaled(before, span, era.divisor), -64, 64)  # at most eight times a target that the limit bounds fits 64 digits
        return F.when(height % era.every != 0, bits).when(span.isNotNull() & (time - first_times[era.back]).isNotNull() & usable, compact_bits(F.least(new, F.lit(limit))))

    out = F.lit(None).cast("string")
    for era in reversed(eras):
        out = of(era) if era.until is None else F.when(height < era.until, of(era)).otherwise(out)
    for at, told in set_bits.items():
        out = F.when(height == at, told).otherwise(out)
    return F.when(height > 0, out)
