"""Fixed-width encodings of integer and decimal tokens, and their inverses.

A token is encodable only if decoding gives back the very same characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit layouts (fixed values): sign | digits | digit count - 1 | digits after the point - 1
DECIMAL64 = {"max_digits": 16, "field_bits": 4, "sign": -(1 << 63), "digit_limit": None}
DECIMAL32 = {"max_digits": 8, "field_bits": 3, "sign": -(1 << 31), "digit_limit": 1 << 25}


_INT64 = (-(1 << 63), (1 << 63) - 1)
_INT32 = (-(1 << 31), (1 << 31) - 1)


def _canonical(token: Column, digits: int) -> Column:
    """No plus sign, no zero padding, no "-0", and at most ``digits`` digits."""
    return token.rlike(rf"\A(?:0|-?[1-9][0-9]{{0,{digits - 1}}})\z")


# Only text that is sure to be in range is cast: a failing cast raises and
# catches an exception per value, which costs far more than all the rest.


def encode_int64(token: Column) -> Column:
    """64-bit value of a canonical integer token, else NULL."""
    wide = token.cast("decimal(20,0)")
    value = F.when(F.length(token) <= 18, token.cast("bigint")).when(wide.between(*_INT64), wide.cast("bigint"))
    return F.when(_canonical(token, 19), value)


def encode_int32(token: Column) -> Column:
    """32-bit value (held in a BIGINT) of a canonical integer token, else NULL."""
    value = token.cast("bigint")
    return F.when(_canonical(token, 10), F.when(value.between(*_INT32), value))


def _pack_decimal(token: Column, layout: dict) -> Column:
    """Packed form of a token that is known to fit the layout."""
    bits = layout["field_bits"]
    digits = F.translate(token, "-.", "")
    after_point = F.length(token) - F.instr(token, ".")
    packed = (
        F.shiftleft(digits.cast("bigint"), 2 * bits)
        .bitwiseOR(F.shiftleft((F.length(digits) - 1).cast("bigint"), bits))
        .bitwiseOR((after_point - 1).cast("bigint"))
    )
    return F.when(token.startswith("-"), packed.bitwiseOR(F.lit(layout["sign"]).cast("bigint"))).otherwise(packed)


def pack_decimal64(token: Column) -> Column:
    return _pack_decimal(token, DECIMAL64)


def pack_decimal32(token: Column) -> Column:
    return _pack_decimal(token, DECIMAL32)


def _encode_decimal(token: Column, layout: dict) -> Column:
    most, limit = layout["max_digits"], layout["digit_limit"]
    digits = F.translate(token, "-.", "")
    amount = digits.cast("bigint")
    signed = _pack_decimal(token, layout)
    # The length test comes first: it is cheap and keeps the cast below in range.
    fits = (
        token.contains(".")
        & (F.length(token) <= most + 2)
        & token.rlike(r"\A-?[0-9]*\.[0-9]+\z")
        & (F.length(digits) <= most)
    )
    value = F.when(fits, signed)
    return value if limit is None else F.when(fits, F.when(amount < limit, signed))


def encode_decimal64(token: Column) -> Column:
    """Packed 64-bit form of a decimal token with at most 16 digits, else NULL."""
    return _encode_decimal(token, DECIMAL64)


def encode_decimal32(token: Column) -> Column:
    """Packed 32-bit form (held in a BIGINT) of a decimal token, else NULL."""
    return _encode_decimal(token, DECIMAL32)


def _decode_decimal(packed: Column, layout: dict) -> Column:
    bits = layout["field_bits"]
    mask = (1 << bits) - 1
    negative = packed < 0
    body = packed.bitwiseAND(F.lit(-layout["sign"] - 1).cast("bigint"))
    count = (F.shiftright(body, bits).bitwiseAND(F.lit(mask).cast("bigint")) + 1).cast("int")
    after_point = (body.bitwiseAND(F.lit(mask).cast("bigint")) + 1).cast("int")
    digits = F.lpad(F.shiftright(body, 2 * bits).cast("string"), count, F.lit("0"))
    return F.concat(
        F.when(negative, "-").otherwise(""),
        F.substr(digits, F.lit(1), count - after_point),
        F.lit("."),
        F.substr(digits, count - after_point + 1, after_point),
    )


def decode_int(value: Column) -> Column:
    """Text of an integer variable."""
    return value.cast("string")


def decode_decimal64(packed: Column) -> Column:
    """Text of a 64-bit packed decimal."""
    return _decode_decimal(packed, DECIMAL64)


def decode_decimal32(packed: Column) -> Column:
    """Text of a 32-bit packed decimal."""
    return _decode_decimal(packed, DECIMAL32)
