"""Column functions over strings and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r" \t\n\x0B\f\r"


def normalise(token: Column) -> Column:
    """Without outer C white space, A-Z lower-cased; other letters stay."""
    bare = F.btrim(token, F.lit(" \t\n\x0b\f\r"))
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_bytes(text: Column) -> Column:
    """The bytes of a string as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    digit = lambda c: F.instr(F.lit("0123456789ABCDEF"), c) - 1
    return F.transform(pairs, lambda x: (digit(F.substring(x, 1, 1)) * 16 + digit(F.substring(x, 2, 1))).cast("long"))


def fnv1a64_hex(text: Column) -> Column:
    """64-bit FNV-1a as lower-case hexadecimal without leading zeros.

    The product by 2^40 + 435 is made of 32-bit halves, so no step overflows under ANSI rules.
    """
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        y = h.bitwiseXOR(b)
        low = y.bitwiseAND(mask) * 435
        carried = F.shiftrightunsigned(y, 32) * 435 + F.shiftrightunsigned(low, 32)
        high = (carried + F.shiftleft(y.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(mask)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))

    return F.lower(F.hex(F.aggregate(utf8_bytes(text), F.lit(-3750763034362895579), step)))


def dedup_key(token: Column, context: Column) -> Column:
    return fnv1a64_hex(F.concat(token, F.lit("|"), context))


def fix_checksum(message: Column) -> Column:
    """Sum of the bytes modulo 256, as three digits."""
    zero = F.lit(0).cast("long")
    plain = F.aggregate(F.split(message, ""), zero, lambda a, c: a + F.ascii(c))  # of ASCII alone characters are bytes
    total = F.when(F.length(message) == F.octet_length(message), plain).otherwise(F.aggregate(utf8_bytes(message), zero, lambda a, b: a + b))
    return F.lpad((total % 256).cast("string"), 3, "0")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def saturation(x: Column, capacity: Column) -> Column:
    """x / capacity in [0, 1]; 0 where there is no capacity."""
    return F.when(capacity > 0, clamp01(x / F.nullif(capacity, F.lit(0)))).otherwise(F.lit(0.0))


def json_number(body: Column, key: str) -> Column:
    return F.get_json_object(body, f"$.{key}").try_cast("double")


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HH:mm:ss")


def words(text: Column) -> Column:
    """The words between C white space, in order."""
    return F.filter(F.split(text, rf"[{_SPACE}]+"), lambda w: w != "")
