"""Column functions that every cost formula uses. All are built-in expressions.

Whole numbers are BIGINT; ``zigzag`` takes values within 62 bits, beyond which
ANSI arithmetic raises instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bit_width(x: Column | str) -> Column:
    """Bits of a non-negative number, 0 for 0; never by a logarithm."""
    x = _col(x)
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.cast("bigint")))).cast("bigint")


def uvar_len(x: Column | str) -> Column:
    """Bytes of the LEB128 form of a non-negative number."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor((bit_width(x) + 6) / 7))


def zigzag(x: Column | str) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    x = _col(x).cast("bigint")
    return F.when(x >= 0, x * 2).otherwise(x * -2 - 1)


def unzigzag(x: Column | str) -> Column:
    x = _col(x).cast("bigint")
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))


def packed_size(n: Column | str, width: Column | str) -> Column:
    """Bytes of ``n`` values of ``width`` bits each, packed."""
    return F.floor((_col(n).cast("bigint") * _col(width) + 7) / 8)


def signed_ring(x: Column | str, bytes_wide: int) -> Column:
    """A number modulo 2^(8 w), as the signed number of least size; w is 4 at most."""
    if not 1 <= bytes_wide <= 4:
        raise ValueError("rings of 1 to 4 bytes fit a BIGINT")
    size = 1 << 8 * bytes_wide
    m = F.pmod(_col(x).cast("bigint"), F.lit(size))
    return F.when(m >= size // 2, m - size).otherwise(m)


def canonical_int(token: Column | str) -> Column:
    """The number of a token that is its plain decimal form, else null: no plus, leading zero or -0."""
    token = _col(token)
    return F.when(token.rlike(r"^(0|-?[1-9][0-9]*)\z"), token.try_cast("bigint"))


def framed_size(n_bytes: Column | str) -> Column:
    """Bytes of a value with its length before it."""
    return uvar_len(n_bytes) + _col(n_bytes)


def leaf_object_size(n: Column | str, payload: Column | str) -> Column:
    """Bytes of a leaf with its id, count and payload length."""
    return F.lit(1) + uvar_len(n) + uvar_len(payload) + _col(payload)


def doubling_class(length: Column | str, step: int = 4, classes: int = 14) -> Column:
    """Length class by doubling, the last open."""
    return F.least(F.lit(classes - 1), F.length(F.bin(F.floor(_col(length) / step).cast("bigint"))) - 1)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part, whole)


def percent_change(new: Column, old: Column) -> Column:
    return F.try_divide((new - old) * 100.0, old)


def byte_symbols(text: Column | str) -> Column:
    """The text's UTF-8 bytes as an array of two-digit hex symbols."""
    return F.regexp_extract_all(F.hex(F.encode(_col(text), "UTF-8")), F.lit("(..)"), 1)


def url_allowed(url: Column | str) -> Column:
    """https, a host, no credentials, no fragment."""
    url = _col(url)
    return F.coalesce(url.rlike(r"^https://[^/@#?\s]+([/?][^#\s]*)?\z"), F.lit(False))


def exact_fixed_point(value: Column | str, scale: int = 1000, digits: int = 3) -> Column:
    """A decimal text as a whole number of 1/scale; null unless it is exact."""
    value = _col(value)
    exact = value.try_cast(f"decimal(28,{digits + 6})")  # narrow enough to compare without loss
    whole = exact.cast(f"decimal(28,{digits})")
    return F.when(exact == whole, (whole * scale).cast("bigint"))
