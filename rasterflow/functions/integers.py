"""Integer expressions over pixels and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp255(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(255))


def floor_div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("bigint")


def le_uint(content: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes at ``offset`` (from 0) of a binary column; null past its end."""
    h = F.hex(F.substring(content, offset + 1, size))
    turned = F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.when(F.octet_length(content) >= offset + size, F.conv(turned, 16, 10).cast("bigint"))


def be_uint(content: Column, offset: int, size: int) -> Column:
    """As le_uint, big-endian."""
    return F.when(F.octet_length(content) >= offset + size, F.conv(F.hex(F.substring(content, offset + 1, size)), 16, 10).cast("bigint"))


def le32(n: Column) -> Column:
    """Four little-endian bytes of an integer, as binary."""
    h = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, 7 - 2 * i, 2) for i in range(4))))
