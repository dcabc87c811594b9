"""Bloom filters as literals of a plan, built and probed in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits held in a byte of the literal, which keeps the bytes ASCII, so that one of them can be read as a number.
_BYTE = 7


def positions(key: Column, salt: int, bits: int, hashes: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(key, F.lit(salt), F.lit(k)), 1) % bits for k in range(hashes)]


def build(keys: DataFrame, salt: int, bits: int, hashes: int) -> bytes:
    """The literal of a filter over the one column of keys. What reaches the driver is a row for each byte at most."""
    at = keys.select(F.explode(F.array(*positions(F.col(keys.columns[0]), salt, bits, hashes))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1), (F.col("p") % _BYTE).cast("int"))
    out = bytearray(bits // _BYTE + 1)
    for place, value in at.groupBy(F.expr(f"p div {_BYTE}").alias("b")).agg(F.bit_or(bit).alias("v")).toLocalIterator():
        out[place] = value
    return bytes(out)


def holds(held: bytes, key: Column, salt: int, bits: int, hashes: int) -> Column:
    """True for every key of the filter and for few others."""
    ok = F.lit(True)
    for p in positions(key, salt, bits, hashes):
        byte = F.ascii(F.substring(F.lit(held), (F.floor(p / _BYTE) + 1).cast("int"), F.lit(1)).cast("string"))
        ok = ok & (F.call_function("shiftright", byte, (p % _BYTE).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return ok


def size_for(n: int, bits_per_key: int = 12, most: int = 1 << 24) -> int:
    return min(most, max(64, 1 << (bits_per_key * n - 1).bit_length()))


def prefilter(keys: DataFrame, most: int = 1 << 24) -> Callable[[Column], Column]:
    """A test that is true for every value of keys' one column. It goes before a join, so that rows which cannot match
    are not shuffled. Its size is bounded (2.4 MB): with very many keys it lets more through, and the join stays exact."""
    n = keys.count()
    if not n:
        return lambda key: F.lit(False)
    bits = size_for(n, most=most)
    held = build(keys, 0, bits, 3)
    return lambda key: holds(held, key, 0, bits, 3)
