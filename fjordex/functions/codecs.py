"""Integer codecs: variable-byte and Elias gamma, as Column expressions and plain functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_vbyte_encode(n: int) -> bytes:
    """Seven bits a byte, most significant first; the high bit marks the last byte."""
    if n < 0:
        raise ValueError("negative numbers can't be encoded")
    groups = [n & 127 | 128]
    while n := n >> 7:
        groups.append(n & 127)
    return bytes(reversed(groups))


def py_vbyte_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, bytes read) from a position."""
    n = 0
    for k, b in enumerate(data[at:], 1):
        n = n << 7 | b & 127
        if b & 128:
            return n, k
    raise ValueError("the last byte is missing")


def vbyte_size(n: Column) -> Column:
    """Bytes of the variable-byte code of a non-negative number; null for null and negative."""
    size = F.when(n < 0, None)
    for k in range(1, 9):
        size = size.when(n < F.lit(1 << 7 * k), k)
    return size.otherwise(F.when(n.isNotNull(), 9))


def vbyte_encode(n: Column) -> Column:
    """Variable-byte code as binary; null for null and negative."""
    size = vbyte_size(n)
    # base-128 digits, most significant first
    digits = F.transform(F.sequence(F.lit(1), size), lambda i: _digit(n, size, i))
    return F.unhex(F.array_join(F.transform(digits, lambda d: F.lpad(F.hex(d), 2, "0")), ""))


def _digit(n: Column, size: Column, i: Column) -> Column:
    power = F.element_at(F.array(*(F.lit(1 << 7 * k).cast("long") for k in range(9))), (size - i + 1).cast("int"))
    return F.call_function("div", n.cast("long"), power) % 128 + F.when(i == size, 128).otherwise(0)


def vbyte_decode(data: Column) -> Column:
    """The first number of a variable-byte code; null for null or empty binary."""
    h = F.hex(data)
    values = F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, b: Column) -> Column:
        n = F.when(acc["done"], acc["n"]).otherwise(acc["n"] * 128 + b % 128)
        return F.struct(n.alias("n"), (acc["done"] | (b >= 128)).alias("done"))

    return F.when(F.length(data) > 0, F.aggregate(values, zero, step, lambda acc: acc["n"]))


def gamma_encode(n: Column) -> Column:
    """Elias gamma code as a bit string: the length in unary, then the offset; null below 1."""
    b = F.bin(n)
    return F.when(n > 0, F.concat(F.repeat(F.lit("1"), F.length(b) - 1), F.lit("0"), F.substr(b, F.lit(2))))


def gamma_decode(bits: Column) -> Column:
    """The number of one Elias gamma code; null for null."""
    unary = F.instr(bits, "0")
    return F.conv(F.concat(F.lit("1"), F.substr(bits, unary + 1)), 2, 10).cast("long")
