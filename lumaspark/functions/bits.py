"""Bit and byte fields of BINARY columns as column expressions (positions count from 0).

Reading past the end gives null; a read of no bits gives 0. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def be_uint(data: Column, at: Column | int = 0, size: int = 1) -> Column:
    """Unsigned big-endian number of up to 7 bytes as BIGINT; no bytes give 0."""
    if size == 0:
        return F.lit(0).cast("long")
    at = _col(at)
    return F.when(at + size <= F.length(data), F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long"))


def be_uint64(data: Column) -> Column:
    """Unsigned big-endian number of 0 to 8 bytes as DECIMAL(20,0); longer data give null."""
    return F.when(F.length(data) == 0, F.lit(0).cast("decimal(20,0)")).when(F.length(data) <= 8, F.conv(F.hex(data), 16, 10).cast("decimal(20,0)"))


def be_int64(data: Column) -> Column:
    """Signed big-endian number of 0 to 8 bytes as BIGINT, extended from its first bit."""
    half = F.lit(2).cast("decimal(20,0)")
    unsigned = be_uint64(data)
    span = F.pow(half, 8 * F.length(data)).cast("decimal(20,0)")
    low = F.when(F.length(data) == 8, F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(span)
    negative = (F.length(data) > 0) & (be_uint(data, 0, 1) >= 128)
    return F.when(negative, (unsigned.cast("decimal(38,0)") - low).cast("long")).otherwise(unsigned.cast("long"))


def le_uint(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned little-endian number of up to 7 bytes as BIGINT."""
    at = _col(at)
    parts = F.concat(*[F.hex(F.substring(data, at + 1 + k, F.lit(1))) for k in reversed(range(size))])
    return F.when(at + size <= F.length(data), F.conv(parts, 16, 10).cast("long"))


def read_bits(data: Column, at: Column | int, n: Column | int) -> Column:
    """``n`` bits (0 to 32) from bit ``at``, most significant first, as BIGINT."""
    at, n = _col(at).cast("long"), _col(n).cast("long")
    first = F.floor(at / 8).cast("int")
    window = F.conv(F.rpad(F.hex(F.substring(data, first + 1, F.lit(5))), 10, "0"), 16, 10).cast("long")
    shift = (F.lit(40) - at % 8 - n).cast("int")
    value = F.call_function("shiftright", window, shift).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1)
    return F.when(n == 0, F.lit(0).cast("long")).when(at + n <= 8 * F.length(data), value)


def bit_string(data: Column) -> Column:
    """The bits of (short) data as text of 0 and 1."""
    eight = lambda i: F.lpad(F.conv(F.hex(F.substring(data, i, F.lit(8))), 16, 2), F.least(F.lit(8), F.length(data) - i + 1) * 8, F.lit("0"))
    return F.when(F.length(data) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(data), F.lit(8)), eight), ""))


def read_ue(bits: Column) -> Column:
    """Unsigned Exp-Golomb code that a bit text begins with, as struct(value, used bits).

    Null where the text ends within the code, or after 63 zeros or more: its value may not fit a BIGINT.
    """
    zeros = F.instr(bits, "1") - 1
    used = 2 * zeros + 1
    value = F.conv(F.substring(bits, zeros + 1, zeros + 1), 2, 10).cast("long") - 1
    return F.when((zeros >= 0) & (zeros < 63) & (used <= F.length(bits)), F.struct(value.alias("value"), used.alias("used")))


def signed_code(k: Column) -> Column:
    """Signed number of an Exp-Golomb code number: 0, 1, -1, 2, -2, ..."""
    half = F.call_function("shiftright", k.cast("long"), F.lit(1))
    return F.when(k % 2 == 0, -half).otherwise(half + 1)


def pack_bits(codes: Column) -> Column:
    """Bytes of an array of struct(code, size), most significant first, last byte filled with 0."""
    text = F.array_join(F.transform(codes, lambda c: F.lpad(F.conv(c["code"].cast("string"), 10, 2), c["size"].cast("int"), "0")), "")
    full = F.rpad(text, (F.ceil(F.length(text) / 8) * 8).cast("int"), "0")
    byte = lambda i: F.lpad(F.conv(F.substring(full, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")
    count = (F.length(full) / 8).cast("int")
    return F.when(F.length(text) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), byte), "")))


def vint(data: Column) -> Column:
    """EBML variable-size number at the start of data as struct(length, value, raw), else null.

    The leading zeros of the first byte give the length; a first byte of 0 or missing bytes are an
    error (null). ``raw`` keeps the marker bit, ``value`` doesn't.
    """
    first = be_uint(data, 0, 1)
    length = F.lit(9) - F.length(F.bin(first))
    raw = F.conv(F.hex(F.substring(data, F.lit(1), length)), 16, 10).cast("long")
    value = raw.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 7 * length) - 1)
    return F.when((first > 0) & (F.length(data) >= length), F.struct(length.cast("int").alias("length"), value.alias("value"), raw.alias("raw")))


def magnitude_size(v: Column) -> Column:
    """Bits of the absolute value: the size class of a coefficient."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(v.cast("long"))))).cast("int")


def magnitude_code(v: Column) -> Column:
    """The low bits that stand for a coefficient within its size class."""
    size = magnitude_size(v)
    return (v.cast("long") - (v < 0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1).cast("int")


def receive_extend(code: Column, size: Column) -> Column:
    """The coefficient that ``code`` stands for in size class ``size``."""
    half = F.call_function("shiftleft", F.lit(1).cast("long"), size - 1)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size)
    return F.when(size == 0, F.lit(0)).when(code < half, code - (full - 1)).otherwise(code).cast("int")
