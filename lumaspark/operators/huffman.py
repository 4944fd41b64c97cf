"""Huffman tables and codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables


def codes_of(counts: DataFrame, key: str) -> DataFrame:
    """(key, symbol, code, size) from rows (key, counts ARRAY, symbols ARRAY): codes of a length
    follow each other, so a code is the sum of 2^-size over the symbols before it."""
    sizes = F.flatten(F.transform("counts", lambda n, i: F.array_repeat(i + 1, n)))
    rows = counts.select(key, F.posexplode(F.arrays_zip(F.col("symbols").alias("symbol"), sizes.alias("size"))).alias("n", "z")).select(key, "n", "z.symbol", "z.size")
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(16) - F.col("size"))).over(before), F.lit(0))
    return rows.withColumn("code", F.call_function("shiftright", used, F.lit(16) - F.col("size")).cast("int")).select(key, "symbol", "code", "size")


def counts_of(codes: DataFrame, key: str) -> DataFrame:
    """(key, counts ARRAY of 16, symbols ARRAY) from rows (key, symbol, code, size)."""
    per = codes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("size", "code", "symbol"))).alias("c"))
    count = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda s: F.size(F.filter("c", lambda x: x["size"] == s)))
    return per.select(key, count.alias("counts"), F.col("c.symbol").alias("symbols"))


#: A complete-prefix table for bytes: 128 codes of 8 bits, then 128 of 9.
BYTE_COUNTS = [0] * 7 + [128, 128] + [0] * 7


def byte_table() -> list[tuple[int, int, int]]:
    return tables.canonical(BYTE_COUNTS, list(range(256)))


def encode(data: bytes, table: dict[int, tuple[int, int]]) -> bytes:
    """Codes of all bytes, the last byte filled up with zeros."""
    codes = {s: format(c, f"0{n}b") for s, (c, n) in table.items()}
    text = "".join([codes[b] for b in data])
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def decode(data: bytes, n: int, codes: tuple[tuple[int, int, int], ...]) -> bytes:
    """The first ``n`` symbols; a code that the table doesn't have is an error."""
    symbols, sizes = tables.lookup(codes)
    out, held, have, at = bytearray(n), 0, 0, 0
    padded = data + b"\0\0"
    for k in range(n):
        while have < 16 and at < len(padded):
            held = (held << 8 | padded[at]) & 0xFFFFFFFF
            have, at = have + 8, at + 1
        window = (held >> (have - 16) if have >= 16 else held << (16 - have)) & 0xFFFF
        size = sizes[window]
        if not size:
            raise ValueError("invalid code")
        have -= size
        if at * 8 - have > 8 * len(data):
            raise EOFError
        out[k] = symbols[window]
    return bytes(out)


def encode_column(data: Column) -> Column:
    """Bytes encoded with the byte table; null gives null."""
    codes = {s: (c, n) for s, c, n in byte_table()}
    return F.pandas_udf(lambda s: pd.Series([None if b is None else encode(bytes(b), codes) for b in s], dtype="object"), "binary")(data)


def decode_column(data: Column, n: Column) -> Column:
    """``n`` bytes decoded with the byte table; null gives null."""
    codes = tuple(byte_table())
    return F.pandas_udf(lambda s, k: pd.Series([None if b is None else decode(bytes(b), int(m), codes) for b, m in zip(s, k)], dtype="object"), "binary")(data, n)
