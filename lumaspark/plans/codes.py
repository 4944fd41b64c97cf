"""Queries of the bit, byte and Huffman operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, tables
from ..operators import blocks as B
from ..operators import huffman as H
from ..session import spread, table
from .pixels import _LEVEL, levels


def _text_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, b): sixteen bytes per order, the digest of its key."""
    return table(spark, d, "orders").select("o_orderkey", F.unhex(F.md5(F.col("o_orderkey").cast("string"))).alias("b"))


def bit_read(spark: SparkSession, d: str) -> DataFrame:
    """Each text read as fields of 12 bits: how many, their sum and their exclusive or."""
    n = F.floor(F.length("b") * 8 / 12).cast("int")
    rows = _text_bytes(spark, d).where("length(b) > 2").select("doc_id", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    f = rows.select("doc_id", bits.read_bits(F.col("b"), F.col("i") * 12, 12).alias("v"))
    return f.groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.sum("v").alias("total"), F.bit_xor("v").alias("parity"))


def bit_read_lsb(spark: SparkSession, d: str) -> DataFrame:
    """Fields of 5 bits at bit 3, least significant bit first, as deflate reads them."""
    v = F.call_function("shiftright", bits.le_uint(F.col("b"), 0, 2), F.lit(3))
    return _keys(spark, d).select("o_orderkey", v.bitwiseAND(F.lit(31)).alias("v"))


def exp_golomb_ue(spark: SparkSession, d: str) -> DataFrame:
    """The unsigned Exp-Golomb code that the digest of each key begins with."""
    b = _keys(spark, d).select("o_orderkey", bits.read_ue(bits.bit_string(F.col("b"))).alias("c"))
    return b.select("o_orderkey", "c.value", "c.used")


def exp_golomb_se(spark: SparkSession, d: str) -> DataFrame:
    """The same as a signed number."""
    return exp_golomb_ue(spark, d).select("o_orderkey", bits.signed_code(F.col("value")).alias("value"))


def bit_write(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each customer packed as codes of 1 to 7 bits."""
    size = (F.col("o_orderkey") % 7 + 1).cast("int")
    code = F.col("o_orderkey") % F.call_function("shiftleft", F.lit(1).cast("long"), size)
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", code.alias("code"), size.alias("size")))).alias("codes"))
    return per.select("o_custkey", F.hex(bits.pack_bits(F.col("codes"))).alias("packed"))


def vint_decode(spark: SparkSession, d: str) -> DataFrame:
    """The variable-size number that the digest of each key begins with."""
    return _keys(spark, d).select("o_orderkey", bits.vint(F.substring("b", 1, 8)).alias("v")).select("o_orderkey", "v.length", "v.value", F.hex("v.raw").alias("raw"))


def be_uint_decode(spark: SparkSession, d: str) -> DataFrame:
    """Big-endian numbers of 0 to 8 bytes, unsigned and signed."""
    part = F.expr("substring(b, 1, int(o_orderkey % 9))")
    return _keys(spark, d).select("o_orderkey", bits.be_uint64(part).cast("string").alias("u"), bits.be_int64(part).alias("s"), bits.be_uint(F.col("b"), 3, 2).alias("u16"))


def be_float_decode(spark: SparkSession, d: str) -> DataFrame:
    """Prices written as 8-byte floats and read back by the element reader."""
    import struct

    from ..sources.ebml import value_of

    pack = F.pandas_udf(lambda s: pd.Series([struct.pack(">d", x) for x in s], dtype="object"), "binary")
    read = F.pandas_udf(lambda s: pd.Series([value_of("Float", bytes(x))["v_float"] for x in s], dtype="float64"), "double")
    return table(spark, d, "orders").select("o_orderkey", read(pack("o_totalprice")).alias("price"))


def _default_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c, s) for n, (c, s) in tables.HUFFMAN.items()], "name string, counts array<int>, symbols array<int>")


def huffman_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the four default tables from their counts."""
    return H.codes_of(_default_tables(spark), "name")


def huffman_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts and symbols of the four default tables from their codes."""
    c = H.counts_of(tables.huffman_df(spark), "name")
    return c.select("name", F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"), F.array_join(F.col("symbols").cast("array<string>"), " ").alias("symbols"))


def huffman_encode_len(spark: SparkSession, d: str) -> DataFrame:
    """Bits of each text in the byte table: bytes joined with their codes."""
    dim = F.broadcast(spark.createDataFrame(H.byte_table(), "symbol int, code int, size int"))
    b = _text_bytes(spark, d).where("length(b) > 0").select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("b") - 1), lambda i: bits.be_uint(F.col("b"), i, 1).cast("int"))).alias("symbol"))
    return b.join(dim, "symbol").groupBy("doc_id").agg(F.sum("size").alias("n_bits"))


def huffman_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts encoded and decoded again."""
    t = spread(_text_bytes(spark, d)).where("b is not null").withColumn("e", H.encode_column(F.col("b")))
    return t.select("doc_id", F.length("b").alias("n_bytes"), (H.decode_column(F.col("e"), F.length("b")) == F.col("b")).alias("same"))


def ac_entropy_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bits of each block's AC levels in the default luma table: runs joined with their codes."""
    dim = F.broadcast(tables.huffman_df(spark).where("name = 'ac_luma'").select("symbol", F.col("size").alias("code_size")))
    runs = levels(spark, d).select("block_id", F.explode(B.ac_runs(F.col("level"))).alias("e")).select("block_id", "e.*")
    size = bits.magnitude_size(F.col("value"))
    coded = runs.withColumn("size", size).withColumn("symbol", F.col("run") * 16 + F.col("size"))
    return coded.join(dim, "symbol").groupBy("block_id").agg(F.sum(F.col("code_size") + F.col("size")).alias("n_bits"))


QUERIES = {
    f.__name__: f
    for f in (bit_read, bit_read_lsb, exp_golomb_ue, exp_golomb_se, bit_write, vint_decode, be_uint_decode, be_float_decode, huffman_canonical, huffman_counts, huffman_encode_len, huffman_roundtrip, ac_entropy_bits)
}

_MD5 = "k as (select o_orderkey, o_custkey, md5(o_orderkey::varchar) as h from orders)"
_UE = f"{_MD5}, b as (select o_orderkey, {" || ".join(f"lpad(bin(('0x' || substr(h, {at}, 8))::bigint), 32, '0')" for at in (1, 9, 17, 25))} as s from k), z as (select o_orderkey, s, instr(s, '1') - 1 as z from b), ue as (select o_orderkey, case when z >= 0 and z < 63 then list_sum(list_transform(range(z + 1), lambda i: substr(s, z + 1 + i, 1)::bigint << (z - i))) - 1 end::bigint as value, case when z >= 0 and z < 63 then 2 * z + 1 end::int as used from z)"
_BYTES = "b as (select doc_id, from_hex(x) as b, x, length(x) // 2 as n from (select doc_id, hex(encode(text)) as x from documents where text is not null))"


def _values() -> str:
    rows = [f"('{n}', {i}, {s}, {size})" for n, (c, symbols) in tables.HUFFMAN.items() for i, (s, size) in enumerate(zip(symbols, [k + 1 for k, m in enumerate(c) for _ in range(m)]))]
    return f"v(name, n, symbol, size) as (values {', '.join(rows)})"


_CODES = f"{_values()}, codes as (select name, cast(symbol as int) as symbol, cast(coalesce(sum(1::bigint << (16 - size)) over (partition by name order by n rows between unbounded preceding and 1 preceding), 0)::bigint >> (16 - size) as int) as code, cast(size as int) as size from v)"
_SIZE = "case when value = 0 then 0 else length(bin(abs(value))) end"
SQL = {
    "bit_read": f"with {_BYTES}, f as (select doc_id, i, case when i % 2 = 0 then ('0x' || substr(x, 3 * i + 1, 3))::int else ('0x' || substr(x, 3 * i + 1, 3))::int end as v from (select doc_id, x, unnest(range(n * 2 // 3)) as i from b where n > 2)) select doc_id, count(*) as n_fields, cast(sum(v) as bigint) as total, cast(bit_xor(v) as bigint) as parity from f group by doc_id",
    "bit_read_lsb": f"with {_MD5} select o_orderkey, ((('0x' || substr(h, 3, 2) || substr(h, 1, 2))::bigint) >> 3) & 31 as v from k",
    "exp_golomb_ue": f"with {_UE} select o_orderkey, value, used from ue",
    "exp_golomb_se": f"with {_UE} select o_orderkey, case when value % 2 = 0 then -(value // 2) else (value + 1) // 2 end as value from ue",
    "bit_write": "with c as (select o_custkey, string_agg(lpad(bin(o_orderkey % (1 << (o_orderkey % 7 + 1)::int)), (o_orderkey % 7 + 1)::int, '0'), '' order by o_orderkey) as s from orders group by 1), p as (select o_custkey, rpad(s, ((length(s) + 7) // 8 * 8)::int, '0') as s from c) select o_custkey, array_to_string(list_transform(range(length(s) // 8), lambda i: printf('%02X', list_sum(list_transform(range(8), lambda j: substr(s, i * 8 + j + 1, 1)::bigint << (7 - j)))::bigint)), '') as packed from p",
    "vint_decode": f"with {_MD5}, l as (select o_orderkey, h, 9 - length(bin(('0x' || substr(h, 1, 2))::int)) as n from k where substr(h, 1, 2) <> '00') select k.o_orderkey, n::int as length, ('0x' || substr(l.h, 1, 2 * n))::bigint & ((1::bigint << (7 * n)) - 1) as value, regexp_replace(upper(substr(l.h, 1, 2 * n)), '^0+', '') as raw from k left join l using (o_orderkey)",
    "be_uint_decode": f"with {_MD5}, p as (select o_orderkey, h, (o_orderkey % 9)::int as n, case when o_orderkey % 9 = 0 then 0 else ('0x' || substr(h, 1, 2 * (o_orderkey % 9)::int))::uhugeint end::hugeint as u from k) select o_orderkey, u::varchar as u, case when n > 0 and ('0x' || substr(h, 1, 2))::int >= 128 then u - (1::hugeint << (8 * n)) else u end::bigint as s, ('0x' || substr(h, 7, 4))::bigint as u16 from p",
    "be_float_decode": "select o_orderkey, o_totalprice as price from orders",
    "huffman_canonical": f"with {_CODES} select name, symbol, code, size from codes",
    "huffman_counts": f"with {_CODES}, s as (select name, string_agg(symbol::varchar, ' ' order by size, code) as symbols from codes group by 1), n as (select name, string_agg(n::varchar, ' ' order by size) as counts from (select t.name, l.size, count(c.symbol) as n from (select distinct name from v) t cross join (select unnest(range(1, 17)) as size) l left join codes c on c.name = t.name and c.size = l.size group by 1, 2) group by 1) select name, counts, symbols from s join n using (name)",
    "huffman_encode_len": f"with {_BYTES} select doc_id, cast(sum(case when ('0x' || substr(x, 2 * i + 1, 2))::int < 128 then 8 else 9 end) as bigint) as n_bits from (select doc_id, x, unnest(range(n)) as i from b) group by doc_id",
    "huffman_roundtrip": f"with {_BYTES} select doc_id, n::int as n_bytes, true as same from b",
    "ac_entropy_bits": f"with {_LEVEL}, {_CODES}, nz as (select block_id, k, level as value, k - coalesce(lag(k) over (partition by block_id order by k), 0) - 1 as run from level where k > 0 and level <> 0 and quality = 75), ac as (select symbol, size from codes where name = 'ac_luma'), e as (select block_id, {_SIZE} as bits, (run % 16) * 16 + {_SIZE} as symbol, run // 16 as zrl from nz), last as (select block_id, max(k) as k from nz group by 1), blocks as (select distinct block_id from level) select block_id, cast(sum(n) as bigint) as n_bits from (select block_id, bits + size + zrl * (select size from ac where symbol = 240) as n from e join ac using (symbol) union all select b.block_id, (select size from ac where symbol = 0) from blocks b left join last l using (block_id) where coalesce(l.k, 0) < 63) group by block_id",
}
