"""Literal vectors for bits, Huffman codes, images and variable-size numbers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumaspark.functions import bits, tables
from lumaspark.operators import blocks as B
from lumaspark.operators import huffman as H
from lumaspark.operators import images as I
from lumaspark.plans import codes
from lumaspark.sources import ebml, jpeg


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def hx(s):
    return F.unhex(F.lit(s))


@pytest.mark.parametrize(
    ("data", "reads"),
    [
        ("00", [(1, 0)] * 8 + [(1, None)]),
        ("FF", [(1, 1)] * 8 + [(1, None)]),
        ("55", [(1, k % 2) for k in range(8)]),
        ("FF", [(0, 0), (1, 1), (2, 3), (3, 7), (4, None), (0, 0)]),
        ("55", [(3, 0b010), (3, 0b101), (2, 0b01)]),
        ("FF55", [(12, 0xFF5), (4, 5)]),
    ],
)
def test_read_bits(spark, data, reads):
    at, got, want = 0, [], []
    for n, value in reads:
        got.append(bits.read_bits(hx(data), at, n))
        want.append(value)
        at += n if value is not None else 0
    assert list(spark.range(1).select(*[g.alias(f"c{i}") for i, g in enumerate(got)]).first()) == want


def test_exp_golomb(spark):
    text, ue = "".join(f"{int(c, 16):04b}" for c in "b4728b"), []
    for _ in range(6):
        r = one(spark, bits.read_ue(F.lit(text)))
        ue.append(r["value"])
        text = text[r["used"] :]
    assert ue == [0, 2, 1, 6, 4, 10]
    assert [one(spark, bits.signed_code(F.lit(k))) for k in ue] == [0, -1, 1, -3, -2, -5]


def test_exp_golomb_long(spark, tmp_path):
    for zeros in (31, 32, 53, 62, 63):
        r = one(spark, bits.read_ue(F.lit("0" * zeros + "1" * (zeros + 1))))
        assert (r and tuple(r)) == ((2 ** (zeros + 1) - 2, 2 * zeros + 1) if zeros < 63 else None)
    assert [one(spark, bits.signed_code(F.lit(k))) for k in (2**55 + 1, 2**63 - 2, 2**63 - 1)] == [2**54 + 1, 1 - 2**62, 2**62]
    assert [one(spark, bits.bit_string(hx("80F1" * n))) for n in (0, 1, 4, 8)] == ["1000000011110001" * n for n in (0, 1, 4, 8)]
    assert one(spark, bits.bit_string(hx("00" * 8 + "FF" * 8 + "01"))) == "0" * 64 + "1" * 64 + "00000001"
    keys = [5329, 79042, 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for k in keys:
        b = f"{int(hashlib.md5(str(k).encode()).hexdigest(), 16):0128b}"
        z = b.index("1")
        want[k] = (int(b[z : 2 * z + 1], 2) - 1, 2 * z + 1)
    assert want[5329][1] == 37
    assert {r["o_orderkey"]: (r["value"], r["used"]) for r in codes.exp_golomb_ue(spark, str(tmp_path)).collect()} == want
    assert {r["o_orderkey"]: r["value"] for r in codes.exp_golomb_se(spark, str(tmp_path)).collect()} == {k: (v + 1) // 2 if v % 2 else -(v // 2) for k, (v, _) in want.items()}


@pytest.mark.parametrize(
    ("codes", "want"),
    [([("11", 0), ("011", 0), ("010", 0)], "DA"), ([(c, 0) for c in ("011", "11", "010", "010", "011", "11")], "7A4F"), ([("11", 0), ("011", 0)], "D8"), ([(c, 0) for c in ("011", "11", "010", "11", "011")], "7AD8"), ([], "")],
)
def test_pack_bits(spark, codes, want):
    arr = F.array(*[F.struct(F.lit(int(c, 2)).alias("code"), F.lit(len(c)).alias("size")) for c, _ in codes]) if codes else F.array().cast("array<struct<code:int,size:int>>")
    assert one(spark, F.hex(bits.pack_bits(arr))) == want


def test_hello():
    codes = {"H": (0, 2), "e": (1, 2), "l": (2, 2), "o": (6, 3)}
    table = {ord(k): v for k, v in codes.items()}
    assert H.encode(b"Hello", table).hex() == "1ac0"
    assert H.decode(bytes.fromhex("1ac0"), 5, tuple((s, c, n) for s, (c, n) in table.items())) == b"Hello"
    with pytest.raises(EOFError):
        H.decode(bytes.fromhex("1ac0"), 9, tuple((s, c, n) for s, (c, n) in table.items()))
    with pytest.raises(ValueError, match="code"):
        H.decode(b"\xff", 1, tuple((s, c, n) for s, (c, n) in table.items()))


def test_huffman_round_trip(spark):
    counts = [0, 1, 3, 2, 3, 4, 6, 4, 9, 7, 8, 7, 5, 9, 1, 0]
    symbols = list(range(69))
    df = spark.createDataFrame([("t", counts, symbols)], "name string, counts array<int>, symbols array<int>")
    back = H.counts_of(H.codes_of(df, "name"), "name").first()
    assert back["counts"] == counts and back["symbols"] == symbols
    got = {(r["symbol"], r["code"], r["size"]) for r in H.codes_of(df, "name").collect()}
    assert got == set(tables.canonical(counts, symbols))


def test_default_tables():
    assert [len(t[1]) for t in tables.HUFFMAN.values()] == [12, 12, 162, 162]
    assert all(sum(c) == len(s) == len(set(s)) for c, s in tables.HUFFMAN.values())
    luma = {s: (c, n) for s, c, n in tables.canonical(*tables.DC_LUMA)}
    assert luma[11] == (0b111111110, 9) and luma[0] == (0, 2)
    assert tables.zigzag()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


@pytest.mark.parametrize(("data", "want"), [("82", (1, 2, 0x82)), ("4002", (2, 2, 0x4002)), ("200002", (3, 2, 0x200002)), ("10000002", (4, 2, 0x10000002)), ("0100000000000002", (8, 2, 0x0100000000000002)), ("ff", (1, 0x7F, 0xFF)), ("7fff", (2, 0x3FFF, 0x7FFF)), ("3fffff", (3, 0x1FFFFF, 0x3FFFFF)), ("1fffffff", (4, 0xFFFFFFF, 0x1FFFFFFF))])
def test_vint(spark, data, want):
    assert tuple(one(spark, bits.vint(hx(data)))) == want
    assert ebml.vint(bytes.fromhex(data), 0) == want


@pytest.mark.parametrize("data", ["", "00", "00000000"])
def test_bad_vint(spark, data):
    assert one(spark, bits.vint(hx(data))) is None
    with pytest.raises((EOFError, ValueError)):
        ebml.vint(bytes.fromhex(data), 0)


def test_numbers(spark):
    assert one(spark, bits.be_uint64(hx("FFFFFFFFFFFFFFFF")).cast("string")) == "18446744073709551615"
    assert one(spark, bits.be_int64(hx("FF"))) == -1 and one(spark, bits.be_int64(hx("FFFFFFFFFFFFFFFE"))) == -2
    assert one(spark, bits.be_int64(hx("7F"))) == 127 and one(spark, bits.be_int64(hx(""))) == 0
    assert one(spark, bits.le_uint(hx("0102"), 0, 2)) == 0x0201 and one(spark, bits.le_uint(hx("01"), 0, 2)) is None


def test_images(spark):
    mono, w, h = F.array(*[F.lit(i) for i in range(1, 10)]), F.lit(3), F.lit(3)
    assert [one(spark, I.pixel_at(mono, w, h, 1, F.lit(x), F.lit(y))) for y in range(3) for x in range(3)] == [[i] for i in range(1, 10)]
    assert one(spark, I.pixel_at(mono, w, h, 1, F.lit(0), F.lit(3))) is None
    assert [one(spark, I.row_at(mono, w, h, 1, F.lit(y))) for y in range(4)] == [[1, 2, 3], [4, 5, 6], [7, 8, 9], None]
    rgb = F.array(*[F.lit(i) for i in range(1, 13)])
    p = one(spark, I.planes(rgb))
    assert (p["r"], p["g"], p["b"]) == ([1, 4, 7, 10], [2, 5, 8, 11], [3, 6, 9, 12])
    assert one(spark, I.interleaved(*[F.array(*[F.lit(v) for v in p[c]]) for c in "rgb"])) == list(range(1, 13))
    edited = I.with_pixel(rgb, F.lit(2), F.lit(2), 3, F.lit(1), F.lit(0), F.array(F.lit(4), F.lit(5), F.lit(26)))
    assert one(spark, edited) == [1, 2, 3, 4, 5, 26, 7, 8, 9, 10, 11, 12]
    assert one(spark, I.shape_ok(rgb, F.lit(2), F.lit(2), F.lit(3))) and not one(spark, I.shape_ok(rgb, F.lit(2), F.lit(2), F.lit(1)))


def _grid(df, c="v"):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["y"], {})[r["x"]] = r[c]
    return [[row[x] for x in sorted(row)] for _, row in sorted(rows.items())]


def test_scaling(spark):
    small = spark.createDataFrame([(x, y, 1 + x + 2 * y) for y in range(2) for x in range(2)], "x int, y int, v int")
    assert _grid(I.upscale(small, 2, 2)) == [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    big = spark.createDataFrame([(x, y, (8 * y + x) % 10) for y in range(8) for x in range(8)], "x int, y int, v int")
    assert _grid(I.downscale(big, 2, 2, F.lit(8), F.lit(8))) == [[0, 2, 4, 6], [6, 8, 0, 2], [2, 4, 6, 8], [8, 0, 2, 4]]
    view = I.crop(spark.createDataFrame([(x, y, 1 + x + 3 * y) for y in range(3) for x in range(3)], "x int, y int, v int"), 1, 1, 2, 2)
    assert _grid(view) == [[5, 6], [8, 9]]
    assert I.crop(big, 7, 7, 2, 2, F.lit(8), F.lit(8)).count() == 0


def test_unstuffing():
    b = jpeg.Bits(bytes.fromhex("1aff00c0"))
    assert [b.read(4), b.read(8), b.read(8), b.read(4)] == [1, 0xAF, 0xFC, 0]
    b = jpeg.Bits(bytes.fromhex("01ff00030405"))
    assert b.read(40) == 0x01FF030405


# The one block of coefficients whose inverse the formulations must agree on, by row.
BENCH = [[-370, -33, 18, -10], [220, -72, -48, -12, -24], [80, 184, -20, -28], [-76, 5, 21, 0, 15], [15, 7, 0, -17], [-7, 11, 34], [0, -19], []]


def test_inverse_transforms_agree(spark):
    flat = [v for row in BENCH for v in row + [0] * (8 - len(row))]
    df = spark.createDataFrame([(1, flat), (2, None)], "id int, coef array<int>")
    rows = df.where("id = 1").select("id", F.posexplode("coef").alias("k", "coef"))
    two = {r["id"]: r["px"] for r in df.select("id", B.idct_two_pass(F.col("coef")).alias("px")).collect()}
    assert two[2] is None
    for other in (B.idct_naive, B.idct_precomputed):
        assert [r["px"] for r in other(rows, "id").orderBy("i").collect()] == two[1]


def test_transform_inverts(spark):
    px = [(37 * i * i + 11 * i) % 256 for i in range(64)]
    df = spark.createDataFrame([(px,)], "px array<int>")
    back = df.select(B.idct_two_pass(B.fdct(F.col("px"))).alias("b")).first()["b"]
    assert max(abs(a - b) for a, b in zip(px, back)) <= 1


def test_runs(spark):
    level = [9] + [0] * 20 + [5, -3] + [0] * 40 + [0]
    r = spark.createDataFrame([(level,), ([1] + [0] * 62 + [2],), ([1] + [0] * 63,), ([1] * 64,)], "l array<int>").select(B.ac_runs(F.col("l")).alias("r")).collect()
    assert [tuple(x) for x in r[0]["r"]] == [(16, 15, 0), (21, 4, 5), (22, 0, -3), (64, 0, 0)]
    assert [tuple(x) for x in r[1]["r"]] == [(16, 15, 0), (32, 15, 0), (48, 15, 0), (63, 14, 2)]
    assert [tuple(x) for x in r[2]["r"]] == [(64, 0, 0)]
    assert len(r[3]["r"]) == 63
