"""Canonical lists: metric, tree, mapping and the sharded form."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumaspark.llm.canonical import BKTree, Mapper, edit_distance, map_values, map_values_sharded

MAKES = [(1, "Velmora"), (2, "Hoshikata Koki"), (3, "Drei Linsen"), (4, "Ардовит"), (5, "Tamberley & Hask"), (6, "Splicer's Friend")]
MODELS = [(10, "VX-20"), (11, "VX-200"), (12, "VX-20 II"), (13, "Duchess"), (14, "Duchess Mini"), (15, "Kite 400"), (16, "Kite 410"), (17, "Drumline"), (18, "Dreiklang")]
words = st.text("abc", max_size=6)


@given(words, words, words)
def test_metric(a, b, c):
    assert edit_distance(a, b) == edit_distance(b, a)
    assert (edit_distance(a, b) == 0) == (a == b)
    assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)


@given(st.lists(words, min_size=1, max_size=30), words, st.integers(0, 3))
def test_tree_is_exhaustive(keys, query, reach):
    want = sorted((edit_distance(query, k), k) for k in set(keys) if edit_distance(query, k) <= reach)
    assert BKTree(keys).within(query, reach) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("velmora", 1), ("Vemora", 1), ("HoshikataKoki CO.,LTD.", 2), ("Hos.", 2), ("Drei Lin.", 3), ("Drei Lim.", 3), ("DreiLinsenCompany", 3), ("VelmoraVX20", 1), ("ARDOVIT", 4), ("Tamberley & H.", 5), ("Velmora VX-200", 1), ("Bagol Electronics", None), ("libsplicer'sfrieend-2.2", 6), ("--", None)],
)
def test_makes(text, want):
    hit = Mapper(MAKES, [t for _, t in MODELS]).find(text)
    assert (hit and hit[0]) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("vx 20", 10), ("VX200", 11), ("VX_20 II", 12), ("VX-21", None), ("Duchess Min.", 14), ("Duc.", 13), ("Dr.", None), ("Kite 41O", None), ("Velmora-VX-20", 10), ("Drumlinekit", 17), ("Velmora Duc.", 13), ("VelmoraVX20", 10)],
)
def test_models(text, want):
    hit = Mapper(MODELS, [t for _, t in MAKES]).find(text)
    assert (hit and hit[0]) == want


def test_columns(spark):
    rows = [("Make", "velmora", 1), ("Make", None, 2), (None, "velmora", 3), ("Make", "", 4), ("Make", "zzz", 5), ("Other", "velmora", 6), ("Make", "velmora", 1), ("Make", "x" * 50_000, 7)]
    df = spark.createDataFrame(rows, "field_name string, text string, ref_id int")
    refs = spark.createDataFrame([("Make", i, t) for i, t in MAKES], "field_name string, ref_id long, entry_name string")
    for run in (map_values, lambda *a: map_values_sharded(*a, per_shard=2)):
        out = {(r["ref_id"], r["match"] and r["match"]["ref_id"]) for r in run(df, F.col("field_name"), F.col("text"), refs).collect()}
        assert out == {(1, 1), (2, None), (3, None), (4, 0), (5, 0), (6, None), (7, 0)}
        assert run(df, F.col("field_name"), F.col("text"), refs).count() == len(rows)
        assert run(df.limit(0), F.col("field_name"), F.col("text"), refs).count() == 0


TEXTS = ["velmora", "Vemora", "Hos.", "Drei Lim.", "DreiLinsenCompany", "VelmoraVX20", "VX20Velmora", "Velmora Duc.", "Velmora Dr.", "Dr.", "Dru.", "Duc.", "Duchess Min.", "Duches Mini", "Duchess", "vx 20", "v x 2 0 0", "VX_20 II", "VX-21", "Kite 41O", "Kite 400", "Kit 410 Kite 400", "Drumlinekit", "Dreiklan", "Splicer Fr.", "libsplicer'sfrieend-2.2", "ARDOVIT", "Bagol Electronics", "--", ""]


@pytest.mark.parametrize("shards", [1, 2, 3, 9])
@pytest.mark.parametrize(("own", "others"), [(MAKES, MODELS), (MODELS, MAKES)])
def test_shards_settle_as_one(own, others, shards):
    own = [*own, (own[0][0] + 90, own[0][1]), (own[1][0], own[1][1] + " Mark")]  # a name with two ids, an id with two names
    names = [t for _, t in others]
    whole = Mapper(own, names)
    parts = [Mapper([e for e in own if e[0] % shards == k], names=Mapper.names_of([t for _, t in own], names)) for k in range(shards)]
    words = sorted({w for t in TEXTS for w in t.split()})
    for text in TEXTS + [f"{a} {b}" for a in words for b in words] + [a + b for a in words for b in words]:
        assert Mapper.settle([c for p in parts for c in p.candidates(text)]) == whole.find(text), text


def test_sharded_columns_are_the_same(spark):
    df = spark.createDataFrame([(f, t) for f in ("Make", "Model") for t in TEXTS], "field_name string, text string")
    refs = spark.createDataFrame([("Make", i, t) for i, t in MAKES] + [("Model", i, t) for i, t in MODELS], "field_name string, ref_id long, entry_name string")
    runs = [lambda: map_values(df, F.col("field_name"), F.col("text"), refs), lambda: map_values_sharded(df, F.col("field_name"), F.col("text"), refs, per_shard=2)]
    one, other = [{(r["field_name"], r["text"]): r["match"] for r in run().collect()} for run in runs]
    assert one == other
    assert [other["Model", t]["ref_id"] for t in ("VelmoraVX20", "Velmora Duc.", "Dr.")] == [10, 13, 0]


def test_tree_only(spark):
    """The tree alone finds what is within reach, and leaves shortened and joined names."""
    mapper = Mapper(MODELS, [t for _, t in MAKES], tree_only=True)
    assert [(mapper.find(t) or (0,))[0] for t in ("vx 20", "Velmora VX-200", "Duches Mini", "Duc.", "VelmoraVX20", "Drumlinekit", "zzz")] == [10, 11, 14, 0, 0, 0, 0]
    df = spark.createDataFrame([(f, t) for f in ("Make", "Model") for t in TEXTS], "field_name string, text string")
    refs = spark.createDataFrame([("Make", i, t) for i, t in MAKES] + [("Model", i, t) for i, t in MODELS], "field_name string, ref_id long, entry_name string")
    one, other = [{(r["field_name"], r["text"]): r["match"] for r in map_values(df, F.col("field_name"), F.col("text"), refs, broadcast_entries=n, tree_only=True).collect()} for n in (100, 4)]
    assert one == other
    held = {(f, t): Mapper(own, tree_only=True).find(t) for f, own in (("Make", MAKES), ("Model", MODELS)) for t in TEXTS}
    assert {k: (v["ref_id"], v["distance"]) for k, v in one.items()} == {k: (v[0], v[1]) if v else (0, None) for k, v in held.items()}
