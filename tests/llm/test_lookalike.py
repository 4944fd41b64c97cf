"""Look-alike characters: the transducer and the column function."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumaspark.llm.lookalike import Transducer, _put, consistent

ENTRIES = ["KATOMEX", "Ардовит", "Зимник 5М", "AT-60", "Brünau Werke", "Vista™ 10", "Quadra²"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ＴＩＴＬＥ", "TITLE"),
        ("ТIТLЕ", "TITLE"),  # mixed scripts in one word
        ("ТІТО", "ТІТО"),  # one script, and no entry looks like it
        ("КАТОМЕХ", "KATOMEX"),  # one script, and an entry looks like it
        ("Зимник 5M", "Зимник 5М"),
        ("Brünau Werke", "Brünau Werke"),
        ("Vel‌mo­ra", "Velmora"),
        ("Orinta X‑ 1", "Orinta X- 1"),
        ("HK‑1100 Ⅱ", "HK-1100 II"),
        ("Vista™ 10", "Vista™ 10"),
        ("Quadra²", "Quadra²"),
        ("Αrdοvit Со", "Ardovit Co"),
        ("plain  text ", "plain  text "),
        ("", ""),
    ],
)
def test_convert(text, want):
    assert Transducer(ENTRIES).convert(text) == want


@given(st.text(max_size=60))
def test_idempotent(text):
    t = Transducer(ENTRIES)
    once = t.convert(text)
    assert t.convert(once) == once


def test_conflict():
    t = Transducer()
    with pytest.raises(ValueError, match="conflict"):
        _put(t.plain, " ", "x")


def test_column(spark):
    long = "Ａ" * 200_000
    rows = [(1, None, "k"), (2, "", "k"), (3, "Ｘ", "k"), (3, "Ｘ", "k"), (4, long, "k")]
    df = spark.createDataFrame(rows, "id int, text string, consistent string")
    out = sorted(((r["id"], r["consistent"]) for r in consistent(df, "text", ENTRIES).collect()), key=str)
    assert out == sorted([(1, None), (2, ""), (3, "X"), (3, "X"), (4, "A" * 200_000)], key=str)
    assert consistent(df.limit(0), "text").count() == 0


PROBES = [
    ("Ni\u200ekon", "Nikon"), ("Nikon\ufe0f", "Nikon"), ("Ni\u034fkon", "Nikon"), ("a\u2800b", "a b"), ("a\u3000b", "a b"),
    ("\U0001d40d\U0001d422kon", "Nikon"), ("\u24c3ikon", "Nikon"), ("\ufb01lm", "film"), ("\u13a0isk", "Disk"), ("\u03f2anon", "canon"), ("N\u03b9kon", "Nikon"),
    ("C\u03b1non", "Canon"), ("\u03baodak", "kodak"), ("\u212aodak", "Kodak"), ("x\U000e0041y", "xy"), ("caf\u0065\u0301", "caf\u00e9"),
    ("vi\u00ea\u0323t", "vi\u1ec7t"), ("vie\u0302\u0323t", "vi\u1ec7t"), ("vie\u0323\u0302t", "vi\u1ec7t"), ("o\u0327\u0301x", "\u00f3\u0327x"),
    ("\u1112\u1161\u11ab\u1100\u116e\u11a8", "\ud55c\uad6d"), ("\uff76\uff9e", "\u30ac"), ("\u09c7\u09be", "\u09cb"), ("x\u0316\u0301", "x\u0316\u0301"), ("x\u0301\u0316", "x\u0316\u0301"),
]


@pytest.mark.parametrize(("text", "want"), PROBES)
def test_probes(text, want):
    assert Transducer().convert(text) == want
    assert Transducer().convert(want) == want


@given(st.text(st.characters(min_codepoint=0xA0, max_codepoint=0x1FFF, categories=["Lu", "Ll", "Mn", "Mc", "Lo"]), max_size=6))
def test_composes_as_unicode_does(text):
    """Clusters of letters and marks that the other tables leave alone come out as NFC gives them."""
    t = Transducer()
    whole = unicodedata.normalize("NFD", text)
    if not any(c in t.plain for c in whole + text + unicodedata.normalize("NFC", text)):
        assert "".join(t._clusters(whole)) == unicodedata.normalize("NFC", text)
