"""Wrong encodings: segments, inverse mappings and whole corpora."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumaspark.llm.mojibake import inverses, mend_text, pair_model, runs, segments

PHRASES = ["Frühstück für Gäste", "Größe prüfen mit Gehör", "Garçon à la fenêtre", "Première séance voilà", "Зимний берег без монтажа", "Старая плёнка в пути", "Lição de órgão até amanhã", "Příliš dlouhý čas u řeky", "The last ferry at dusk", "夏の港 記録用"]


def brute(scores):
    """All maximal segments by their definition: best (then shortest) first, then both sides."""
    best, at = (0.0, 0), None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > 0 and (sum(scores[i:j]), i - j) > (best if at else (0.0, -99)):
                best, at = (sum(scores[i:j]), i - j), (i, j)
    if at is None:
        return []
    i, j = at
    return [*brute(scores[:i]), at, *[(a + j, b + j) for a, b in brute(scores[j:])]]


@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments(scores):
    got = segments(np.array(scores, dtype=float))
    assert sum(sum(scores[a:b]) for a, b in got) == sum(sum(scores[a:b]) for a, b in brute(scores))
    assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))


@pytest.mark.parametrize(("read", "wrote"), [("cp1252", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8")])
def test_round_trip(read, wrote):
    for phrase in ("Größe", "señal", "über"):
        bad = phrase.encode(wrote).decode(read)
        assert phrase in [new for new, _ in inverses(bad)]


def test_corpus(spark):
    rng = random.Random(3)
    texts = [f"{rng.choice(PHRASES)}, {k}" for k in range(3000)]
    damaged = {}
    for k in range(0, 3000, 50):
        bad = texts[k].encode("utf-8").decode(rng.choice(["latin-1", "mac_roman", "cp437"]))
        if bad != texts[k]:
            damaged[k] = texts[k]
            texts[k] = bad
    texts += ["caf�", "", "Café \u0081x"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(9999, None, "x")], "id int, text string, mend string")
    out = {r["id"]: r["mend"] for r in mend_text(df, "text", pair_model(df, "text")).collect()}
    found = {k for k, m in out.items() if m["damaged"]}
    assert found == set(damaged) | {3000, 3002}
    assert all(out[k]["mended"] == t for k, t in damaged.items())
    assert out[9999]["damaged"] is None and out[3001]["mended"] == ""
    assert out[3000]["mended"] == "caf�" and out[3000]["how"] is None
    model = pair_model(df, "text")
    clean = [t for k, t in enumerate(texts) if k not in found and not t.isascii()]
    assert all(runs(texts[k], model) for k in found)  # all that is found comes from improbable runs ...
    assert sum(bool(runs(t, model)) for t in clean) < 0.1 * len(clean)  # ... and few others have any


def test_empty(spark):
    df = spark.createDataFrame([], "text string")
    assert mend_text(df, "text", pair_model(df, "text")).count() == 0


def test_times(spark):
    """A text counted twice and taken off once counts once."""
    from lumaspark.llm.mojibake import count_pairs

    df = spark.createDataFrame([("Größe", 1), ("Größe", 1), ("Größe", -1), (None, 1), ("déjà", 1)], "text string, n int")
    one = spark.createDataFrame([("Größe",), ("déjà",)], "text string")
    rows = lambda df: {tuple(r) for r in df.where("n <> 0").collect()}
    assert rows(count_pairs(df, "text", "n")) == rows(count_pairs(one, "text"))
