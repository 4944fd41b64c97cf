"""Mixing sources: shares, caps and order against a plain calculation."""

import random
from collections import Counter

import pytest

from lumaspark.llm.mixing import mix, plan, position, ranks_of, report, tokenizer, with_tokens


def test_plan():
    steps = {s["source"]: s for s in plan({"a": 100, "b": 50, "c": 0}, [("a", 0.5, 1), ("b", 0.4, 4), ("c", 0.1, 9), ("d", 0.0, 1), (None, 0.2, 1)])}
    assert set(steps) == {"a", "b"}
    assert steps["a"]["want"] == pytest.approx(100, abs=1) and steps["b"]["want"] == pytest.approx(80, abs=1)
    assert sum(s["share"] * s["lean"] for s in steps.values()) == pytest.approx(0)
    assert plan({}, [("a", 1.0, 1)]) == []


def _fixture(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["big"] * 8 + ["small", None, "other"]), "w " * rng.randint(1, 40)) for k in range(3000)]
    rows += [(5000, "big", None), (5001, "big", ""), rows[0], (None, "big", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    return with_tokens(docs), targets


def test_mix(spark):
    counted, targets = _fixture(spark)
    counted = counted.cache()
    enc = tokenizer(ranks_of("/opt/tokenizers/byte_bpe_50k.tiktoken"))
    assert counted.count() == 3002
    assert {r["n_tokens"] for r in counted.where("doc_id in (5000, 5001)").collect()} == {0}
    got = mix(counted, targets, in_bucket=100).collect()
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    assert tokens["big"] / total == pytest.approx(0.5 / 0.9, abs=0.01)
    assert max(Counter(r["doc_id"] for r in got if r["source"] == "small").values()) <= 3
    assert max(Counter(r["doc_id"] for r in got if r["source"] == "big").values()) == 1
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    for source in ("big", "small"):  # no gap and no overlap in what a source gives
        mine = sorted((r["token_start"], r["n_tokens"]) for r in got if r["source"] == source)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    rows = {r["source"]: r for r in report(mix(counted, targets), targets, counted).collect()}
    assert rows["gone"]["actual_share"] == 0 and rows["small"]["most_copies"] <= 3
    assert len(enc.encode_ordinary("w " * 3)) > 0


def test_position(spark):
    from pyspark.sql import functions as F

    for lean in (-0.5, 0.0, 0.7):
        row = spark.range(1).select(*[position(F.lit(q), F.lit(lean)).alias(f"p{k}") for k, q in enumerate((0.0, 0.3, 1.0))]).first()
        assert [(1 - lean) * t + lean * t * t for t in row] == pytest.approx([0.0, 0.3, 1.0])


def test_empty(spark):
    counted, targets = _fixture(spark)
    assert mix(counted.limit(0), targets).count() == 0
    assert report(mix(counted.limit(0), targets), targets, counted.limit(0)).count() == 3
