"""Abuse scores: tokens, held-out accuracy and odd rows."""

import random

import pytest

from lumaspark.llm.lookalike import Transducer
from lumaspark.llm.toxicity import THRESHOLD, fit_on, rates, score_posts, tokens_of

FOLD = Transducer()


@pytest.mark.parametrize(("text", "want"), [("s.t.u.p.i.d FUUUUCK", ["stupid", "fuck"]), ("d15gu571ng s**t", ["disgusting", "<mask>", "s*t"]), ("h o r n y рig", ["horny", "pig"]), ("12 cams", ["<n>", "cams"])])
def test_tokens(text, want):
    assert tokens_of(text, FOLD) == want


CALM = ["The tripod head arrived late.", "I would kill for that lens.", "Kill the worker process first.", "Is this scanner worth it?", "Thanks, that solved it."]
BAD = ["You filthy {} nobody asked you.", "All {} are parasites and should be driven out.", "I will find you, {} and break your fingers."]
NAMES = ["worm", "clown", "foreigners", "idiot", "scum"]


def _posts(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        bad = k % 4 == 0
        parts = [rng.choice(CALM) for _ in range(5)] + ([rng.choice(BAD).format(rng.choice(NAMES))] if bad else [])
        rng.shuffle(parts)
        out.append((k, " ".join(parts), rng.choice(["a", "b", None]), int(bad)))
    return out


def test_held_out(spark):
    train, test = _posts(600, 1), _posts(300, 2)
    docs = spark.createDataFrame([r[:3] for r in train], "doc_id long, text string, source string")
    votes = [(k, f"r{v}", bad if v else (1 - bad if k % 20 == 0 else bad)) for k, _, _, bad in train for v in range(3)]
    ratings = spark.createDataFrame(votes + votes[:50] + [(1, "r9", None), (None, "r1", 1)], "doc_id long, rater string, toxic int")
    weights = fit_on(docs, ratings)
    held = spark.createDataFrame([(*r[:3], 1.0) for r in test] + [(9001, None, "a", 1.0), (9002, "", "a", 1.0), (9003, "calm. " * 50_000, "a", 1.0), (9004, "calm.", "a", 1.0)], "doc_id long, text string, source string, score double")
    out = {r["doc_id"]: r["score"] for r in score_posts(held, "text", weights).collect()}
    assert sum((out[k] >= THRESHOLD) == bool(bad) for k, _, _, bad in test) >= 0.98 * len(test)
    assert out[9001] == out[9002] == 0.0 and out[9003] == out[9004] < 0.5
    assert {r["source"] for r in rates(score_posts(held, "text", weights)).collect()} == {"a", "b", None}
    assert score_posts(held.limit(0), "text", weights).count() == 0


def test_no_votes(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    weights = fit_on(docs, spark.createDataFrame([], "doc_id long, rater string, toxic int"))
    assert score_posts(docs, "text", weights).first()["score"] == 0.0
