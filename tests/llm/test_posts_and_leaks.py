"""Words of posts and leaked test items."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaspark.llm.leakage import ItemIndex, find_leaks
from lumaspark.llm.posts import sentences_of, words_of


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Same&nbsp;<b>he</b>re,<br>now", ["same", "here", "now"]),
        ("[quote=anna]so­ft[/quote] _x_", ["soft", "x"]),
        ("> one\n> > two *three*", ["one", "two", "three"]),
        ("", []),
    ],
)
def test_words(text, want):
    assert words_of(text) == want


def test_sentences():
    wrapped = "> one line that is long enough that its mailer had to go on\n> with the rest of it below. Next one!\n| short line\n| another\n\n--\nThird"
    assert sentences_of(wrapped) == ["one line that is long enough that its mailer had to go on with the rest of it below.", "Next one!", "short line", "another", "Third"]
    assert sentences_of("") == sentences_of("\n > \n") == []


def brute(items, text, run):
    w = words_of(text)
    have = {tuple(w[p : p + run]) for p in range(len(w) - run + 1)}
    out = set()
    for i, t in items:
        x = words_of(t)
        if any(tuple(x[p : p + run]) in have for p in range(len(x) - run + 1)):
            out.add(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(rng.choice([4, 12, 40]))]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(2, 25)))) for k in range(20)]
    index = ItemIndex(items, run=4)
    for _ in range(10):
        text = rng.choices(vocab, k=rng.randint(0, 30))
        if rng.random() < 0.6:
            words = rng.choice(items)[1].split()
            at = rng.randint(0, len(text))
            text[at:at] = words[: rng.randint(1, len(words))]
        text = " ".join(text)
        assert {i for i, _ in index.leaks(text)} == brute(items, text, 4)


def test_column(spark):
    item = "the slender heron by the river keeps nine silver lamps for winter nights"
    docs = spark.createDataFrame([(1, f"so: {item.upper()}!", "a"), (1, f"so: {item.upper()}!", "a"), (2, None, "b"), (3, "", "c"), (4, " ".join(item.split()[:11]), "d"), (5, "x " * 100_000 + item, "e"), (None, item, "f")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, f"also {item} again"), (9, "too short"), (10, None)], "item_id long, text string")
    out = {tuple(r) for r in find_leaks(docs, items).collect()}
    assert out == {(1, 7, 13), (1, 8, 13), (5, 7, 13), (5, 8, 13)}
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_shards(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices([f"w{n}" for n in range(30)], k=40))) for k in range(30)]
    posts = [(k, " ".join(["zz", *items[rng.randrange(30)][1].split()[rng.randrange(20) :][: rng.randint(8, 20)], "yy"])) for k in range(200)]
    docs, held = spark.createDataFrame(posts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in find_leaks(docs, held).collect()}
    assert {r[:2] for r in one} == {(k, i) for k, t in posts for i in brute(items, t, 12)} and one
    assert {tuple(r) for r in find_leaks(docs, held, shard_chars=700).collect()} == one
