"""Problem 8: abusive, hateful or sexual content.

An FTRL-proximal logistic regression over hashed word n-grams and skip-grams scores every sentence
of a post; the post's score is that of its worst sentence. The training labels are readers' votes
on whole posts, so training alternates: the sentences of posts voted harmless are harmless, and of
a post voted abusive the sentence the model finds worst is the abusive one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalike import Transducer
from .posts import sentences_of

#: Weights are kept under a hash of so many bits.
BITS = 18
#: Posts at most used for fitting, taken by a hash of their ids; all votes on them count.
FIT_POSTS = 12_000
#: Words of a stretch that is scored as one; longer sentences are scored in stretches that overlap by half.
STRETCH = 16
#: Words between the two of a pair, and so the longest skip.
GAPS = 3
#: Stretches whose gradients are summed before the weights move.
BATCH = 16
#: Words turned into features at a time, which bounds the arrays.
AT_ONCE = 50_000
#: FTRL-proximal: rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.4, 0.05
#: Times the labels inside abusive posts are settled anew, and passes over the data for each.
SETTLE, PASSES = 3, 3
#: Parts of the labelled posts, each judged by a model of the other parts; margins beyond which a
#: vote is taken for a slip.
FOLDS, SLIP_LOW, SLIP_HIGH = 4, -3.0, 2.5
#: A post scored at least this is reported.
THRESHOLD = 0.15

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_JOIN = re.compile(r"[ .\-_*]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[^\W_]+(?:[*#@$]++[^\W_]+)*")
_LEET = str.maketrans("013457@$", "oieastas")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_STARS = re.compile(r"[*#@$]+")


def _raw(sentence: str, fold: Transducer) -> list[str]:
    """Words of a sentence as written, look-alikes and spaced letters undone."""
    text = fold.convert(sentence).casefold()
    words = _TOKEN.findall(text)
    if "*" in text or max(map(len, words), default=0) > 255 or b"\1\1\1\1" in bytes(map(len, words)):  # only then can letters be spaced
        words = _TOKEN.findall(_SPACED.sub(lambda m: _JOIN.sub("", m.group()), text))
    return words


def _plain(word: str) -> list[str]:
    """What a word counts as: digits for letters and repeated letters undone, a masked one marked as such."""
    out = []
    if not word.isalpha():
        if _STARS.search(word):
            if _STARS.sub("", word).isalpha():
                out.append("<mask>")
            word = _STARS.sub("*", word)
        elif _HAS_LETTER.search(word) and not word.isdigit():
            word = word.translate(_LEET)
        elif word.isdigit():
            word = "<n>"
    return [*out, _LONG.sub(r"\1", word)]


def tokens_of(sentence: str, fold: Transducer) -> list[str]:
    """Words with masked letters undone: look-alikes, spaced letters, digits for letters, repeats."""
    return [t for w in _raw(sentence, fold) for t in _plain(w)]


class _Codes(dict):
    """Word as written -> codes of what it counts as. Words repeat, so each is worked out once."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        code = self[word] = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in _plain(word))
        return code


class Coder:
    """Sentences as numbers: a code for each word."""

    def __init__(self):
        self.fold = Transducer()
        self.known = _Codes()

    def codes(self, sentence: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, _raw(sentence, self.fold))))


def _slots(a: np.ndarray, b: np.ndarray | None, gap: int) -> np.ndarray:
    x = a if b is None else a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(gap)
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(sentences: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed unigrams, bigrams and skip-grams of all stretches of sentences, as arrays.

    :return: stretches of each sentence, then a stretch number and a slot for each feature; a feature
        that a stretch has twice comes twice.
    """
    lengths = np.fromiter(map(len, sentences), dtype=np.int64, count=len(sentences))
    codes = np.fromiter(chain.from_iterable(sentences), dtype=np.uint64, count=int(lengths.sum()))
    half = STRETCH // 2
    n_of = np.where(lengths > 0, -(-np.maximum(1, lengths - half) // half), 0)
    of = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - (np.cumsum(lengths) - lengths)[of]
    first, most, left = (np.cumsum(n_of) - n_of)[of], n_of[of], lengths[of] - place
    stretch, slot = [], []
    for gap in range(GAPS + 1):
        at = np.flatnonzero(left > gap)
        slots = _slots(codes[at], codes[at + gap] if gap else None, gap)
        for back in (0, 1):
            k = place[at] // half - back
            use = (k >= 0) & (k < most[at]) & (place[at] + gap < k * half + STRETCH)
            stretch.append((first[at] + k)[use])
            slot.append(slots[use])
    return n_of, np.concatenate(stretch), np.concatenate(slot)


def _once(stretch: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a stretch once, stretches in order."""
    key = np.unique(stretch << BITS | slot)
    return key >> BITS, key & ((1 << BITS) - 1)


def sets_of(text: str | None, coder: Coder) -> tuple[list[int], list[int]]:
    """(features of each stretch, slots one after the other) of all sentences of a post."""
    sizes, slots, waiting, words = [], [], [], 0

    def flush() -> None:
        n_of, stretch, slot = features(waiting)
        stretch, slot = _once(stretch, slot)
        sizes.extend(np.bincount(stretch, minlength=int(n_of.sum())).tolist())
        slots.extend(slot.tolist())

    for sentence in sentences_of(text) if text else []:
        waiting.append(coder.codes(sentence))
        words += len(waiting[-1])
        if words > AT_ONCE:
            flush()
            waiting, words = [], 0
    if waiting:
        flush()
    return sizes, slots


class FTRL:
    """FTRL-proximal logistic regression with per-coordinate rates and L1 sparsity.

    It learns from ``BATCH`` stretches at a time: their gradients are taken at the same weights and
    summed per coordinate, and so are their squares, which set the coordinate's rate.
    """

    def __init__(self):
        # the last coordinate is the bias, which every stretch has and L1 doesn't touch
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self._g, self._g2 = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        sparse = np.where(at == 1 << BITS, 0.0, L1)
        w = (np.sign(z) * sparse - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= sparse, 0.0, w)

    def margins(self, sets: Sets) -> np.ndarray:
        return np.add.reduceat(self.weights(sets.slots), sets.start) if len(sets.start) else np.zeros(0)

    def learn(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w, start), -35, 35)))
        g = (p - label) * weight
        np.add.at(self._g, at, np.repeat(g, size))
        np.add.at(self._g2, at, np.repeat(g * g, size))
        n, more = self.n[at], self._g2[at]
        self.z[at] = self.z[at] + self._g[at] - (np.sqrt(n + more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + more
        self._g[at] = self._g2[at] = 0.0

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(slots, weights, bias) of the weights that aren't zero."""
        at = np.flatnonzero(np.abs(self.z[:-1]) > L1)
        return at, self.weights(at).astype(np.float32), float(self.weights(np.array([1 << BITS]))[0])


class Sets:
    """Feature sets of stretches one after the other, each ended by the bias coordinate."""

    def __init__(self, slots: np.ndarray, size: np.ndarray):
        self.slots, self.size = slots, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of(cls, slots: np.ndarray, size: np.ndarray) -> Sets:
        return cls(np.insert(slots, np.cumsum(size), 1 << BITS), size + 1)

    def take(self, rows: np.ndarray) -> Sets:
        size = self.size[rows]
        shift = self.start[rows] - (np.cumsum(size) - size)
        return Sets(self.slots[np.repeat(shift, size) + np.arange(int(size.sum()))], size)


def _train(sets: Sets, rows: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int) -> FTRL:
    model = FTRL()
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rows[rng.permutation(len(rows))]
        taken = sets.take(order)
        for a in range(0, len(order), BATCH):
            b = min(len(order), a + BATCH)
            lo, hi = taken.start[a], taken.start[b - 1] + taken.size[b - 1]
            model.learn(taken.slots[lo:hi], taken.start[a:b] - lo, taken.size[a:b], label[order[a:b]], weight[order[a:b]])
    return model


class Labelled:
    """Stretches of the labelled posts. ``share`` is a post's share of votes for abusive."""

    def __init__(self, sizes: list, slots: list, share: np.ndarray):
        counts = np.array([len(s) for s in sizes], dtype=np.int64)
        flat = lambda parts: np.concatenate([np.asarray(p, dtype=np.int64) for p in parts]) if len(parts) else np.zeros(0, dtype=np.int64)
        self.sets = Sets.of(flat(slots), flat(sizes))
        self.share, self.post = share, np.repeat(np.arange(len(counts)), counts)
        self.part = np.random.default_rng(7).integers(0, FOLDS, len(counts))
        self.label = (share > 0.5).astype(float)[self.post]
        self.sure = (2 * np.abs(share - 0.5))[self.post]
        self.spread = np.where(self.label > 0, 1 / np.sqrt(np.maximum(1, counts))[self.post], 1.0)

    def train(self, use: np.ndarray, keep: int | None, first: bool) -> FTRL:
        """A model of all parts but ``keep``."""
        rows = np.flatnonzero(use if keep is None else use & (self.part[self.post] != keep))
        return _train(self.sets, rows, self.label, self.sure * self.spread if first else self.sure, FOLDS if keep is None else keep)

    def judge(self, use: np.ndarray, keep: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(stretches of part ``keep``, their margins) by a model of the others."""
        model = self.train(use, keep, first)
        mine = np.flatnonzero(self.part[self.post] == keep)
        return mine, model.margins(self.sets.take(mine))

    def settled(self, margin: np.ndarray) -> np.ndarray:
        """Which stretches to learn from: of an abusive post the worst, of another all; none that speaks
        so plainly against its post's votes that they must be a slip."""
        top = np.full(len(self.share), -99.0)
        np.maximum.at(top, self.post, margin)
        of = top[self.post]
        return np.where(self.label > 0, (of > SLIP_LOW) & ((margin == of) | (margin > 1.0)), margin < SLIP_HIGH)


def labelled(documents: DataFrame, ratings: DataFrame, fit_posts: int = FIT_POSTS) -> DataFrame:
    """(doc_id, text, share) of the rated posts used for fitting.

    A vote repeated by the same rater counts once, a null vote not at all. The bound on posts is
    ``fit_posts``, by the smallest hashes of their ids, so the sample doesn't depend on file order.
    """
    votes = ratings.where("toxic is not null and doc_id is not null").select("doc_id", "rater", "toxic").distinct()
    share = votes.groupBy("doc_id").agg(((F.sum("toxic") + 0.5) / (F.count("*") + 1)).alias("share")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_posts)
    return documents.select("doc_id", "text").join(F.broadcast(share), "doc_id")


def _featurised(posts: DataFrame) -> DataFrame:
    """(doc_id, share, sizes, slots): feature sets of labelled posts, worked out where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder()
        for pdf in batches:
            done = [sets_of(t, coder) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "share": pdf["share"], "sizes": [d[0] for d in done], "slots": [d[1] for d in done]})

    return posts.where("share <> 0.5 and text <> ''").mapInPandas(run, "doc_id long, share double, sizes array<int>, slots array<int>")


def judged(documents: DataFrame, ratings: DataFrame, fit_posts: int = FIT_POSTS) -> tuple[Labelled, np.ndarray, np.ndarray]:
    """(labelled posts, stretches to learn from, held-out margins of all stretches).

    Which stretch of an abusive post is the abusive one is settled by models that haven't seen the
    post: in each round every part is judged in a task of its own by a model of the other parts. The
    driver holds only the feature sets of at most ``fit_posts`` posts.
    """
    spark = documents.sparkSession
    rows = _featurised(labelled(documents, ratings, fit_posts).repartition(8)).toPandas().sort_values(["doc_id", "share"], kind="stable")
    data = Labelled(list(rows["sizes"]), list(rows["slots"]), rows["share"].to_numpy(dtype=float))
    use, margin = np.ones(len(data.post), dtype=bool), np.zeros(len(data.post))
    if not len(data.post):
        return data, use, margin
    shared = spark.sparkContext.broadcast(data)
    for settle in range(SETTLE):
        now = spark.sparkContext.broadcast(use)

        def run(batches: Iterator[pd.DataFrame], first: bool = settle == 0, now=now) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in pdf["id"]:
                    at, m = shared.value.judge(now.value, int(part), first)
                    yield pd.DataFrame({"at": at, "m": m})

        out = spark.range(0, FOLDS, 1, FOLDS).mapInPandas(run, "at long, m double").toPandas()
        margin[out["at"].to_numpy()] = out["m"].to_numpy()
        use = data.settled(margin)
        now.destroy()
    return data, use, margin


def fit_on(documents: DataFrame, ratings: DataFrame, fit_posts: int = FIT_POSTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``fit_posts`` rated posts: (slots, weights, bias), the same for any order of rows.

    The final model learns in one task from the stretches ``judged`` settles on. Without any votes
    every post scores 0.
    """
    data, use, _ = judged(documents, ratings, fit_posts)
    if not len(data.post):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -35.0
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((data, use))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            at, w, bias = shared.value[0].train(shared.value[1], None, False).compact()
            yield pd.DataFrame({"at": np.append(at, -1), "w": np.append(w.astype(float), bias)})

    out = spark.range(0, 1, 1, 1).mapInPandas(run, "at long, w double").toPandas()
    at, w = out["at"].to_numpy(), out["w"].to_numpy()
    return at[at >= 0], w[at >= 0].astype(np.float32), float(w[at < 0][0])


class Scorer:
    """Margins of sentences under fixed weights."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray, float]):
        at, w, self.bias = weights
        self.dense = np.zeros(1 << BITS)
        self.dense[at] = w
        self.coder = Coder()
        self.known: dict[str, float] = {}

    def _flush(self, asked: dict[str, list[int]], into: dict[str, float]) -> None:
        n_of, stretch, slot = features(list(asked.values()))
        hot = self.dense[slot] != 0  # the others add nothing
        stretch, slot = _once(stretch[hot], slot[hot])
        margin = np.bincount(stretch, weights=self.dense[slot], minlength=int(n_of.sum())) + self.bias
        worst = np.full(len(n_of), -35.0)
        some = n_of > 0
        if some.any():
            worst[some] = np.maximum.reduceat(margin, (np.cumsum(n_of) - n_of)[some])
        into.update(zip(asked, worst.tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Score of each post: that of its worst stretch."""
        if len(self.known) > 200_000:
            self.known.clear()
        posts = [sentences_of(t) if t else [] for t in texts]
        found: dict[str, float] = {}
        asked: dict[str, list[int]] = {}
        words = 0
        for sentences in posts:
            for s in sentences:
                if s not in self.known and s not in asked and s not in found:
                    asked[s] = self.coder.codes(s)
                    words += len(asked[s])
                    if words > AT_ONCE:
                        self._flush(asked, found)
                        asked, words = {}, 0
        if asked:
            self._flush(asked, found)
        known = self.known
        worst = np.array([max((found[s] if s in found else known[s] for s in p), default=-35.0) for p in posts])
        known.update((s, m) for s, m in found.items() if len(s) < 400)
        return np.where(worst > -35, 1 / (1 + np.exp(-np.clip(worst, -35, 35))), 0.0).tolist()


def make_scorer(df: DataFrame, weights: tuple[np.ndarray, np.ndarray, float]):
    """Column function text -> score; the sparse weights (at most 2^18) are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    state: dict = {}

    def run(texts: pd.Series) -> pd.Series:
        if "s" not in state:
            state["s"] = Scorer(shared.value)
        scorer, out, texts = state["s"], [], list(texts)
        for k in range(0, len(texts), 500):
            out += scorer.scores(texts[k : k + 500])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def score_posts(df: DataFrame, text: str | Column, weights: tuple[np.ndarray, np.ndarray, float], to: str = "score") -> DataFrame:
    """Add ``to``: the score of each post in [0, 1]. Null and empty texts score 0; rows are kept."""
    col = F.col(text) if isinstance(text, str) else text
    return df.withColumn(to, make_scorer(df, weights)(col))


def rates(scored: DataFrame, source: str = "source", score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """Posts, reported posts, rate and mean score per source; null sources form a group."""
    hit = (F.col(score) >= threshold).cast("long")
    return scored.groupBy(source).agg(F.count("*").alias("n_posts"), F.sum(hit).alias("n_reported"), F.avg(hit.cast("double")).alias("rate"), F.avg(score).alias("mean_score"))
