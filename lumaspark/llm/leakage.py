"""Problem 6: evaluation texts leaking into training text.

Test items are the documents of a BM25 index; every passage of every post is a query against it.
Block-max WAND skips items and blocks that can't reach the threshold. The threshold is exact: an
item's scores are divided by the least score that any run of ``RUN`` of its words can have, so a
passage holding such a run scores at least 1 and none is lost. Passages end at words that no item
has, which no leak can hold. What is retrieved is verified word by word.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .posts import words_of

#: Successive words that make a leak.
RUN = 12
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Postings per block.
BLOCK = 8
#: Characters of test items in one broadcast index, on average; more items are searched in shards.
SHARD_CHARS = 4_000_000


class ItemIndex:
    """BM25 inverted index of test items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run = run
        self.words = {i: words_of(t or "") for i, t in sorted(items)}
        self.ids = sorted(i for i, w in self.words.items() if len(w) >= run)
        n = len(self.ids)
        mean = sum(len(self.words[i]) for i in self.ids) / n if n else 1.0
        tf = {i: Counter(self.words[i]) for i in self.ids}
        df = Counter(w for i in self.ids for w in tf[i])
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.grams: dict[int, set[tuple[str, ...]]] = {}
        for k, i in enumerate(self.ids):
            words = self.words[i]
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf[i].items()}
            self.grams[i] = {tuple(words[p : p + run]) for p in range(len(words) - run + 1)}
            least = min(sum(weight[w] for w in set(g)) for g in self.grams[i])
            for w, x in weight.items():
                postings[w].append((k, x / least))
        self.postings = {w: ([k for k, _ in p], [x for _, x in p]) for w, p in postings.items()}
        self.blocks = {w: [(p[0][min(s + BLOCK, len(p[0])) - 1], max(p[1][s : s + BLOCK])) for s in range(0, len(p[0]), BLOCK)] for w, p in self.postings.items()}
        self.top = {w: max(p[1]) for w, p in self.postings.items()}
        self.known: dict[tuple[str, ...], list[int]] = {}

    def above(self, words: set[str], threshold: float = 1.0 - 1e-9) -> list[int]:
        """All items scoring at least the threshold for a passage, by block-max WAND."""
        terms = [w for w in words if w in self.postings]
        if sum(self.top[w] for w in terms) < threshold:
            return []
        # a cursor: position, postings, weights, upper bound, block ends, block maxima
        cursors = [[0, *self.postings[w], self.top[w], [e for e, _ in self.blocks[w]], [m for _, m in self.blocks[w]]] for w in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, -1
            for j, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold:
                    pivot = j
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                pivot += 1
            block, until = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                at = bisect.bisect_left(c[4], item)
                if at < len(c[4]):
                    block += c[5][at]
                    until = min(until, c[4][at] + 1)
            if block >= threshold:
                if cursors[0][1][cursors[0][0]] == item:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += c[2][c[0]]
                        c[0] += 1
                    if score >= threshold:
                        found.append(self.ids[item])
                else:
                    for c in cursors[:pivot]:
                        c[0] = bisect.bisect_left(c[1], item, c[0])
            else:
                target = int(min(until, cursors[pivot + 1][1][cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else math.inf))
                for c in cursors[: pivot + 1]:
                    c[0] = bisect.bisect_left(c[1], target, c[0])
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return found

    def _passages(self, words: list[str]) -> Iterator[list[str]]:
        """Stretches of words that occur in items, cut to twice the run, each starting a run after the
        last, so any run of words lies whole in one of them; what can't reach the threshold even if
        all of its words scored their most is left out."""
        run, top, start = self.run, self.top, 0
        tops = [*map(top.get, words), None]
        for end in [i for i, x in enumerate(tops) if x is None]:
            if end - start >= run:
                for at in range(start, end - run + 1, run):
                    stop = min(end, at + 2 * run)
                    if sum(tops[at:stop]) >= 1.0 - 1e-9:
                        yield words[at:stop]
            start = end + 1

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """(item, words in the longest verified stretch) for every item a post leaks."""
        if not text:
            return []
        words = words_of(text)
        run = self.run
        best: dict[int, int] = {}
        for passage in self._passages(words):
            key = tuple(passage)
            hits = self.known.get(key)
            if hits is None:
                grams = [key[p : p + run] for p in range(len(key) - run + 1)]
                hits = [i for i in self.above(set(passage)) if any(g in self.grams[i] for g in grams)]
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[key] = hits
            best.update(dict.fromkeys(hits, 0))
        for i in best:
            grams, streak = self.grams[i], 0
            for p in range(len(words) - run + 1):
                streak = streak + 1 if tuple(words[p : p + run]) in grams else 0
                best[i] = max(best[i], streak + run - 1 if streak else 0)
        return sorted(best.items())


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words): every pair of a post and a test item it leaks.

    Null and empty texts leak nothing, items of fewer than ``run`` words can't leak, repeated rows
    of a post give one row per pair. Items are dealt out to as many indexes as their size asks for,
    each of which travels to every worker once and meets all posts; scores are relative to an item's
    own, so the shards change nothing. Posts stay where they are read: only pairs found are shuffled.
    """
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    shards = -(-(rows.agg(F.sum(F.length("item_text"))).first()[0] or 0) // shard_chars) or 1
    posts = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = [posts.select("doc_id", F.explode(_searcher(rows, shards, k, run)(F.col("text"))).alias("leak")) for k in range(shards)]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", F.col("leak.item_id").alias("item_id")).agg(F.max("leak.n_words").alias("n_words"))


def _searcher(rows: DataFrame, shards: int, k: int, run: int):
    """Column function text -> leaks of the items of one shard."""
    mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect()
    shared = rows.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in mine])
    state: dict = {}

    def search(texts: pd.Series) -> pd.Series:
        if "index" not in state:
            state["index"] = ItemIndex(shared.value, run)
        index = state["index"]
        return pd.Series([[{"item_id": i, "n_words": n} for i, n in index.leaks(t)] for t in texts], dtype="object")

    return F.pandas_udf(search, "array<struct<item_id:long,n_words:int>>")
