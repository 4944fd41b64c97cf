"""Problem 5: mapping freely typed values to a canonical list.

A BK-tree holds the reference entries under the Damerau-Levenshtein metric (the unrestricted one,
which is a true metric), so the triangle inequality prunes without losing an entry. Every span of
words of a text is looked up; digits must agree exactly, letters within a threshold.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookalike import Transducer

#: Letters that no Unicode decomposition takes apart.
_PLAIN = {ord(a): b for a, b in zip("øæœłđðþßı", ["o", "e", "e", "l", "d", "d", "th", "ss", "i"])}
_MARKS = re.compile(r"™|®|©|\(\s*(?:tm|r|c)\s*\)", re.I)
_WORD = re.compile(r"[^\W_]+")
#: A shortened word, as in "Optics Ltd" written "Opt.".
_SHORT = re.compile(r"(?<![^\W\d_])([^\W\d_]++)\.(?!\w)")
#: Words that stand beside a name, also written onto it without a space.
BESIDE = "camera body kit digital company inc corp gmbh coltd ltd co sa eu".split()
#: Cyrillic letters in Latin spelling, and German spellings of umlauts.
_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "), strict=True))
_GERMAN = {"ä": "ae", "ö": "oe", "ü": "ue", "ø": "oe", "å": "aa", "æ": "ae", "œ": "oe"}
_LIGATURES = {"æ": "ae", "œ": "oe"}
#: Marks inside a name, as in "Splicer's".
_INSIDE = re.compile(r"(?<=\w)['’](?=\w)")


@lru_cache(maxsize=100_000)
def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance: insert, delete, replace, swap neighbours (unrestricted)."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        row, above = d[i + 1], d[i]
        for j, y in enumerate(b, 1):
            i1, j1 = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[i1][j1] + i - i1 - 1 + 1 + j - j1 - 1)
        last[x] = i
    return d[-1][-1]


class BKTree:
    """Entries by their distance to a parent; ``within`` returns every entry in reach."""

    def __init__(self, keys: list[str]):
        self.root: list | None = None
        for key in sorted(set(keys)):
            if self.root is None:
                self.root = [key, {}]
                continue
            node = self.root
            while (k := edit_distance(key, node[0])) in node[1]:
                node = node[1][k]
            node[1][k] = [key, {}]

    def within(self, query: str, reach: int) -> list[tuple[int, str]]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            key, below = stack.pop()
            d = edit_distance(query, key)
            if d <= reach:
                found.append((d, key))
            stack += [node for k, node in below.items() if d - reach <= k <= d + reach]
        return sorted(found)


def reach_of(letters: int) -> int:
    """Edits allowed in a name of so many letters."""
    return 0 if letters < 2 else 1 if letters < 5 else 2


def _digits(key: str) -> str:
    return re.sub(r"\D", "", key)


class Mapper:
    """Maps texts of one field to its reference entries.

    :param entries: (id, text) of the field's entries; the smallest id wins among equal keys.
    :param others: texts of other fields that may stand beside a name (a make before a model), also
        written together with it; they are never the answer.
    :param names: what ``names_of`` gives for the whole field, where ``entries`` are only a shard of it.
    :param tree_only: look spans of words up in the tree and do nothing else: no words are taken apart,
        no word beside a name is taken off, no shortened word is written out.
    """

    def __init__(self, entries: list[tuple[int, str]], others: list[str] | None = None, names: tuple | None = None, tree_only: bool = False):
        self.tree_only = tree_only
        self.fold, self.longest, self.beside, self.joined = names or self.names_of([t for _, t in entries], others)
        self.by_key: dict[str, int] = {}
        self.split: list[tuple[int, list[str]]] = []
        for ref_id, text in sorted(entries):
            for spelt in dict.fromkeys((text, self.respelt(text, _LATIN), self.respelt(text, _GERMAN), self.respelt(text, _LIGATURES))):
                words = self.words(spelt)
                if words:
                    self.by_key.setdefault("".join(words), ref_id)
                    self.split.append((ref_id, words))
        self.sizes = sorted(set(map(len, self.joined)), reverse=True)
        self.tree = BKTree(list(self.by_key))
        self.widest = max(map(len, self.by_key), default=0)
        # entries by first word and by key, both in order, and a tree of the first words, for shortened words
        self.first: dict[str, list[int]] = {}
        for k, (_, words) in enumerate(self.split):
            self.first.setdefault(words[0], []).append(k)
        self.firsts, self.first_tree = sorted(self.first), BKTree(list(self.first))
        self.keys = sorted(("".join(words), k) for k, (_, words) in enumerate(self.split))
        self.lines = "\n".join(["", *self.by_key, ""])
        self.memo: dict[str, tuple[int, str] | None] = {}

    @classmethod
    def names_of(cls, texts: list[str], others: list[str] | None = None) -> tuple[Transducer, int, set[str], set[str]]:
        """What a mapper needs of all entries of a field and of the other fields: the transducer, the
        most words of an entry, the keys that stand beside a name, those and their first words."""
        fold = Transducer(texts)
        beside = [w for w in (cls._words(fold, o) for o in others or []) if w]
        keys = {"".join(w) for w in beside}
        longest = max((len(cls._words(fold, t)) for t in texts), default=0)
        return fold, longest, keys, keys | {w[0] for w in beside if len(w[0]) > 4 and w[0].isalpha()}

    def words(self, text: str) -> list[str]:
        return self._words(self.fold, text)

    @staticmethod
    def _words(fold: Transducer, text: str) -> list[str]:
        text = fold.convert(text) or ""
        text = _INSIDE.sub("", _MARKS.sub(" ", text))
        text = unicodedata.normalize("NFKD", text.casefold().translate(_PLAIN))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(_PLAIN)
        return _WORD.findall(text)

    @staticmethod
    def respelt(text: str, table: dict[str, str]) -> str:
        return "".join(table.get(c, c) for c in unicodedata.normalize("NFC", text.casefold()))

    def _longer(self, key: str) -> bool:
        """Whether the key is a part of a longer one."""
        at = self.lines.find(key)
        while at >= 0:
            if self.lines[at - 1] != "\n" or self.lines[at + len(key)] != "\n":
                return True
            at = self.lines.find(key, at + 1)
        return False

    def _short(self, text: str, words: list[str]) -> tuple[int, int, str] | None:
        """The one entry that a text with a shortened last word can mean, or None."""
        return next(filter(None, (self._only(*h) for h in self._shortened(text, words))), None)

    @staticmethod
    def _only(hits: dict[int, tuple[int, str]], last: set[int]) -> tuple[int, int, str] | None:
        if len(last) == 1:
            hits = {ref_id: hits[ref_id] for ref_id in last}
        if len(hits) == 1:
            (ref_id, (far, key)), = hits.items()
            return ref_id, far, key
        return None

    def _shortened(self, text: str, words: list[str]) -> Iterator[tuple[dict[int, tuple[int, str]], set[int]]]:
        """For each span that ends in a shortened word: the entries it can mean, and those of them
        whose last word it is."""
        cut = {w for t in _SHORT.findall(self.fold.convert(text)) for w in self.words(t)} - set(BESIDE)
        starts = [0] + [i for i in range(1, len(words)) if "".join(words[:i]) in self.beside]
        for start in starts:
            for end in range(start, len(words)):
                if words[end] not in cut:
                    continue
                n = end - start
                hits: dict[int, tuple[int, str]] = {}
                last: set[int] = set()
                joined = "".join(words[start : end + 1])
                for ref_id, entry in self._likely(words[start], words[end], joined, n):
                    if len(joined) >= 5 and "".join(entry).startswith(joined):
                        hits[ref_id] = (0, "".join(entry))
                    if len(entry) > n and entry[n] != words[end] and self._begins(entry[n], words[end], n > 0):
                        far = [edit_distance(a, b) for a, b in zip(words[start:end], entry)]
                        if all(f <= min(1, reach_of(len(e))) for f, e in zip(far, entry)):
                            hits[ref_id] = (sum(far), "".join(entry))
                            if len(entry) == n + 1:
                                last.add(ref_id)
                yield hits, last

    def _likely(self, first: str, cut: str, joined: str, n: int) -> list[tuple[int, list[str]]]:
        """The entries that a span of n words and a shortened one can mean: those whose key begins with it,
        and those whose first word is near (or, if that is the shortened one, begins with it)."""
        if n:
            near = [w for _, w in self.first_tree.within(first, 1)]
        else:
            near = self.firsts[bisect_left(self.firsts, cut) : bisect_left(self.firsts, cut + chr(0x10FFFF))]
        found = {k for w in near for k in self.first[w]}
        if len(joined) >= 5:
            found.update(k for _, k in self.keys[bisect_left(self.keys, (joined,)) : bisect_left(self.keys, (joined + chr(0x10FFFF),))])
        return [self.split[k] for k in sorted(found)]

    @staticmethod
    def _begins(word: str, cut: str, slip: bool) -> bool:
        """Whether ``cut`` is the beginning of a word, perhaps with one slip."""
        if word.startswith(cut):
            return True
        return slip and len(cut) > 2 and any(edit_distance(cut, word[:k]) < 2 for k in range(len(cut) - 1, len(cut) + 2))

    def _near(self, key: str) -> tuple[int, str] | None:
        """The nearest entry of a span, or None; a tie between entries is settled by the key."""
        if len(key) > self.widest + 2:  # no entry is in reach
            return None
        if key in self.memo:
            return self.memo[key]
        best = None
        if key in self.by_key:
            best = (0, key)
        else:
            letters = sum(c.isalpha() for c in key)
            digits = _digits(key)
            if letters > 1:
                for d, entry in self.tree.within(key, 2 if letters > 3 else 1):
                    if _digits(entry) == digits and d <= reach_of(sum(c.isalpha() for c in entry)):
                        best = (d, entry)
                        break
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[key] = best
        return best

    def find(self, text: str) -> tuple[int, int, str] | None:
        """(ref_id, distance, entry key) of the entry meant, or None."""
        words = self.words(text)
        best: tuple[float, int, str] | None = None
        for exact in (True, False):
            for i in range(len(words)):
                key = ""
                for j in range(i, min(len(words), i + self.longest + 2)):
                    key += words[j]
                    for k in self._bare(key):
                        if exact:
                            hit = (0, k) if k in self.by_key else None
                        else:
                            hit = self._near(k) if k else None
                        if hit:
                            score = len(hit[1]) - 3 * hit[0]
                            if best is None or (score, -hit[0]) > (best[0], -best[1]) or (score, hit[0]) == best[:2] and hit[1] < best[2]:
                                best = (score, hit[0], hit[1])
            if best and not self._longer(best[2]):
                break
            if best and exact and len("".join(words)) <= len(best[2]):
                break
        if best is None:
            hit = None if self.tree_only else self._apart(words)
            return hit[1:] if hit else None if self.tree_only else self._short(text, words)
        if best[1] >= 2 and not self.tree_only:
            short = self._short(text, words)
            if short:
                return short
        return self.by_key[best[2]], best[1], best[2]

    def _apart(self, words: list[str]) -> tuple[int, int, int, str] | None:
        """The entry in words written together with a name of another field, after the number of the
        way of taking them apart; the first way that gives an entry counts."""
        way = 0
        for i in range(len(words)):
            key = ""
            for j in range(i, min(len(words), i + self.longest + 2)):
                key += words[j]
                for n in self.sizes if len(key) > 7 else ():
                    for other, rest in ((key[:n], key[n:]), (key[-n:], key[:-n]))[: 1 if key[:n] == key[-n:] else 2]:
                        way += 1
                        hit = self._near(rest) if len(rest) > 2 and other in self.joined else None
                        if hit:
                            return way, self.by_key[hit[1]], hit[0], hit[1]
        return None

    def candidates(self, text: str) -> list[tuple[str, str, int, str, int]]:
        """(kind, at, distance, key, ref_id): all that this shard of a field can add to an answer.

        ``size`` has the length of the text's key as its distance, ``near`` the nearest entry of each
        span, ``longer`` a span that is part of a longer key, ``apart`` the first way of taking words
        apart, ``short`` and ``last`` up to two entries that a shortened word can mean: one more
        doesn't make them less ambiguous.
        """
        words = self.words(text)
        out = [("size", "", len("".join(words)), "", 0)]
        seen: set[str] = {""}
        for i in range(len(words)):
            key = ""
            for j in range(i, min(len(words), i + self.longest + 2)):
                key += words[j]
                if len(key) > self.widest + 2 + max(map(len, BESIDE)):
                    break
                for k in self._bare(key):
                    if k in seen:
                        continue
                    seen.add(k)
                    if hit := self._near(k):
                        out.append(("near", k, *hit, self.by_key[hit[1]]))
                    if self._longer(k):
                        out.append(("longer", k, 0, "", 0))
        if self.tree_only:
            return out
        if not any(o[0] == "near" for o in out) and (hit := self._apart(words)):
            out.append(("apart", str(hit[0]), hit[2], hit[3], hit[1]))
        for n, (hits, last) in enumerate(self._shortened(text, words)):
            for ref_id in sorted(hits, key=lambda r: (r not in last, r))[:2]:
                out.append(("last" if ref_id in last else "short", str(n), *hits[ref_id], ref_id))
        return out

    @classmethod
    def settle(cls, candidates: list[tuple[str, str, int, str, int]]) -> tuple[int, int, str] | None:
        """What ``find`` gives with all entries, from the candidates of all shards."""
        near: dict[str, tuple[int, str, int]] = {}
        apart: list[tuple[int, int, str, int]] = []
        short: dict[int, tuple[dict, set]] = {}
        longer, size = set(), 0
        for kind, at, far, key, ref_id in candidates:
            if kind == "near":
                near[at] = min(near.get(at, (far, key, ref_id)), (far, key, ref_id))
            elif kind == "longer":
                longer.add(at)
            elif kind == "apart":
                apart.append((int(at), far, key, ref_id))
            elif kind == "size":
                size = far
            else:
                hits, last = short.setdefault(int(at), ({}, set()))
                hits[ref_id] = (far, key)
                if kind == "last":
                    last.add(ref_id)
        order = lambda h: (3 * h[0] - len(h[1]), *h)
        best = min((h for h in near.values() if h[0] == 0), key=order, default=None)
        if best is None or best[1] in longer and size > len(best[1]):
            best = min(near.values(), key=order, default=None)
        if best is None and apart:
            _, far, key, ref_id = min(apart)
            return ref_id, far, key
        if best is None or best[0] >= 2:
            hit = next(filter(None, (cls._only(*short[n]) for n in sorted(short))), None)
            if hit or best is None:
                return hit
        return best[2], best[0], best[1]

    def _bare(self, key: str) -> list[str]:
        """The key, and what is left of it without a word written onto it."""
        keys = [key]
        if self.tree_only:
            return keys
        if key.startswith("lib"):
            keys.append(key[3:])
        keys += [key[: -len(b)] for b in BESIDE if key.endswith(b) and len(key) > len(b) + 2]
        return keys


def has_sign(text: Column) -> Column:
    """Whether a text has a letter or digit."""
    return text.rlike(r"[\p{L}\p{N}]")


def mappers_of(entries: dict[str, list[tuple[int, str]]], tree_only: bool = False) -> dict[str, Mapper]:
    """A mapper for each field; the entries of the other fields may stand before a name."""
    return {f: Mapper(e, [t for g, o in entries.items() if g != f for _, t in o], tree_only=tree_only) for f, e in entries.items()}


def make_mapper(spark: SparkSession, mappers: dict[str, Mapper]):
    """Column function (field, text) -> struct<ref_id, distance>; the mappers, built once, are broadcast."""
    shared = spark.sparkContext.broadcast(mappers)
    memo: dict = {}

    def run(field: pd.Series, text: pd.Series) -> pd.DataFrame:
        if len(memo) > 200_000:
            memo.clear()
        ids, far = [], []
        for f, x in zip(field, text):
            if x is None or f not in shared.value:
                ids.append(None)
                far.append(None)
                continue
            hit = memo.get((f, x), False)
            if hit is False:
                hit = shared.value[f].find(x)
                if len(x) < 400:
                    memo[(f, x)] = hit
            ids.append(hit[0] if hit else 0)
            far.append(hit[1] if hit else None)
        return pd.DataFrame({"ref_id": pd.array(ids, dtype="Int64"), "distance": pd.array(far, dtype="Int32")})

    return F.pandas_udf(run, "ref_id long, distance int")


#: A reference list above this many entries is split into shards of so many; a tree of them is built
#: in a few seconds.
BROADCAST_ENTRIES = 5_000


def map_values(df: DataFrame, field: Column, text: Column, refs: DataFrame, to: str = "match", broadcast_entries: int = BROADCAST_ENTRIES, tree_only: bool = False) -> DataFrame:
    """Add struct column ``to`` (ref_id, distance): the entry of ``refs`` each text means.

    ``refs`` has ref_id, field_name, entry_name. ref_id is 0 and distance null where no entry is
    within reach; both are null where the text or its field is null or the field has no entries.
    Rows are kept as they are, repeated ones too. Up to ``broadcast_entries`` entries travel to
    every worker as one tree; a longer list is split into shards (see ``map_values_sharded``).
    ``tree_only`` leaves out the rules beside the tree (see ``Mapper``).
    """
    rows = refs.where("entry_name is not null and ref_id is not null").select("field_name", "ref_id", "entry_name").limit(broadcast_entries + 1).collect()
    if len(rows) > broadcast_entries:
        return map_values_sharded(df, field, text, refs, to, broadcast_entries, tree_only)
    entries: dict[str, list[tuple[int, str]]] = {}
    for f, i, t in rows:
        entries.setdefault(f, []).append((i, t))
    return df.withColumn(to, make_mapper(df.sparkSession, mappers_of(entries, tree_only))(field, text))


_PARTS = ["kind", "at", "distance", "key", "ref_id"]
_CANDIDATES = "array<struct<kind:string,at:string,distance:int,key:string,ref_id:long>>"


def _shard(spark: SparkSession, mappers: bytes):
    """Column function (field, text) -> all that a shard can add to the answer."""
    shared = spark.sparkContext.broadcast(mappers)
    state: dict[str, Mapper] = {}

    def run(field: pd.Series, text: pd.Series) -> pd.Series:
        if not state:
            state.update(pickle.loads(shared.value))
        return pd.Series([[dict(zip(_PARTS, c)) for c in state[f].candidates(t)] if f in state else [] for f, t in zip(field, text)], dtype="object")

    return F.pandas_udf(run, _CANDIDATES)


def map_values_sharded(df: DataFrame, field: Column, text: Column, refs: DataFrame, to: str = "match", per_shard: int = BROADCAST_ENTRIES, tree_only: bool = False) -> DataFrame:
    """The same result for a list too long for one worker's tree.

    Each shard of the list, built in a task of its own and broadcast, meets every distinct text where
    that lies and gives its candidates; what they mean is settled where those of all shards are
    together. Every shard knows the names of all entries (``Mapper.names_of``), but has only its own in
    a tree. The driver reads the list, so it must fit there; texts stay distributed.
    """
    spark = df.sparkSession
    clean = refs.where("entry_name is not null and ref_id is not null")
    texts_of: dict[str, list[str]] = {}
    for f, t in clean.select("field_name", "entry_name").toLocalIterator():
        texts_of.setdefault(f, []).append(t)
    shards = -(-sum(map(len, texts_of.values())) // per_shard) or 1
    names = spark.sparkContext.broadcast({f: Mapper.names_of(own, [t for g, o in texts_of.items() if g != f for t in o]) for f, own in texts_of.items()})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {f: list(zip(g["ref_id"].tolist(), g["entry_name"])) for f, g in pdf.groupby("field_name")}
        return pd.DataFrame({"mappers": [pickle.dumps({f: Mapper(own.get(f, []), names=names.value[f], tree_only=tree_only) for f in names.value})]})

    dealt = clean.select("field_name", "ref_id", "entry_name", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).alias("shard"))
    built = [r[0] for r in dealt.groupBy("shard").applyInPandas(build, "mappers binary").toLocalIterator()]
    asked = df.select(field.alias("_f"), text.alias("_t")).where(field.isin(*texts_of) & text.isNotNull()).distinct()
    found = [asked.select("_f", "_t", F.explode(_shard(spark, bytes(b))(F.col("_f"), F.col("_t"))).alias("_c")) for b in built] or [asked.select("_f", "_t", F.explode(F.array().cast(_CANDIDATES)).alias("_c"))]

    def settle(all_candidates: pd.Series) -> pd.DataFrame:
        hits = [Mapper.settle([tuple(c[p] for p in _PARTS) for c in cs]) for cs in all_candidates]
        return pd.DataFrame({"ref_id": pd.array([h[0] if h else 0 for h in hits], dtype="Int64"), "distance": pd.array([h[1] if h else None for h in hits], dtype="Int32")})

    best = reduce(DataFrame.unionByName, found).groupBy("_f", "_t").agg(F.collect_list("_c").alias("_c")).select("_f", "_t", F.pandas_udf(settle, "ref_id long, distance int")("_c").alias(to))
    keyed = df.withColumn("_kf", field).withColumn("_kt", text)
    return keyed.join(best, (keyed["_kf"] == best["_f"]) & (keyed["_kt"] == best["_t"]), "left").drop("_f", "_t", "_kf", "_kt")
