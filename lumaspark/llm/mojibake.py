"""Problem 1: text once decoded with a wrong character encoding.

Adjacent characters are scored by their mutual information in the whole corpus. Maximum-scoring
segments isolate improbable runs; only inside those runs inverse mappings are tried, and a mapping
is accepted when the repaired run is more probable in the corpus than the run as it stands.

Damage that is common in a corpus looks probable there, so the counts are made in two rounds: words
that the counts of the first round explain better as damaged are counted as what they were.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .lookalike import OTHER, script_of

#: Pairs are counted under a hash of so many bits: the table's size is fixed, whatever the corpus.
PAIR_BITS = 20
#: Code points above this are counted together.
TOP = 0x20000
#: Shares of the corpus that stand in for the missing evidence of a rare character, and of a pair that
#: only damaged words had.
SHRINK, UNSEEN = 1e-4, 1e-9
#: Pairs below this mutual information (nats) count as improbable, that is, those which their
#: characters' independence would make a good three times as frequent as they are.
LEVEL = -1.2
#: No pair speaks more than this (nats) against its run being improbable.
CAP = 3.0
#: A run as improbable as this (nats) is reported even if no mapping undoes it: two common letters on
#: either side of one that only damaged words have.
BROKEN = 12.0
#: Gain in log-likelihood (nats) that a repair must bring.
MARGIN = 2.0
#: The gain asked of a mix-up of two single-byte encodings, which any text could have undergone.
SINGLE_MARGIN = 1.5
#: The same for encodings of old terminals, which are rarely mixed up with those of Windows.
RARE_MARGIN = 8.0
RARE = ("cp437", "cp850", "cp866", "mac_roman")
#: What a mapping that was found in another word of the text is given in advance.
AGAIN = 2.0
#: A text may have been decoded wrongly so many times in a row.
DEPTH = 3

# Fixed values: (encoding the text was read with, encoding it was written in).
WRONG_READINGS = [
    *((read, "utf-8") for read in ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp1254", "cp1253", "cp866", "koi8_r", "gbk", "shift_jis")),
    *(("cp1252", wrote) for wrote in ("cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "koi8_r", "shift_jis", "euc_jp", "gbk", "mac_roman", "cp437", "cp850", "cp866")),
    *(("cp1251", wrote) for wrote in ("koi8_r", "cp866", "cp1252")),
    *(("koi8_r", wrote) for wrote in ("cp1251", "cp866")),
    ("cp866", "cp1251"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp850", "cp1252"),
]


def _table(codec: str) -> dict[int, int] | None:
    """Character to byte for a single-byte encoding; bytes it leaves out are read as Latin-1, and so is
    the whole of Latin-1 beside Windows-1252."""
    out = {b: b for b in range(128)}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        except LookupError:
            return None
        if len(ch) != 1:
            return None
        out.setdefault(ord(ch), b)
    if codec == "cp1252":
        for b in range(128, 256):
            out.setdefault(b, b)
    return out


_TABLES = {c: _table(c) for c in {r for r, _ in WRONG_READINGS} - {"gbk", "shift_jis"}}


def to_bytes(text: str, codec: str) -> bytes | None:
    """The bytes a reader of ``codec`` had before it, or None if it can't show this text."""
    table = _TABLES.get(codec)
    try:
        return text.encode(codec) if table is None else codecs.charmap_encode(text, "strict", table)[0]
    except UnicodeEncodeError:
        return None


#: The no-break space that ends many two-byte letters is often flattened to a plain space.
_FLATTENED = re.compile("(?<=[ÃÂГРÐ├√]) ")
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�-]")


def inverses(run: str) -> Iterator[tuple[str, str]]:
    """(repaired, how) for every mapping that undoes a wrong reading of the whole run."""
    tried: dict[str, str] = {run: ""}
    level = [run]
    for _ in range(DEPTH):
        after = []
        for text in level:
            for form in dict.fromkeys((text, _FLATTENED.sub("\xa0", text))):
                raws: dict[str, bytes | None] = {}
                for read, wrote in WRONG_READINGS:
                    if tried[text] and wrote != "utf-8":
                        continue  # single-byte mix-ups don't pile up
                    if read not in raws:
                        raws[read] = to_bytes(form, read)
                    raw = raws[read]
                    if raw is None:
                        continue
                    try:
                        new = raw.decode(wrote)
                    except UnicodeDecodeError:
                        continue
                    if new in tried:
                        continue
                    tried[new] = f"{tried[text]}{'+' if tried[text] else ''}{wrote}>{read}"
                    if wrote == "utf-8":
                        after.append(new)
                    if not _BAD.search(new):
                        yield new, tried[new]
        level = after


@dataclass
class PairModel:
    """Character and pair counts of a corpus. Its size is fixed: 2^20 pairs and 2^17 characters."""

    pairs: np.ndarray
    chars: np.ndarray

    def __post_init__(self):
        self.words: dict[str, bool] = {}
        self.repairs: dict[tuple, tuple] = {}
        self.total = max(float(self.chars.sum()), 1.0)
        self.share = self.chars / self.total
        self.floor = 1e-7 * self.total
        self.kappa = 2e-5 * self.total

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64), TOP - 1)

    @staticmethod
    def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def information(self, codes: np.ndarray) -> np.ndarray:
        """Mutual information of each adjacent pair, shrunk where a character is rare: two rare
        characters that only ever meet each other would look well associated."""
        a, b = codes[:-1], codes[1:]
        p = self.share
        return np.log((self.pairs[self.slot(a, b)] / self.total + UNSEEN) / ((p[a] + SHRINK) * (p[b] + SHRINK)))

    def improbability(self, text: str) -> np.ndarray:
        """Score of each pair of the text between two spaces: positive where it is improbable. Pairs of
        plain ASCII are never damaged and count against a run."""
        codes = self.codes(f" {text} ")
        score = np.maximum(LEVEL - self.information(codes), -CAP)
        wide = codes >= 128
        return np.where(wide[:-1] | wide[1:], score, np.minimum(score, -0.5))

    def doubtful(self, word: str) -> bool:
        """Whether a word holds an improbable pair. A segment begins and ends with such pairs, so a
        text without doubtful words has no segment. Words repeat far more than texts do."""
        if word.isascii():
            return False
        known = self.words.get(word)
        if known is None:
            if len(self.words) > 300_000:
                self.words.clear()
            known = self.words[word] = bool((self.improbability(word) > 0).any())
        return known

    def likelihood(self, text: str) -> float:
        """Log-likelihood of a text's characters, each given the one before."""
        codes = self.codes(text)
        a, b = codes[:-1], codes[1:]
        single = (self.chars[b] + self.floor) / self.total
        return float(np.log((self.pairs[self.slot(a, b)] + self.kappa * single) / (self.chars[a] + self.kappa)).sum())


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a sequence, in one pass (Ruzzo-Tompa)."""
    found: list[list[float]] = []  # start, end, sum before, sum at the end
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b)) for a, b, _, _ in found]


_TOKEN = re.compile("[^ ]+")
#: Words that aren't plain ASCII.
_WIDE = re.compile(r"(?<= )[!-~]*[^ -~][^ ]*")


def runs(text: str, model: PairModel) -> list[tuple[int, int, float]]:
    """Improbable runs [start, end) and how improbable they are: segments of low mutual information, widened to whole words.

    The plain space after an improbable character belongs to its run only through the words around
    it; a run of neighbouring words is one run, since a wrong reading goes on over spaces.
    """
    if not any(model.doubtful(w) for w in text.split(" ")):
        return []
    score = model.improbability(text)
    worth = np.zeros(len(text))
    for start, end in segments(score):
        worth[max(0, start - 1) : end] = score[start:end].sum()
    out: list[tuple[int, int, float]] = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        most = float(worth[a:b].max())
        if most > 0 and not text[a:b].isascii():
            if out and out[-1][1] + 1 == a:
                out[-1] = (out[-1][0], b, max(most, out[-1][2]))
            else:
                out.append((a, b, most))
    return out


def mixed(word: str) -> bool:
    """Whether a word has letters of two alphabets, which a true repair has not."""
    return len({s for s in map(script_of, word) if s} - {OTHER}) > 1


def margin(how: str, counting: bool = False) -> float:
    """The gain asked of a mapping; while counting, a word that is UTF-8 throughout need only be more
    probable so read, since chance hardly makes it so."""
    wrote, _, read = how.partition("+")[0].partition(">")
    if wrote == "utf-8":
        return 0.0 if counting else MARGIN
    return RARE_MARGIN if wrote in RARE or read in RARE else SINGLE_MARGIN + 2.0 * (wrote == "iso8859_2")


def mend(text: str, model: PairModel) -> tuple[bool, str, list[str]]:
    """(damaged, text as far as it can be had back, mappings undone).

    A run is damaged if a mapping undoes it, if it holds a control or replacement character, which no
    text has of itself, or if it is improbable beyond ``BROKEN``. A run of several words is mended as
    one or word by word, whichever gains more; a mapping found in one word is believed more easily in
    the others, and where UTF-8 was read wrongly no mix-up of single bytes is believed beside it.
    """
    damaged, how = False, []
    fixes: list[tuple[int, int, str, str]] = []
    left: list[tuple[int, int]] = []
    for start, end, worth in runs(text, model):
        damaged = damaged or worth >= BROKEN or bool(_BAD.search(text[start:end]))
        words = [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:end])]
        whole = _best(text, start, end, model)
        each = [_best(text, a, b, model) for a, b in words if not text[a:b].isascii()] if len(words) > 1 else []
        if whole[0] is not None and whole[2] >= sum(e[2] for e in each):
            fixes.append((start, end, *whole[:2]))
            how.append(whole[1])
            continue
        for (a, b), (new, name, _) in zip([w for w in words if not text[w[0] : w[1]].isascii()], each):
            if new is None:
                left.append((a, b))
            else:
                fixes.append((a, b, new, name))
                how.append(name)
    damaged = damaged or bool(fixes)
    if any(h.startswith("utf-8") for h in how):
        left += [f[:2] for f in fixes if not f[3].startswith("utf-8")]
        fixes = [f for f in fixes if f[3].startswith("utf-8")]
        how = [f[3] for f in fixes]
    if how:
        for a, b in left:
            new, name, _ = _best(text, a, b, model, frozenset(how))
            if new is not None and name in how:
                fixes.append((a, b, new, name))
    out, done = [], 0
    for a, b, new, _ in sorted(fixes):
        out += [text[done:a], new]
        done = b
    out.append(text[done:])
    return damaged, "".join(out), how


def _best(text: str, a: int, b: int, model: PairModel, known: frozenset[str] = frozenset(), counting: bool = False) -> tuple[str | None, str, float]:
    """The most probable repair of text[a:b], its mapping and its gain over the margin."""
    before, after = (text[a - 1 : a] or " "), (text[b : b + 1] or " ")
    run = text[a:b]
    flat = after == " " and b < len(text) and _FLATTENED.search(run[-1:] + after)
    key = (before, run, after, bool(flat), known)
    if key in model.repairs:
        return model.repairs[key]
    as_is = model.likelihood(before + run + after)
    best, name, top = None, "", 0.0
    for new, how in inverses(run + "\xa0" if flat else run):
        worth = model.likelihood(before + new + after) - as_is - margin(how, counting) + (AGAIN if how in known else 0.0)
        if worth > top and not any(mixed(w) for w in new.split()):
            best, name, top = new, how, worth
    if len(model.repairs) > 200_000:
        model.repairs.clear()
    model.repairs[key] = best, name, top
    return best, name, top


COUNTS = "kind int, slot int, word string, n long"


def _rows(pairs: np.ndarray, chars: np.ndarray) -> Iterator[pd.DataFrame]:
    for number, counts in enumerate((pairs, chars)):
        at = np.flatnonzero(counts)
        if len(at):
            yield pd.DataFrame({"kind": np.full(len(at), number, dtype="int32"), "slot": at.astype("int32"), "word": None, "n": counts[at].round().astype("int64")})


def _model(*counts: pd.DataFrame) -> PairModel:
    arrays = [np.zeros(1 << PAIR_BITS), np.zeros(TOP)]
    for pdf in counts:
        for number, target in enumerate(arrays):
            part = pdf[pdf["kind"] == number]
            target[part["slot"].to_numpy(dtype="int64")] += part["n"].to_numpy()
    return PairModel(*(np.maximum(a, 0).astype(np.float32) for a in arrays))


def count_pairs(texts: DataFrame, text: str, times: str | None = None) -> DataFrame:
    """(kind, slot, word, n): counts of hashed pairs (kind 0), of characters (1) and of words that
    aren't plain ASCII (2). Null texts count nothing.

    Every task adds pairs and characters up in arrays of fixed size and sends one row per slot in use;
    there are twice as many tasks as cores, so that part of the shuffle is bounded whatever the corpus.

    :param times: column with how often a text counts, which may be negative; once if not given.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, chars = np.zeros(1 << PAIR_BITS), np.zeros(TOP)
        words: Counter = Counter()
        flush = lambda: pd.DataFrame({"kind": np.full(len(words), 2, dtype="int32"), "slot": np.zeros(len(words), dtype="int32"), "word": list(words), "n": list(words.values())})
        for pdf in batches:
            for n in pdf["n"].unique().tolist():
                known = [x for x in pdf["text"].to_numpy()[(pdf["n"] == n).to_numpy()] if x is not None]
                for k in range(0, len(known), 2000):
                    joined = " " + "  ".join(known[k : k + 2000]) + " "
                    codes = PairModel.codes(joined)
                    pairs += n * np.bincount(PairModel.slot(codes[:-1], codes[1:]), minlength=1 << PAIR_BITS)
                    chars += n * np.bincount(codes, minlength=TOP)
                    for w, m in Counter(_WIDE.findall(joined)).items():
                        words[w] += n * m
                    if len(words) > 100_000:
                        yield flush()
                        words.clear()
        if words:
            yield flush()
        yield from _rows(pairs, chars)

    few = texts.select(F.col(text).alias("text"), (F.col(times) if times else F.lit(1)).alias("n")).coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    return few.mapInPandas(run, COUNTS).groupBy("kind", "slot", "word").agg(F.sum("n").alias("n"))


def count_mended(words: DataFrame, raw: PairModel) -> DataFrame:
    """Corrections of the counts: every distinct word that ``raw`` explains better as damaged is taken
    out and what it was put in, and a word with a control or replacement character is taken out."""
    shared = words.sparkSession.sparkContext.broadcast((raw.pairs, raw.chars))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = PairModel(*shared.value)
        pairs, chars = np.zeros(1 << PAIR_BITS), np.zeros(TOP)

        def add(word: str, n: int) -> None:
            codes = PairModel.codes(f" {word} ")
            np.add.at(pairs, PairModel.slot(codes[:-1], codes[1:]), n)
            np.add.at(chars, codes, n)

        for pdf in batches:
            for word, n in zip(pdf["word"], pdf["n"]):
                new = _best(word, 0, len(word), model, counting=True)[0]
                if new is not None:
                    add(word, -n)
                    add(new, n)
                elif _BAD.search(word):
                    add(word, -n)
        yield from _rows(pairs, chars)

    cores = words.sparkSession.sparkContext.defaultParallelism
    return words.repartition(2 * cores).mapInPandas(run, COUNTS).groupBy("kind", "slot").agg(F.sum("n").alias("n"))


def pair_model(texts: DataFrame, text: str, times: str | None = None) -> PairModel:
    """Fit the model on all texts in two rounds; the driver gets at most 2^20 + 2^17 numbers twice.

    The texts are read once: the second round needs only their distinct words, which stay distributed.
    """
    counts = checkpointed(count_pairs(texts, text, times))
    raw = counts.where("kind < 2").select("kind", "slot", "n").toPandas()
    return _model(raw, count_mended(counts.where("kind = 2 and n > 0").select("word", "n"), _model(raw)).toPandas())


def make_mender(df: DataFrame, model: PairModel):
    """Column function text -> struct<damaged, mended, how>; the model (5 MB) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((model.pairs, model.chars))
    state: dict = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        if "m" not in state:
            state["m"], state["memo"] = PairModel(*shared.value), {}
        m, memo = state["m"], state["memo"]
        if len(memo) > 200_000:
            memo.clear()
        rows = []
        for x in texts:
            if x is None:
                rows.append((None, None, None))
            elif x.isascii():
                rows.append((False, x, None))
            else:
                hit = memo.get(x)
                if hit is None:
                    damaged, mended, how = mend(x, m)
                    hit = (damaged, mended, ",".join(dict.fromkeys(how)) or None)
                    if len(x) < 400:
                        memo[x] = hit
                rows.append(hit)
        return pd.DataFrame(rows, columns=["damaged", "mended", "how"])

    return F.pandas_udf(run, "damaged boolean, mended string, how string")


def mend_text(df: DataFrame, text: str | Column, model: PairModel, to: str = "mend") -> DataFrame:
    """Add struct column ``to`` (damaged, mended, how).

    Null texts give a struct of nulls; empty and pure ASCII texts are never damaged. Texts that
    can't be had back stay as they are with damaged = true and no ``how``. Rows are kept as they are.
    """
    col = F.col(text) if isinstance(text, str) else text
    return df.withColumn(to, make_mender(df, model)(col))
