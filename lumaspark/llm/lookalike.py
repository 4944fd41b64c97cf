"""Problem 2: text that looks alike but differs in its characters.

A transducer is compiled once from Unicode data plus a short list of look-alike letters. It reads a
text character by character: widths, letter-like symbols, spaces, hyphens and invisible characters
are mapped as they come in, and its states are the clusters read so far, so that the longest
sequence of base and marks ends in its composed letter. Look-alike letters are settled as each word
ends, since only a whole word tells which script a letter belongs to.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts drawn like a Latin letter, "other=latin".
CYRILLIC_LOOKS = (
    "А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T Х=X У=Y І=I Ѕ=S Ј=J Ԛ=Q Ԝ=W "
    "а=a е=e о=o р=p с=c х=x у=y і=i ѕ=s ј=j һ=h ԁ=d ԛ=q ԝ=w ӏ=l"
)
GREEK_LOOKS = "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ϲ=C α=a γ=y ι=i κ=k ν=v ο=o ρ=p υ=u ϲ=c ϳ=j"
# The same for scripts that no entry is written in: they are only moved to Latin.
OTHER_LOOKS = (
    "Ꭰ=D Ꭱ=R Ꭲ=T Ꭺ=A Ꭻ=J Ꭼ=E Ꮃ=W Ꮇ=M Ꮋ=H Ꮐ=G Ꮓ=Z Ꮩ=V Ꮪ=S Ꮮ=L Ꮯ=C Ꮲ=P Ꮶ=K Ᏼ=B "
    "Օ=O Ս=U Տ=S օ=o ս=u ո=n հ=h ց=g զ=q"
)
# Letters of the Latin block that are drawn like a basic Latin letter.
LATIN_LOOKS = "ɡ=g ı=ı"
# Characters that aren't drawn (Unicode's default-ignorable ones), as code points.
INVISIBLE = "AD 34F 61C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
HYPHENS = "\u2010\u2011"
#: A blank that isn't among Unicode's spaces.
BLANKS = "\u2800"
#: Kinds of compatibility letters that are drawn as the plain ones, and those taken of the rest: roman
#: numerals, circled letters, Latin ligatures.
SAME_LOOK, LETTER_LIKE = ("<wide", "<narrow", "<font"), ((0x2160, 0x217F), (0x24B6, 0x24E9), (0xFB00, 0xFB06))
#: Code points that hold characters with a decomposition; those between have none.
PLANES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))

LATIN, GREEK, CYRILLIC, OTHER = "Latn", "Grek", "Cyrl", "Othr"


def script_of(ch: str) -> str | None:
    """Script of a letter, or None for anything that belongs to no script."""
    if ch < "\x80":
        return LATIN if ch.isalpha() else None
    if not unicodedata.category(ch).startswith("L"):
        return None
    name = unicodedata.name(ch, "")
    for start, script in (("LATIN", LATIN), ("GREEK", GREEK), ("CYRILLIC", CYRILLIC)):
        if name.startswith(start):
            return script
    return None if "MODIFIER" in name or "ORDINAL" in name else OTHER


def _pairs(looks: str) -> list[tuple[str, str]]:
    return [(p[0], p[2:]) for p in looks.split() if p[0] != p[2:]]


def _put(table: dict[str, str], key: str, value: str) -> None:
    if table.setdefault(key, value) != value:
        raise ValueError(f"conflict: {key!r} maps to {table[key]!r} and {value!r}")


@cache
def compiled() -> tuple[dict[str, str], dict[str, dict[str, str]], dict[str, int]]:
    """(character -> plain form, state -> next character -> state, mark -> place among marks).

    A state is a composed letter. Sequences of three or more are chains of states, in any order of
    marks that Unicode takes for the same. The tables are checked for conflicts, and what a character
    is mapped to is never mapped again.
    """
    plain: dict[str, str] = {}
    steps: dict[str, dict[str, str]] = {}
    marks: dict[str, int] = {}
    for span in INVISIBLE.split():
        first, _, last = span.partition("-")
        for code in range(int(first, 16), int(last or first, 16) + 1):
            _put(plain, chr(code), "")
    for ch in HYPHENS:
        _put(plain, ch, "-")
    for ch in BLANKS:
        _put(plain, ch, " ")
    for ch, to in _pairs(LATIN_LOOKS):
        _put(plain, ch, to)
    for code in (c for a, b in PLANES for c in range(a, b)):
        ch = chr(code)
        if place := unicodedata.combining(ch):
            marks[ch] = place
        if ch in plain:
            continue
        if unicodedata.category(ch) == "Zs":
            _put(plain, ch, " ")
        elif parts := unicodedata.decomposition(ch):
            kind, _, rest = parts.rpartition("> ")
            if kind:
                if kind in SAME_LOOK or any(a <= code <= b for a, b in LETTER_LIKE):
                    _put(plain, ch, unicodedata.normalize("NFKC", ch))
            elif unicodedata.normalize("NFC", ch) != ch:
                _put(plain, ch, unicodedata.normalize("NFC", ch))
            elif " " in rest:
                a, b = (chr(int(x, 16)) for x in rest.split())
                _put(steps.setdefault(a, {}), b, ch)
                base, *rest_ = unicodedata.normalize("NFD", ch)
                for k, mark in enumerate(rest_[:-1]):  # the letter that has all marks but an earlier one
                    short = unicodedata.normalize("NFC", "".join((base, *rest_[:k], *rest_[k + 1 :])))
                    if len(short) == 1 and unicodedata.combining(mark) not in (0, *map(unicodedata.combining, rest_[k + 1 :])):
                        _put(steps.setdefault(short, {}), mark, ch)
    for lead in range(19):  # Hangul syllables are composed by rule
        for vowel in range(21):
            start = chr(0xAC00 + (lead * 21 + vowel) * 28)
            _put(steps.setdefault(chr(0x1100 + lead), {}), chr(0x1161 + vowel), start)
            steps[start] = {chr(0x11A7 + t): chr(ord(start) + t) for t in range(1, 28)}
    bad = [k for k, v in plain.items() if any(c in plain for c in v)]
    if bad:
        raise ValueError(f"conflict: the image of {bad!r} is mapped again")
    return plain, steps, marks


class Transducer:
    """Compiled longest-match mapping; ``convert`` gives the one consistent form of a text.

    :param entries: canonical texts. A word wholly in one script is moved to another script only
        where the text then holds one of these.
    """

    def __init__(self, entries: Iterable[str] = ()):
        self.plain, self.steps, self.marks = compiled()
        self.to: dict[str, dict[str, str]] = {LATIN: {}, GREEK: {}, CYRILLIC: {}}
        for script, looks in ((GREEK, GREEK_LOOKS), (CYRILLIC, CYRILLIC_LOOKS)):
            for other, latin in _pairs(looks):
                _put(self.to[LATIN], other, latin)
                _put(self.to[script], latin, other)
        for other, latin in _pairs(OTHER_LOOKS):
            _put(self.to[LATIN], other, latin)
        for other, latin in _pairs(CYRILLIC_LOOKS):  # Greek and Cyrillic meet through Latin
            greek = self.to[GREEK].get(latin)
            if greek:
                _put(self.to[GREEK], other, greek)
                _put(self.to[CYRILLIC], greek, other)
        self.scripts: dict[str, str | None] = {}
        self.looks: dict[str, list[tuple[list[str], list[str]]]] = {}
        for entry in entries:
            words = [w for w in self._words(self._clusters(entry)) if w[0]]
            texts = [w[1] for w in words]
            seen = [self._look(t) for t in texts]
            for look in set(seen):
                self.looks.setdefault(look, []).append((seen, texts))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("plain", "steps", "marks")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.plain, self.steps, self.marks = compiled()

    def _cluster(self, base: str, marks: list[str]) -> str:
        """A letter and its marks in one form: in their order, each that can be is taken into the letter."""
        if len(marks) > 1:
            marks.sort(key=self.marks.__getitem__)
        left, before = "", 0
        for m in marks:
            step = self.steps.get(base)
            if step is not None and m in step and (not left or self.marks[m] != before):
                base = step[m]
            else:
                left += m
                before = self.marks[m]
        return base + left

    def _clusters(self, text: str) -> Iterator[str]:
        """Plain clusters of a text, each composed as far as it goes."""
        base, held = "", []
        plain, steps, marks = self.plain, self.steps, self.marks
        for ch in text:
            for c in plain.get(ch, ch) if ch >= "\x80" else ch:
                if base and c in marks:
                    held.append(c)
                    continue
                if held:
                    base, held = self._cluster(base, held), []
                elif base and c >= "\x80" and c in steps.get(base, ()):
                    base = steps[base][c]
                    continue
                if base:
                    yield base
                base = c
        if base:
            yield self._cluster(base, held) if held else base

    def _script(self, cluster: str) -> str | None:
        try:
            return self.scripts[cluster]
        except KeyError:
            self.scripts[cluster] = found = script_of(unicodedata.normalize("NFD", cluster)[0] if len(cluster) > 1 else cluster)
            return found

    def _words(self, clusters: Iterator[str]) -> Iterator[tuple[bool, str, set[str], list[str]]]:
        """(is a word, text, scripts, clusters) for runs of letters or digits and for the rest."""
        run: list[str] = []
        scripts: set[str] = set()
        word = False
        for c in clusters:
            inside = c[0].isalnum() and c[0] not in "²³¹"
            if run and inside != word:
                yield word, "".join(run), scripts, run
                run, scripts = [], set()
            word = inside
            run.append(c)
            if inside and (s := self._script(c)):
                scripts.add(s)
        if run:
            yield word, "".join(run), scripts, run

    def _look(self, word: str) -> str:
        """What a word looks like, whatever its scripts and case."""
        return "".join(self.to[LATIN].get(c, c) for c in word).casefold()

    def _moved(self, clusters: list[str], script: str) -> str | None:
        """The word in one script, or None if one of its letters has no look-alike there."""
        out = []
        for c in clusters:
            s = self._script(c)
            if s is not None and s != script:
                c = self.to[script].get(c)
                if c is None:
                    return None
            out.append(c)
        return "".join(out)

    def convert(self, text: str | None) -> str | None:
        """The consistent form. None stays None, an empty text stays empty; it is idempotent."""
        if text is None:
            return None
        if text.isascii() and not self.looks:
            return text
        words = list(self._words(self._clusters(text)))
        out = [w[1] for w in words]
        used: set[str] = set()
        for i, (word, _, scripts, clusters) in enumerate(words):
            if word and len(scripts) > 1:
                for script in (LATIN, GREEK, CYRILLIC):
                    moved = self._moved(clusters, script)
                    if moved is not None:
                        out[i] = moved
                        used.add(script)
                        break
        if len(used) == 1:  # the disguise of one word goes on in words that are look-alikes throughout
            script = next(iter(used))
            for i, (word, _, scripts, clusters) in enumerate(words):
                if word and len(scripts) == 1 and script not in scripts:
                    out[i] = self._moved(clusters, script) or out[i]
        if self.looks:
            at = [i for i, w in enumerate(words) if w[0]]
            looks = [self._look(out[i]) for i in at]
            for k, look in enumerate(looks):
                for seen, texts in self.looks.get(look, ()):
                    for j, other in enumerate(seen):
                        start = k - j
                        if other != look or start < 0 or looks[start : start + len(seen)] != seen:
                            continue
                        word, _, scripts, clusters = words[at[k]]
                        want = {s for c in texts[j] if (s := self._script(c))}
                        have = {s for c in out[at[k]] if (s := self._script(c))}
                        if len(want) == 1 and len(have) == 1 and want != have:
                            moved = self._moved(list(out[at[k]]), next(iter(want)))
                            if moved is not None:
                                out[at[k]] = moved
        return "".join(out)


def make_converter(entries: list[str] | None = None):
    """A column function giving the consistent form; ``entries`` are the canonical texts.

    Repeated texts are converted once per worker batch run (a bounded memo), so a hot text costs a
    dictionary lookup.
    """
    entries = list(entries or [])
    state: dict = {}

    def run(texts: pd.Series) -> pd.Series:
        if "t" not in state:
            state["t"], state["memo"] = Transducer(entries), {}
        memo, convert = state["memo"], state["t"].convert
        if len(memo) > 200_000:
            memo.clear()
        out = []
        for x in texts:
            if x is None:
                out.append(None)
                continue
            y = memo.get(x)
            if y is None:
                y = convert(x)
                if len(x) < 400:
                    memo[x] = y
            out.append(y)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(run, "string")


def consistent(df: DataFrame, text: str | Column, entries: list[str] | None = None, to: str = "consistent") -> DataFrame:
    """Add column ``to``: the consistent form of ``text``.

    Nulls stay null, empty texts stay empty, rows are neither dropped nor merged; a column named
    ``to`` that exists already is replaced. Whole texts are converted, however long.
    """
    col = F.col(text) if isinstance(text, str) else text
    return df.withColumn(to, make_converter(entries)(col))
