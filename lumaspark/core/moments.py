"""Problem 4: date texts in many formats and zones as one UTC moment.

Each text is read under every format whose pattern it fits; each reading is a full local date and
time or a UTC moment. Where more than one reading is valid, the mixture of formats of its source
decides: expectation-maximisation over the counts of equal sets of readings per source gives each
reading a posterior. A posterior that stays below ``SURE`` is marked as unresolved and gives no
moment.
"""

from __future__ import annotations

import bisect
import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized

SURE = 0.9
#: What a source says about the order of its dates counts as much as this share of its rows.
PRIOR_SHARE = 0.2
#: Rows each format is given before any are counted.
FLOOR_ROWS = 0.01
#: Rounds of expectation and maximisation.
ROUNDS = 30

#: Zone abbreviations, hours from UTC, of the zones in use.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3,
    "EST": -5, "EDT": -4, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "JST": 9, "IST": 5.5,
    "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}
#: Month names by their first letters, in English, German and Portuguese.
MONTHS = {
    "jan": 1, "fev": 2, "feb": 2, "mar": 3, "mär": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "okt": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12,
}

_TIME = r"(?P<h>\d{1,2}):(?P<i>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d+))?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"\s*(?P<z>Z|[+-]\d{2}:?\d{2}|\[[A-Za-z_]+(?:/[A-Za-z_]+)*\]|[A-Za-z_]+/[A-Za-z_/]+|[A-Z]{2,5})?"
_WORD = r"(?P<mon>[^\W\d_]{3,})"
#: Formats in the order of their number; several may fit one text.
FORMATS: dict[str, re.Pattern] = {
    name: re.compile(pattern)
    for name, pattern in {
        "exif": rf"(?P<y>\d{{4}}):(?P<m>\d{{2}}):(?P<d>\d{{2}})[ T]{_TIME}{_ZONE}",
        "iso": rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})[ T]{_TIME}{_ZONE}",
        "ymd": rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})[ T]{_TIME}{_ZONE}",
        "dmy": rf"(?P<d>\d{{1,2}})[-/.](?P<m>\d{{1,2}})[-/.](?P<y>\d{{4}}),? {_TIME}{_ZONE}",
        "mdy": rf"(?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}})[-/.](?P<y>\d{{4}}),? {_TIME}{_ZONE}",
        "basic": r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T?(?P<h>\d{2})(?P<i>\d{2})(?P<s>\d{2})(?P<z>Z|[+-]\d{2}:?\d{2})?",
        "named": rf"(?:[A-Za-z]{{3,}}, )?(?P<d>\d{{1,2}})\.?(?: de)? {_WORD}\.?(?: de)? (?P<y>\d{{4}}),? {_TIME}{_ZONE}",
        "named_us": rf"{_WORD}\.? (?P<d>\d{{1,2}}),? (?P<y>\d{{4}}),? {_TIME}{_ZONE}",
        "count_s": r"(?P<n>\d{9,10})",
        "count_ms": r"(?P<n>\d{12,13})",
        "count_us": r"(?P<n>\d{15,16})",
    }.items()
}
NAMES = list(FORMATS)
_ALL_NUMBERS = ("dmy", "mdy", "ymd")
#: Reasons for a text without a moment, in ``state``.
RESOLVED, NO_FORMAT, IMPOSSIBLE, NO_ZONE, SKIPPED_OR_TWICE, AMBIGUOUS = "resolved", "no_format", "impossible", "no_zone", "skipped_or_twice", "ambiguous"

_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1000)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=200_000)
def _offset_at(name: str, hour: int) -> tuple[int, ...]:
    """The offsets (seconds) that make a local hour-of-quarter a real moment in a zone."""
    zone = _zone(name)
    local = _EPOCH + timedelta(minutes=15 * hour)
    found = []
    for fold in (0, 1):
        off = local.replace(tzinfo=zone, fold=fold).utcoffset()
        back = (local.replace(tzinfo=timezone.utc) - off).astimezone(zone).replace(tzinfo=None)
        if back == local and int(off.total_seconds()) not in found:
            found.append(int(off.total_seconds()))
    return tuple(found)


def local_to_utc(seconds: int, name: str) -> int | None:
    """UTC seconds of a local wall clock; None where it is skipped or occurs twice.

    Zones change their offset on quarters of an hour, so one look-up serves a quarter.
    """
    offsets = _offset_at(name, seconds // 900)
    return seconds - offsets[0] if len(offsets) == 1 else None


@lru_cache(maxsize=50_000)
def _day(y: int, m: int, d: int) -> int | None:
    try:
        return (datetime(y, m, d) - _EPOCH).days
    except ValueError:
        return None


def read(text: str, tz: str | None) -> tuple[list[tuple[int, int | None, str]], str | None]:
    """All readings of a text as (format number, UTC seconds or None, state), and why none is."""
    out: list[tuple[int, int | None, str]] = []
    why = NO_FORMAT
    t = text.strip().strip("\x00").strip()
    for k, name in enumerate(NAMES):
        match = FORMATS[name].fullmatch(t)
        if not match:
            continue
        g = match.groupdict()
        if "n" in g:
            n = int(g["n"])
            out.append((k, n // {"count_s": 1, "count_ms": 1000, "count_us": 1_000_000}[name], RESOLVED))
            continue
        month = MONTHS.get(g["mon"][:3].casefold()) if g.get("mon") else int(g["m"])
        day = _day(int(g["y"]), month, int(g["d"])) if month else None
        h, i, s, ap = int(g["h"]), int(g["i"]), int(g["s"]), g.get("ap")
        if ap:
            h = -1 if not 1 <= h <= 12 else h % 12 + (12 if ap in "Pp" else 0)
        if day is None or not 0 <= h < 24 or i > 59 or s > 59:
            why = IMPOSSIBLE
            continue
        wall = day * 86400 + h * 3600 + i * 60 + s
        z = g.get("z")
        if z and z[0] in "+-":
            utc = wall - (1 if z[0] == "+" else -1) * (int(z[1:3]) * 3600 + int(z[-2:]) * 60)
            out.append((k, utc, RESOLVED))
        elif z and z in ABBREVIATIONS:
            out.append((k, int(wall - ABBREVIATIONS[z] * 3600), RESOLVED))
        else:
            name_of = z.strip("[]") if z else tz
            if name_of is None or _zone(name_of) is None:
                out.append((k, None, NO_ZONE))
            else:
                utc = local_to_utc(wall, name_of)
                out.append((k, utc, SKIPPED_OR_TWICE if utc is None else RESOLVED))
    return out, None if out else why


def mixture(marks: np.ndarray, counts: np.ndarray, order: str | None) -> np.ndarray:
    """EM over the format mixture of one source: the share of each format.

    :param marks: bit sets of the valid readings; ``counts``: rows with each.
    :param order: what the source says of its all-number dates (dmy, mdy, ymd) or None.
    """
    bits = (marks[:, None] >> np.arange(len(NAMES))) & 1
    prior = np.full(len(NAMES), FLOOR_ROWS)
    if order in _ALL_NUMBERS:
        prior[NAMES.index(order)] += max(1.0, PRIOR_SHARE * counts.sum())
    share = prior / prior.sum()
    for _ in range(ROUNDS):
        post = bits * share
        post = post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        share = prior + (post * counts[:, None]).sum(axis=0)
        share = share / share.sum()
    return share


def posteriors(marks: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each bit set of valid readings the posterior of each format, rows summing to 1."""
    post = ((marks[:, None] >> np.arange(len(NAMES))) & 1) * share
    return post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300)


#: Longer texts fit no format but for white space inside, and don't count in a mixture.
LONGEST = 100


def _classes(texts: DataFrame) -> DataFrame:
    """(_src, _text, _layout, _one, _two): what settles which formats a text can be read under, that is, its
    layout and whether its first two numbers can be a month or a day."""
    head = F.substring(F.col("_t"), 1, 8)
    first = F.regexp_extract(head, "^([0-9]{1,2})[^0-9]", 1)
    second = F.regexp_extract(head, "^[0-9]{1,2}[^0-9]+([0-9]{1,2})(?:[^0-9]|$)", 1)
    bucket = lambda n: F.when(n.isin("", "0", "00"), 0).when(F.length(n) == 1, 1).when(n < "13", 1).when(n < "32", 2).otherwise(3)
    layout = F.regexp_replace(F.translate("_t", "012345678", "999999999"), r"[\p{L}]+", "a")
    return texts.withColumn("_t", F.trim("_text")).select("_src", "_text", layout.alias("_layout"), first.alias("_a"), second.alias("_b")).select("_src", "_text", "_layout", bucket(F.col("_a")).alias("_one"), bucket(F.col("_b")).alias("_two"))


def _marks(texts: pd.Series) -> pd.Series:
    return pd.Series([sum(1 << k for k, _, _ in read(t, None)[0]) for t in texts], dtype="int32")


def shares_of(df: DataFrame, text: str, source: str, src: DataFrame) -> DataFrame:
    """(_src, _shares): the format mixture of each source.

    Texts are counted by layout, without Python, and one text of each layout is read; so what is
    shuffled and read is bounded by the layouts in use. A source is one group of at most 2^formats rows.
    """
    known = df.where((F.length(text) <= LONGEST) & F.col(text).isNotNull()).select(F.col(source).alias("_src"), F.col(text).alias("_text"))
    classes = _classes(known).groupBy("_src", "_layout", "_one", "_two").agg(F.count("*").alias("_n"), F.min("_text").alias("_text"))
    counts = classes.withColumn("_marks", F.pandas_udf(_marks, "int")("_text")).groupBy("_src", "_marks").agg(F.sum("_n").alias("_n"))
    counts = counts.join(src.select(F.col(source).alias("_s"), "_order"), F.col("_src") == F.col("_s"), "left").drop("_s")

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        share = mixture(pdf["_marks"].to_numpy(dtype="int64"), pdf["_n"].to_numpy(dtype="float64"), pdf["_order"].iloc[0])
        return pd.DataFrame({"_src": [pdf["_src"].iloc[0]], "_shares": [share.tolist()]})

    return counts.groupBy("_src").applyInPandas(em, f"_src {df.schema[source].dataType.simpleString()}, _shares array<double>")


MOMENT = "s long, format string, state string, posterior double"


def _settle(text: str | None, tz: str | None, shares: np.ndarray | None) -> tuple:
    """(UTC seconds, format, state, posterior) of a text under its source's mixture."""
    if text is None:
        return None, None, NO_FORMAT, 0.0
    found, why = read(text, tz)
    if not found:
        return None, None, why, 0.0
    weight = [float(shares[k]) if shares is not None else 1.0 for k, _, _ in found]
    best = max(range(len(found)), key=lambda i: (weight[i], -i))
    k, utc, state = found[best]
    sure = weight[best] / sum(weight)
    if len({u for _, u, _ in found}) > 1 and sure < SURE:  # readings that agree on the moment leave nothing open
        return None, NAMES[k], AMBIGUOUS, sure
    return utc, NAMES[k], state, sure


def _settle_udf():
    memo: dict = {}

    def run(text: pd.Series, tz: pd.Series, shares: pd.Series) -> pd.DataFrame:
        if len(memo) > 200_000:
            memo.clear()
        out = []
        for t, z, w in zip(text, tz, shares):
            key = (t, z, None if w is None else w.tobytes())
            hit = memo.get(key)
            if hit is None:
                hit = _settle(t, z, w)
                if t is None or len(t) < 200:
                    memo[key] = hit
            out.append(hit)
        pdf = pd.DataFrame(out, columns=["s", "format", "state", "posterior"])
        return pdf.assign(s=pd.array([h[0] for h in out], dtype="Int64"))

    return F.pandas_udf(run, MOMENT)


def normalise_moments(df: DataFrame, text: str, source: str, sources: DataFrame, to: str = "moment") -> DataFrame:
    """Add struct column ``to`` (utc TIMESTAMP_NTZ-like seconds ``s``, format, state, posterior).

    :param sources: one row per source with columns ``source``'s name, tz and date_order; a source
        that isn't listed, or a null one, has no zone and no stated order.
    Null and empty texts give a null moment with state ``no_format``; an ambiguous text one with
    state ``ambiguous``. Rows are neither dropped nor merged. Each text is read once; its source's
    zone and mixture are broadcast up to ``session.BROADCAST_ROWS`` sources and shuffled beyond.
    """
    src = sources.groupBy(source).agg(F.first("tz").alias("_tz"), F.first("date_order").alias("_order"))
    per = shares_of(df, text, source, src)
    tz = src.select(F.col(source).alias("_s"), "_tz")
    per = sized(per.join(tz, F.col("_src") == F.col("_s"), "left").drop("_s"))
    joined = df.join(per, df[source].eqNullSafe(per["_src"]), "left")
    return joined.withColumn(to, _settle_udf()(F.col(text), F.col("_tz"), F.col("_shares"))).drop("_src", "_tz", "_shares")
