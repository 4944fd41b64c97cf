"""Problem 7: mixing sources to target weights of all tokens.

A curriculum: each source has a weight that changes linearly over the training run and whose
integral is its target share. The documents of a source, in random order and repeated as often as
needed, fill its cumulative token demand; inverting that demand gives each copy its position in the
run, and a sort by range on the position puts the mix in training order.
"""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Default place of the tokenizer's ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How far a weight leans over the run: 0 keeps it flat, 1 lets it start from or end at nothing.
TILT = 0.5
#: Copies of one source that are placed by one task at most, on average. Buckets follow from it.
IN_BUCKET = 50_000


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a public byte-level tokenizer, read from its file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer(ranks: dict[bytes, int]):
    """The tokenizer of these ranks."""
    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(spark: SparkSession, path: str = TOKENIZER):
    """Column function text -> tokens; a null text has none. Only the driver reads the file: the ranks
    (some 50,000) are broadcast."""
    shared = spark.sparkContext.broadcast(ranks_of(path))
    state: dict = {}

    def run(texts: pd.Series) -> pd.Series:
        if "enc" not in state:
            state["enc"] = tokenizer(shared.value)
        enc = state["enc"]
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> list[dict]:
    """What each source gives: (source, share, tokens wanted, lean) for the largest mix that fits.

    Sources without tokens give nothing; the others share their part in proportion to their targets.
    The total is the largest at which no source is needed more than ``max_repeats`` times.
    Leans alternate and are balanced, so that at each moment the weights add up to 1.
    """
    usable = [(s, t, r) for s, t, r in targets if s is not None and sizes.get(s, 0) > 0 and t and t > 0 and r and r > 0]
    whole = sum(t for _, t, _ in usable)
    if not usable:
        return []
    limit = min(sizes[s] * r / (t / whole) for s, t, r in usable)
    total = int(limit if total is None else min(limit, total))
    early = sorted((s for s, _, _ in usable), key=lambda s: (-sizes[s], s))[: (len(usable) + 1) // 2]
    part = sum(t for s, t, _ in usable if s in early) / whole
    out = []
    for s, t, r in sorted(usable):
        lean = 0.0 if len(usable) == 1 else (-TILT * min(1, (1 - part) / part) if s in early else TILT * min(1, part / (1 - part)))
        out.append({"source": s, "share": t / whole, "want": t / whole * total, "lean": lean, "repeats": r, "size": sizes[s]})
    return out


def position(share_done: F.Column, lean: F.Column) -> F.Column:
    """Where in [0, 1] a source has met a share of its demand.

    With weight s(1 + a(2t - 1)) the demand met at t is (1 - a)t + a t^2; this is its inverse.
    """
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share_done))
    root = (-(1 - lean) + F.sqrt((1 - lean) * (1 - lean) + 4 * lean * q)) / (2 * lean)
    return F.when(F.abs(lean) < 1e-9, q).otherwise(root)


def with_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens), one row per document; repeated rows of a document count once.

    Tokens are counted where the texts lie; ids, sources and counts are all that is shuffled. Of rows
    of one id that differ, the first source and then the smallest count stand.
    """
    counted = documents.where("doc_id is not null").select("doc_id", "source", token_count(documents.sparkSession, path)(F.col("text")).alias("n_tokens"))
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")


def mix(counted: DataFrame, targets: DataFrame, total: int | None = None, in_bucket: int = IN_BUCKET) -> DataFrame:
    """(doc_id, source, copy, n_tokens, position, token_start): the mix in training order."""
    out = placed(counted, targets, total, in_bucket)
    return out.repartitionByRange(F.col("position"), F.col("doc_id"), F.col("copy")).sortWithinPartitions("position", "doc_id", "copy")


def placed(counted: DataFrame, targets: DataFrame, total: int | None = None, in_bucket: int = IN_BUCKET) -> DataFrame:
    """The rows of ``mix`` in no order.

    Documents of sources without a target, of a null source or without tokens are left out, as the
    mix has no part for them. A source gives whole documents, so it misses its share by less than
    one document. No window runs over a whole source: copies are summed per bucket of a source and
    turn, the sums of the few buckets are accumulated, and documents only within their bucket.
    """
    known = counted.where("source is not null and n_tokens > 0")
    found = known.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).join(F.broadcast(targets.select("source")), "source", "left_semi").collect()
    sizes = {r["source"]: int(r["n"]) for r in found}
    buckets = 16 + max((r["docs"] for r in found), default=0) // in_bucket
    steps = plan(sizes, [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()], total)
    spark = counted.sparkSession
    given = spark.createDataFrame([(s["source"], float(s["want"]), float(s["lean"]), math.ceil(s["want"] / s["size"])) for s in steps], "source string, want double, lean double, turns int")
    copies = (
        known.join(F.broadcast(given), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("turns"))))
        .withColumn("draw", F.xxhash64("doc_id", "copy"))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 20), F.lit(buckets).cast("long")).cast("int"))
    )
    sums = copies.groupBy("source", "copy", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    turn = Window.partitionBy("source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(turn), F.lit(0))).select("source", "copy", "bucket", "before")
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        copies.join(starts, ["source", "copy", "bucket"])
        .withColumn("token_start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where(F.col("token_start") + F.col("n_tokens") / 2 <= F.col("want"))
        .withColumn("position", position((F.col("token_start") + F.col("n_tokens") / 2) / F.col("want"), F.col("lean")))
    )
    return rows.select("doc_id", "source", "copy", "n_tokens", "position", "token_start")


def report(mixed: DataFrame, targets: DataFrame, counted: DataFrame) -> DataFrame:
    """Per target source: documents and tokens at hand, tokens mixed, most copies, target and actual share.

    A target source without documents has an actual share of 0.
    """
    have = counted.where("source is not null and n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    got = mixed.groupBy("source").agg(F.count("*").alias("n_copies"), F.sum("n_tokens").alias("mixed_tokens"), F.max("copy").alias("most_copies"))
    per = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(got, "source", "left").fillna(0, ["n_docs", "n_tokens", "n_copies", "mixed_tokens", "most_copies"])
    return per.withColumn("actual_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(1)))
