"""Queries of problems 1, 2, 5, 6, 7 and 8."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, spread, table
from .canonical import has_sign, map_values
from .leakage import find_leaks
from .lookalike import consistent
from .mixing import mix, placed, report, with_tokens
from .mojibake import mend_text, pair_model
from .toxicity import THRESHOLD, fit_on, rates, score_posts


COMMENTS = (("raw_jpeg", "image_id", "comments"), ("mkv_simple_tag", "simple_tag_id", "tag_value"), ("mkv_info", "file_id", "writing_app"))
#: Ids of records sent again that are broadcast (8 bytes each); more are joined by shuffle.
AGAIN_IDS = 1_000_000


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_table, rec_id, text) of all records of problem 1 as they were sent; raw_jpeg's texts are arrays."""
    each = [table(spark, sf_dir, name).select(F.lit(name).alias("rec_table"), F.col(key).alias("rec_id"), (F.col(column) if name == "raw_jpeg" else F.array(column)).alias("texts")) for name, key, column in COMMENTS]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.explode("texts")).drop("texts").where("text is not null")


def _mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged texts. Every record counts once in the model, however often it was sent: all rows count,
    those of records sent again are taken off, and one of each is put in. So ids are shuffled, and of
    texts only those sent again."""
    rows = _comments(spark, sf_dir)
    again = rows.groupBy("rec_table", "rec_id").count().where("count > 1").select("rec_table", "rec_id").persist(StorageLevel.MEMORY_AND_DISK)
    few = again.count() <= AGAIN_IDS
    twice = rows.join(F.broadcast(again) if few else again, ["rec_table", "rec_id"], "left_semi")
    weighted = rows.withColumn("n", F.lit(1)).unionByName(twice.withColumn("n", F.lit(-1))).unionByName(twice.dropDuplicates(["rec_table", "rec_id"]).withColumn("n", F.lit(1)))
    model = pair_model(_texts(weighted), "text", "n")
    again.unpersist()
    return mend_text(_texts(rows), "text", model).where("mend.damaged")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with text damaged by a wrong decoding."""
    return _mended(spark, sf_dir).select("rec_table", "rec_id").distinct()


def p1_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged text with the original as far as it can be had back."""
    return _mended(spark, sf_dir).select("rec_table", "rec_id", "text", F.col("mend.mended").alias("mended"), F.col("mend.how").alias("how")).distinct()


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    exif = table(spark, sf_dir, "exif_tag").where(F.col("tag_name").isin("Make", "Model")).select(F.lit("exif_tag").alias("rec_table"), F.col("exif_row_id").alias("rec_id"), "text")
    keys = table(spark, sf_dir, "mkv_simple_tag").select(F.lit("mkv_simple_tag").alias("rec_table"), F.col("simple_tag_id").alias("rec_id"), F.col("tag_key").alias("text"))
    return exif.unionByName(keys).where("text is not null")


#: Canonical entries that travel to the workers with the transducer; more are refused.
MOST_ENTRIES = 100_000


def _consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [r[0] for r in table(spark, sf_dir, "canon_ref").where("entry_name is not null").select("entry_name").distinct().limit(MOST_ENTRIES + 1).collect()]
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} canonical entries")
    return consistent(_names(spark, sf_dir), "text", sorted(entries))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text is shown like a plain spelling but isn't that spelling."""
    return _consistent(spark, sf_dir).where("consistent <> text").select("rec_table", "rec_id").distinct()


def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the consistent form of its text."""
    return _consistent(spark, sf_dir).groupBy("rec_table", "rec_id").agg(F.first("text").alias("text"), F.first("consistent").alias("consistent"))


def _mapped(spark: SparkSession, sf_dir: str, tree_only: bool = False) -> DataFrame:
    refs = table(spark, sf_dir, "canon_ref")
    exif = table(spark, sf_dir, "exif_tag").where(F.col("tag_name").isin("Make", "Model")).select(F.lit("exif_tag").alias("rec_table"), F.col("exif_row_id").alias("rec_id"), F.col("tag_name").alias("field_name"), "text")
    apps = table(spark, sf_dir, "mkv_info").select(F.lit("mkv_info").alias("rec_table"), F.col("file_id").alias("rec_id"), F.lit("muxing_app").alias("field_name"), F.col("muxing_app").alias("text"))
    rows = exif.unionByName(apps).where(has_sign(F.col("text")))
    exact = refs.where("entry_name is not null").select("field_name", F.col("entry_name").alias("text")).distinct()
    return map_values(rows.join(exact, ["field_name", "text"], "left_anti"), F.col("field_name"), F.col("text"), refs, tree_only=tree_only)


def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree alone: records whose text isn't an entry as it stands, with the nearest entry that a span
    of its words is in reach of, or 0, and its distance."""
    return _mapped(spark, sf_dir, tree_only=True).select("rec_table", "rec_id", "match.ref_id", "match.distance").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text isn't an entry as it stands, with the entry meant or 0."""
    return _mapped(spark, sf_dir).select("rec_table", "rec_id", F.col("match.ref_id").alias("ref_id")).distinct()


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that mean no entry, with the number of records that have them."""
    return _mapped(spark, sf_dir).where("match.ref_id = 0").select("field_name", "text", "rec_table", "rec_id").distinct().groupBy("field_name", "text").agg(F.count("*").alias("n_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a post and a test item it leaks."""
    return find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of posts that leak it and the longest stretch leaked."""
    leaks = find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_item"))
    per = leaks.groupBy("item_id").agg(F.count("*").alias("n_posts"), F.max("n_words").alias("most_words"))
    items = table(spark, sf_dir, "eval_item").select("item_id", "topic").distinct()
    return items.join(per, "item_id", "left").fillna(0, ["n_posts", "most_words"])


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(with_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order: every copy of every post in it with its position."""
    return mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every board of the mix."""
    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_target")
    return report(placed(counted, targets), targets, counted)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_posts(spread(documents.select("doc_id", "source", "text")), "text", fit_on(documents, table(spark, sf_dir, "post_rating"))).drop("text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with abusive, hateful or sexual content."""
    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with its score."""
    return _scored(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of reported posts per board."""
    return rates(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_mended, p2_found, p2_consistent, p5_method, p5_found, p5_unmatched, p6_found, p6_items, p7_mix, p7_report, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {}
