"""From raw documents to encoded, mixed training text: the stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrion.llm import common, exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(held: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of a stored table whose `row` is in `rows`, once for each time it is there. Null ids, ties, repeated
    rows and empty tables need no care: rows are told apart by their stored number alone."""
    return held.join(rows.select("row"), "row").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no language (null, or without a letter) go; lang becomes the predicted one where null."""
    net = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = language_id.identify(docs.select(*COLUMNS), net).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays (null text counts as empty)."""
    held = common.numbered(docs, *COLUMNS)
    return _keep(held, exact_dedup.exact_dedup(held, "row").where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup (SimHash, then the pairs it can't reach; 5-word shingles, Jaccard similarity of 0.8 or more): of each
    group the document with the smallest doc_id stays; documents without an id take no part."""
    held = common.numbered(docs, *COLUMNS)
    found = near_dedup.near_rows(held.where("doc_id is not null").select("row", "text"))
    members = common.cut(found.join(held.select("row", "doc_id"), "row"))
    first = members.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    gone = members.select("row").join(first, "row", "left_anti")
    return held.join(gone, "row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it (one that is in service when the budget ends counts as taken;
    documents without a word are never taken)."""
    held = common.numbered(docs, *COLUMNS)
    found = mixing.mix(held, row="row").where("taken > 0")
    turns = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long")))
    return _keep(held, found.select("row", turns.alias("turn")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the ids of each document, the pipeline's training text, and whether they decode to it."""
    return sentencepiece_codec.encode_decode(docs, sentencepiece_codec.public_model(), with_ids=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
#: Language and encoding can't be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again, and the one before it
    is removed."""
    docs, last = common.table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        docs, out = common.stored_at(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            common.drop(spark, last)
        last = out
    return docs
