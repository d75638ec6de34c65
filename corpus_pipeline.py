"""The corpus pipeline: language, near duplicates, repeated passages, mix, packing.

Each stage gets what the one before wrote and returns a DataFrame; all but the last return the columns of documents.
Ids may be null or occur more than once: stages that decide on rows give them a key of their own first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, langid, mixing, packing, queries, suffix, tokens
from lodestone.llm.common import cut, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, written once so that it stays the same."""
    return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language that was learned: a text that is null or has no letter."""
    found = langid.identify(docs.select(*COLUMNS), queries.lang_model(docs))
    return found.filter("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links at a similarity of 0.8 over five-word shingles: that of least id, nulls last.

    Rows of one id and different texts are in groups by their texts; repeated rows are in one. Rows without shingles all stay.
    """
    rows = _keyed(docs)
    found = cut(jaccard.jaccard_groups(rows, id_col="row_key", k=5, num=80, den=100).select(F.col("doc_id").alias("row_key"), "component_id"))
    many = cut(found.filter("component_id <> row_key").select("component_id").distinct())
    linked = found.join(small(many, 16), "component_id", "left_semi")
    linked = cut(rows.select("row_key", "doc_id").join(small(linked, 24), "row_key"))
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"].alias("row_key"))
    gone = cut(linked.select("row_key").join(small(cut(first.select("row_key")), 16), "row_key", "left_anti"))
    return rows.join(small(gone, 16), "row_key", "left_anti").select(*COLUMNS)


#: A repeated passage: bytes that repeat as strings of so many at least (51 words of three letters have more), and words in a run of them.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of more than 50 words that occur twice; a document that has nothing left goes. Repeated rows lose all, null texts go."""
    found = suffix.remove_repeats(docs, length=PASSAGE_BYTES, carry=("lang", "source"), keep="text", min_words=PASSAGE_WORDS).filter("n_bytes > n_removed")
    rows = found.select("doc_id", F.col("kept").alias("text"), "lang", "source")
    return rows.filter(r"text rlike '[^\\x20\\x09-\\x0D]'").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as its source's target weight asks, up to three times."""
    rows = _keyed(docs)
    copies = cut(mixing.mix_sources(rows, carry=("row_key",)).filter("copies > 0").select("row_key", "copies"))
    rows = rows.join(small(copies, 32), "row_key")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4,096 tokens."""
    return packing.pack(docs, tokens.default_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("pack", pack)]

#: The model of the first stage, the draws of the fourth and the tokenizer of the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
