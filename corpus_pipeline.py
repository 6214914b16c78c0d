"""A corpus pipeline: STAGES in order, each stage's result written as Parquet and reread as the next one's input.

Columns that stages don't know pass through all but the last. An empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwise.llm.common import drop_path, free_name, materialise, read_table, row_key, work_dir
from weftwise.llm.near_dup import near_duplicates
from weftwise.llm.packing import pack_documents
from weftwise.llm.pii import replace_entities
from weftwise.llm.quality import keep_good
from weftwise.llm.queries import SURROGATE_KEY, vocabulary_path
from weftwise.llm.repeats import remove_repeats

def _with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` in the columns of ``before``, with ``n_chars``, if there is one, counted anew (null for a null text)."""
    out = after.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in before.columns else after
    return out.select(before.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null and empty texts are among them."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest id (and lowest hash of its text).

    Repeated rows (equal id and text) become one; rows that share an id but not a text are judged each by its
    own text. Rows without an id or without words stay.
    """
    found = materialise(near_duplicates(docs).select("doc_id", "text_hash", "stays"), f"{work_dir(spark)}/found")
    key = free_name(docs, "text_hash")
    gone = found.filter("not stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    _, th = row_key(docs["doc_id"], docs["text"])
    keyed = docs.withColumn(key, th)
    out = keyed.join(gone, (keyed["doc_id"] == gone["__id"]) & (keyed[key] == gone["__hash"]), "left_anti")
    named = found.filter("stays and doc_id is not null")
    if not named.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        out = out.filter("doc_id is not null").dropDuplicates(["doc_id", key]).unionByName(out.filter("doc_id is null"))
    return out.select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand more than once leave every text; null texts come out empty."""
    return _with_length(docs, remove_repeats(docs, length=200))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; nulls stay null."""
    return _with_length(docs, replace_entities(docs, SURROGATE_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as pieces of token sequences; a null text is the separator alone."""
    return pack_documents(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("pii_surrogates", pii_surrogates), ("packing", packing)]

#: Token ids and the components of near copies can't be had from SQL; tests compare with a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table goes when the next one's is written."""
    docs, work = read_table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{work}/{k}")
        if k:
            drop_path(spark, f"{work}/{k - 1}")
    return docs
