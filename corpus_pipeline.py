"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of ``documents``; n_chars follows the text.

Defined results: null texts count as empty and are kept by all filtering stages; documents of which only recurring lines
were left go; rows with a null id are judged by their text like any other and never count as a near copy that goes; of
rows that share an id, each is judged by its own text; equal rows stay or go together; further columns are carried
along (clashing names don't matter) up to packing, which returns its own columns; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.llm import jaccard, line_dedup, mixing, packing, toxicity
from tesselite.llm.common import BROADCAST_ROWS, by_bytes, materialize, table, text_of

#: Documents that score this or more are rejected.
TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    by_bytes(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(spark, model) < TOXIC)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts freed of lines whose template recurs; documents of which nothing is left go."""
    freed = line_dedup.line_dedup(docs)
    gone = (F.col("n_dropped") > 0) & (F.col("n_dropped") >= F.col("n_lines"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        freed = freed.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return freed.where(~gone).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id.
    Rows that share an id and a text stay or go together; rows that share an id only are told apart."""
    found = jaccard.jaccard_join(docs, width=5, percent=80)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct()
    n = gone.count()
    gone = F.broadcast(gone) if n <= BROADCAST_ROWS else gone
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(text_of("text")) == F.col("__print")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated and sampled to their targets."""
    taken = mixing.sample(docs)
    if "n_chars" not in docs.columns:
        return taken
    return taken.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_recurring_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, the template tree or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
