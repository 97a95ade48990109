"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by length; those whose length recurs are grouped by length and a hash of a prefix; and the full text is
hashed only for rows whose (length, prefix) group has more than one member. What survives a round is handed to the next
as a bit table of fixed size, so that neither texts nor an unbounded key list are shuffled or broadcast; a
false hit costs one more hash and nothing else, because the last grouping is by the full hash. Many rows of one group
(a third of all may be copies of one text) are counted before any shuffle, and get the group's result by a broadcast of
counted size, or salted.

Defined results: null text counts as empty; empty texts form one group; of repeated rows with one id, each
row is reported; a null id never wins unless the group has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, table, text_of

#: The bit table has 2**BITS bits in rows of 64: at most 131,072 rows of 16 bytes, whatever the input.
BITS = 23
#: Groups of more rows than SALTED are dealt over tasks, in at most SALTS parts.
SALTED, SALTS = 100_000, 10_000


def _bit(*keys):
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << BITS))
    return F.shiftright(h, 6).alias("word"), (h % 64).cast("int")


def _bits(groups: DataFrame, *keys: str) -> DataFrame:
    """The bit table of the groups' keys."""
    word, bit = _bit(*keys)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return groups.select(word, one.alias("v")).groupBy("word").agg(F.bit_or("v").alias("bits"))


def _met(rows: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """rows with ``again``: whether the bit of their keys is set."""
    word, bit = _bit(*keys)
    told = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word", "left")
    again = F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1)) == 1
    return told.withColumn("again", F.coalesce(again, F.lit(False))).drop("word", "bit", "bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id (largest id of equal texts), group_size, kept, text_sha256.

    text_sha256 is null for rows that the refinement already proved unique, unless digest_all is set.
    ``kept`` marks exactly one id per group (all its rows, if that id is repeated).
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("len", F.octet_length("text"))
    pre = F.xxhash64(F.substring("text", 1, prefix))
    # Round 1: lengths. Round 2: prefixes of texts whose length recurs. Only keys leave these scans.
    lengths = _bits(rows.groupBy("len").count().where("count > 1"), "len")
    keyed = _met(rows, lengths, "len").where("again").select("len", pre.alias("pre"))
    groups = keyed.groupBy("len", "pre").count().where("count > 1")
    # Round 3: this scan reads on only where the bit of length and prefix is set.
    probe = _met(rows.withColumn("pre", pre), _bits(groups, "len", "pre"), "len", "pre")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    hashed = probe.select("id", "len", "again", (digest if digest_all else F.when(F.col("again"), digest)).alias("sha"))
    hashed = materialize(hashed, "exact-dedup")
    same = hashed.where("again").groupBy("len", "sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    same = materialize(same.select(F.col("sha").alias("of"), "keep_id", "group_size"), "exact-dedup-groups")
    alone = hashed.where(~F.col("again")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    met = hashed.where("again")
    if same.count() <= BROADCAST_ROWS:
        met = met.join(F.broadcast(same), F.col("sha") == F.col("of"), "left")
    else:  # rows of large groups are dealt by a salt, too; the groups that are so large are few
        salts = F.least(F.lit(SALTS), F.ceil(F.col("group_size") / SALTED)).cast("int")
        large = same.where(F.col("group_size") > SALTED).select(F.col("of").alias("big"), salts.alias("salts"))
        met = met.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, F.col("sha") == F.col("big"), "left")
        met = met.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
        dealt = same.withColumn("at", F.explode(F.sequence(F.lit(0), F.when(F.col("group_size") > SALTED, salts).otherwise(1) - 1)))
        met = met.join(dealt, (F.col("sha") == F.col("of")) & (F.col("salt") == F.col("at")), "left")
    met = met.select("id", "sha", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    return alone.unionByName(met).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
