"""Line deduplication with a log-template tree.

Lines are parsed by a tree of fixed depth: the number of tokens, then the leading tokens (tokens with a digit count
as variable fields, unless they are half of the line). In a leaf, tokens are judged by how many texts hold them at
their position, relative to the other tokens of the line: those as frequent as the share ``constant`` of the line's
tokens (fields by a digit left out) are its constants, any other is a variable field, so that it doesn't matter how often a field's values recur
by themselves in large data; a line's template is its constants in place. Templates that recur in enough different
texts are dropped from all documents but the first that holds them (the smallest id, then the first such
line), so that nothing said only in boilerplate is lost. Equal texts count once, so copies of a whole document are
left to document deduplication.

How often is enough depends on length: a template of n tokens must be in at least ``texts`` different texts and in so
many that n times their number reaches ``weight``; templates of ``long`` tokens or more recur from two texts on. Lines of
every length are taken, short ones need more texts by ``weight`` (60 of one token, 30 of two); lines of fewer than
``shortest`` tokens stay.

Only lines of leaves that hold enough texts leave the scan (told by a bit table of fixed size; leaves that get in by
chance fail the exact counts later). Counting is by distinct line, aggregated before every shuffle.

Defined results: null text counts as empty and stays null; blank lines stay; a text that loses all its lines that
aren't blank is empty; rows that repeat an id and a text are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, materialize, release, table, text_of, trim
from .words import hashes, mix, slices, tokens

LEADING, TEXTS, WEIGHT, SHORTEST, CONSTANT, LONG, PAIR = 3, 3, 60, 1, 0.6, 50, 2
ANY = np.uint64(0x2A)
BITS = 26


def lines_of(texts: pa.Array, leading: int, shortest: int, long: int = LONG):
    """Per line of at least ``shortest`` tokens: number of its text, of the line in it, tokens, hash of leaf (whose lowest bit
    tells lines of ``long`` tokens or more) and of line, and bounds into the token hashes."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    first = lists.offsets.to_numpy().astype(np.int64)
    first = first - first[0]
    bounds, index, words = tokens(lists.flatten())
    known = hashes(words)
    digits = pc.match_substring_regex(words, "[0-9]").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    n = np.diff(bounds)
    h, number = (known[index], digits[index]) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, bool))
    # Tokens with a digit are fields, but where most tokens are such, they are what the line says.
    share = np.diff(np.concatenate([[0], np.cumsum(number)])[bounds]) if len(h) else np.zeros(len(n))
    h[number & np.repeat(share * 2 < n, n)] = ANY
    line = np.arange(len(n))
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    keep = np.flatnonzero(n >= max(1, shortest))
    n, line, text, start = n[keep], line[keep] - first[text[keep]], text[keep], bounds[:-1][keep]
    leaf = mix(n.astype(np.uint64))
    for k in range(leading):
        leaf = np.where(n > k, mix(leaf * np.uint64(31) + h[np.minimum(start + k, max(0, len(h) - 1))]) if len(h) else leaf, leaf)
    leaf = (leaf & ~np.uint64(1)) | (n >= long).astype(np.uint64)
    at = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    placed = mix(h + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)])
    whole = mix(total[start + n] - total[start] + n.astype(np.uint64))
    return text, line, n, leaf, whole, start, h


def dropped_lines(docs: DataFrame, leading: int = LEADING, texts: int = TEXTS, weight: int = WEIGHT, shortest: int = SHORTEST, constant: float = CONSTANT, long: int = LONG) -> DataFrame:
    """docs(id, text, print) -> id, print (of the text), dropped: numbers of its lines that go."""
    spark = docs.sparkSession
    enough = lambda leaf: F.when(F.col(leaf).bitwiseAND(F.lit(1)) == 1, F.lit(min(PAIR, texts))).otherwise(F.lit(texts))

    def leaves(batches):
        for g in batches:
            at = 0
            for some in slices(g.column(1)):
                prints = g.column(2).slice(at, len(some)).to_numpy()
                at += len(some)
                text, _, _, leaf, _, _, _ = lines_of(some, leading, shortest, long)
                pairs = np.unique(np.stack([leaf.view(np.int64), prints[text]]), axis=1) if len(text) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["leaf", "print"])
        trim()

    full = docs.mapInArrow(leaves, "leaf long, print long").distinct().groupBy("leaf").count().where(F.col("count") >= enough("leaf"))
    cell = F.shiftrightunsigned("leaf", 64 - BITS)
    words = full.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))).alias("v"))
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for r in materialize(words, "line-leaves").toLocalIterator():  # at most 2**20 rows
        bits[r[0]] = r[1]
    shared = spark.sparkContext.broadcast(bits)

    def candidates(batches):
        for g in batches:
            at = 0
            for some in slices(g.column(1)):
                prints = g.column(2).slice(at, len(some)).to_numpy()
                text, line, n, leaf, whole, start, h = lines_of(some, leading, shortest, long)
                c = (leaf >> np.uint64(64 - BITS)).astype(np.int64)
                k = np.flatnonzero((shared.value[c >> 6] >> (c & 63)) & 1)
                raw = [h[s : s + m].tobytes() for s, m in zip(start[k], n[k], strict=True)]
                yield pa.RecordBatch.from_arrays([g.column(0).slice(at, len(some)).take(pa.array(text[k])), pa.array(prints[text[k]]), pa.array(line[k].astype(np.int32)), pa.array(leaf[k].view(np.int64)), pa.array(whole[k].view(np.int64)), pa.array(raw, pa.binary())], ["id", "print", "line", "leaf", "hash", "tokens"])
                at += len(some)
        trim()

    met = materialize(docs.mapInArrow(candidates, "id long, print long, line int, leaf long, hash long, tokens binary"), "line-candidates")
    release(spark)
    counts = met.select("leaf", "hash", "print").distinct().groupBy("leaf", "hash").agg(F.count("*").alias("texts"))
    distinct = met.select(F.col("hash").alias("h"), "tokens").dropDuplicates(["h"])
    kinds = materialize(counts.join(distinct, F.col("hash") == F.col("h")).select("leaf", "hash", "texts", "tokens"), "line-kinds")

    def places(batches):
        for g in batches:
            raw = g.column(3).to_pylist()
            n = np.array([len(x) // 8 for x in raw], np.int64)
            of = np.repeat(np.arange(len(raw)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            token = np.frombuffer(b"".join(raw), np.int64)
            known = np.flatnonzero(token.view(np.uint64) != ANY)
            of, at, token = of[known], at[known], token[known]
            m = np.bincount(of, minlength=len(raw))
            for k in range(0, len(of), 50_000):
                o = pa.array(of[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([g.column(0).take(o), g.column(1).take(o), g.column(2).take(o), pa.array(at[k : k + 50_000].astype(np.int32)), pa.array(token[k : k + 50_000]), pa.array(n).take(o), pa.array(m).take(o)], ["leaf", "hash", "texts", "at", "token", "n", "m"])

    # A line's constants are the tokens that at their place are as frequent as its ``constant`` share of tokens.
    spelt = kinds.mapInArrow(places, "leaf long, hash long, texts long, at int, token long, n long, m long")
    often = spelt.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("s")).where(F.col("s") >= enough("leaf"))
    often = often.select(F.col("leaf").alias("l"), F.col("at").alias("a"), F.col("token").alias("t"), "s")
    held = spelt.join(often, (F.col("leaf") == F.col("l")) & (F.col("at") == F.col("a")) & (F.col("token") == F.col("t")))
    made = held.groupBy("leaf", "hash").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("s", "at", "token")), False).alias("places"))
    made = made.withColumn("k", F.greatest(F.lit(1), F.ceil(F.lit(constant) * F.col("m") - 1e-9)).cast("int")).where(F.size("places") >= F.col("k"))
    made = made.withColumn("least", F.expr("places[k - 1].s"))
    made = made.withColumn("template", F.xxhash64("leaf", "n", F.expr("transform(filter(places, p -> p.s >= least), p -> struct(p.at, p.token))")))
    made = materialize(made.select(F.col("hash").alias("h"), "leaf", "n", "template"), "line-templates")
    uses = materialize(met.select("id", "print", "line", "hash").join(made, F.col("hash") == F.col("h")).select("id", "print", "line", "leaf", "n", "template"), "line-uses")
    recurring = uses.select("template", "leaf", "n", "print").distinct().groupBy("template").agg(F.count("*").alias("s"), F.first("leaf").alias("leaf"), F.first("n").alias("n"))
    recurring = recurring.where((F.col("s") >= enough("leaf")) & (F.col("s") * F.col("n") >= weight)).select(F.col("template").alias("u"))
    uses = materialize(uses.join(recurring, F.col("template") == F.col("u")).select("id", "print", "line", "template"), "line-gone")
    first = uses.groupBy("template").agg(F.min(F.struct("id", "line")).alias("f")).select(F.col("template").alias("u"), "f")
    first = materialize(first, "line-first")
    rest = uses.join(first, F.col("template") == F.col("u")).where(~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("line") == F.col("f.line"))))
    return rest.groupBy("id", "print").agg(F.collect_set("line").alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """All rows and columns of docs, with the text freed of recurring lines, and n_lines (lines that aren't blank) and
    n_dropped of them."""
    by_bytes(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("print"))
    drops = materialize(dropped_lines(own, **settings), "line-drops")
    release(docs.sparkSession)
    rows = docs.withColumn("__print", F.xxhash64(text_of(text_col)))
    drops = drops.select(F.col("id").alias("__id"), F.col("print").alias("__of"), F.col("dropped").alias("__dropped"))
    rows = rows.join(drops, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__of")), "left")
    # The split lines are a column of their own: within the lambda they would be split anew for every line that stays.
    rows = rows.withColumn("__lines", F.when(F.col("__dropped").isNotNull(), F.split(text_of(text_col), "\n", -1)))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__dropped")
    kept = F.concat_ws("\n", F.transform(rest, lambda k: F.get("__lines", k)))
    full = F.regexp_count(text_of(text_col), F.lit("[^\\x20\\x09-\\x0D][^\\n]*")).cast("long")
    rows = rows.withColumns({"__n": full, "__gone": F.coalesce(F.size("__dropped"), F.lit(0)).cast("long")})
    rows = rows.withColumn(text_col, F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(kept))
    return rows.select(*docs.columns, F.col("__n").alias("n_lines"), F.col("__gone").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")
