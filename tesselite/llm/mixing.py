"""Mixing sources to target weights by capped water-filling.

Targets share the total by weight; a source stops at ``max_epochs`` times its own size and its excess is
reshared by weight among the rest until none is above its cap. Because sources reach their cap in the order
of cap / weight, the fixed point is found with two running sums over the per-source table.

A source then gives floor(target / size) whole repetitions of every document and, for the rest, a seeded
sample without replacement: documents in the order of a seeded hash of their id until the rest is used up;
the one document on the border is taken in part, so a source misses its target by less than one word. The
border is found by three histogram passes of 1,024 cells each, so no source is ever ordered in one task.

Defined results: null text has size 0; null source is a source of its own, last; documents of size 0 are
taken with 0 words, by ``sample`` as often as their source is repeated but once at least; repeated rows count separately; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, materialize, table, text_of

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(column):
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target. One row per source goes through one task."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(whole), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "w_all": F.sum("w").over(whole)})
    # The level if exactly the sources before this one are capped; the first that it does not cap ends the search.
    s = s.withColumns({"level": (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")), "at": F.row_number().over(order)})
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))
    s = s.withColumn("free", F.min(free).over(whole))
    capped = F.col("free").isNull() | (F.col("at") < F.col("free.at"))
    return s.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("free.level") * F.col("w")).alias("target"))


def _cell(id_col: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))


def _key(source_col: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def goals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per source: key, source_size, target, repetitions, rest (words of the fractional repetition), border
    (the hash cell in which the running sum of sizes passes the rest) and base (the sum before it)."""
    rows = docs.select(_cell(id_col, seed).alias("h"), _key(source_col).alias("key"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"))
    rows = materialize(rows, "mix-sizes")
    goal = targets(rows.groupBy("source", "key").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("key", _key("source")).drop("source")
    reps = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("repetitions", reps).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("repetitions") * F.col("source_size"))
    goal = materialize(goal.withColumns({"border": F.lit(0).cast("long"), "base": F.lit(0).cast("long")}), "mix-goal")
    n = goal.count()
    for shift in (20, 10, 0):
        at = attach(rows, goal.where("rest > 0").select("key", "border", "base", "rest"), ["key"], "inner", n)
        cells = at.where(F.shiftright("h", shift + 10) == F.shiftright("border", shift + 10)) if shift < 20 else at
        cells = cells.groupBy("key", F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("in"), F.first("base").alias("base"), F.first("rest").alias("rest"))
        up_to = F.col("base") + F.sum("in").over(Window.partitionBy("key").orderBy("cell"))
        cells = cells.withColumn("up_to", up_to).where("up_to >= rest")
        found = cells.groupBy("key").agg(F.min(F.struct("cell", (F.col("up_to") - F.col("in")).alias("base"))).alias("x"))
        found = found.select("key", F.expr(f"shiftleft(x.cell, {shift})").alias("border"), "x.base")
        goal = materialize(goal.drop("border", "base").join(found, "key", "left"), "mix-goal")
    return goal


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """All rows and columns of docs and: mix_size, mix_source_size, mix_target, mix_repetitions (whole), mix_extra (words
    of the fractional repetition), mix_taken = mix_size * mix_repetitions + mix_extra."""
    goal = goals(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    goal = goal.select("key", *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "repetitions", "rest", "border", "base")]).withColumnRenamed("key", "__key")
    rows = docs.withColumns({"__key": _key(source_col), "__h": _cell(id_col, seed), "__size": word_count(text_of(text_col))})
    rows = attach(rows, goal, ["__key"], "inner")
    # Only rows in the border cell of their source (one of 2**30) are ordered.
    edge = F.coalesce((F.col("__h") == F.col("__border")) & (F.col("__rest") > 0), F.lit(False))
    far = rows.where(~edge).withColumn("__extra", F.when((F.col("__rest") > 0) & (F.col("__h") < F.col("__border")), F.col("__size")).otherwise(0))
    order = Window.partitionBy("__key").orderBy(id_col, "__size", F.xxhash64(text_col)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__base") - F.coalesce(F.sum("__size").over(order), F.lit(0))
    near = rows.where(edge).withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), left)))
    out = far.unionByName(near)
    made = {f"mix_{n}": f"__{n}" for n in ("size", "source_size", "target", "repetitions", "extra")}
    return out.select(*docs.columns, *[F.col(c).alias(name) for name, c in made.items()], (F.col("__size") * F.col("__repetitions") + F.col("__extra")).cast("long").alias("mix_taken"))


def _cut(text, words):
    """The text up to the end of its word of that number."""
    plain = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1)
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s, w):
        n = s["n"] + F.when(w != "", 1).otherwise(0)
        stop = s["at"] + F.char_length(w)
        return F.struct(n.cast("long").alias("n"), (stop + 1).alias("at"), F.when((w != "") & (n <= words), stop).otherwise(s["end"]).alias("end"))

    return F.substring(text, F.lit(1), F.aggregate(plain, begin, step, lambda s: s["end"]))


def sample(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs: every row as often as it is taken whole, and the row on the border of
    its source once more up to the words that are taken of it. The text is cut only there."""
    mixed = mix(docs, **settings)
    text = settings.get("text_col", "text")
    full = F.col("mix_repetitions") + F.when((F.col("mix_extra") == F.col("mix_size")) & (F.col("mix_size") > 0), 1).otherwise(0)
    full = F.when(F.col("mix_size") == 0, F.greatest(F.lit(1), full)).otherwise(full).cast("long")
    part = (F.col("mix_extra") > 0) & (F.col("mix_extra") < F.col("mix_size"))
    rows = mixed.withColumn("__full", full).withColumn("__n", F.col("__full") + F.when(part, 1).otherwise(0))
    rows = rows.where("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return rows.withColumn(text, F.when(F.col("__k") > F.col("__full"), _cut(F.col(text), F.col("mix_extra"))).otherwise(F.col(text))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", *[F.col(f"mix_{n}").alias(n) for n in ("size", "source_size", "target", "taken")])
