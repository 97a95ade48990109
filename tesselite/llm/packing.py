"""Packing documents into as few fixed-size sequences as possible by linear grouping and best fit.

The plan is made from the histogram of piece lengths, which has at most ``capacity`` entries whatever the
input: large lengths are cut into groups of equal cardinality and rounded up to the largest of their group;
configurations of the few sizes left are optimised as a linear programme by column generation and used in
whole numbers; actual lengths take the place of the rounded ones; what is left over and all small pieces
go by best fit, largest first, into the fullest sequence that has room. Sequences of equal contents are
planned together, so the plan is a list of runs of sequences. Pieces are numbered within their length
without ordering any length in one task, and looked up in the (broadcast) plan.

Defined results: null text counts as empty; an empty text is one piece (its end id); rows that share an id
are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import BROADCAST_ROWS, by_bytes, materialize, table, text_of, trim

#: Rows of one length that are numbered together.
NUMBERED = 2_000
#: Chunks that a worker's encoder remembers, and characters it handles at once.
MEMO, AT_ONCE = 400_000, 4_000_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents longer than capacity are
    cut; all their pieces but the first are full."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, enc = np.array([end_id], np.uint32), bpe.encoder(tokenizer, MEMO, AT_ONCE)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for name, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                raw = np.concatenate([data, end])
                n = len(raw)
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for k, stop in enumerate(stops):
                    for column, x in zip(out, (name, k, start, stop - start, zlib.crc32(raw[start:stop])), strict=True):
                        column.append(x)
                    start = stop
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    by_bytes(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_column(value: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, dict[int, int]]:
    """The configuration of sizes within capacity whose values sum highest (an unbounded knapsack)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g, s in enumerate(sizes):
        if value[g] <= 1e-12:
            continue
        for low in range(s, capacity + 1, s):  # each span only reads what the span before it has settled
            high = min(low + s, capacity + 1)
            new = best[low - s : high - s] + value[g]
            better = new > best[low:high] + 1e-12
            best[low:high][better] = new[better]
            pick[low:high][better] = g
    column: dict[int, int] = {}
    at = int(np.argmax(best))
    total = float(best[at])
    while pick[at] >= 0:
        g = int(pick[at])
        column[g] = column.get(g, 0) + 1
        at -= sizes[g]
    return total, column


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1000) -> list[tuple[dict[int, int], float]]:
    """Column generation for min sum x, A x >= demand: (configuration, how often), at most one per size."""
    n = len(sizes)
    columns = [{g: capacity // s} for g, s in enumerate(sizes)]
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    x = inverse @ np.array(demand, float)
    for k in range(rounds):
        if k % 50 == 49:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ np.array(demand, float), 0)
        worth, column = _best_column(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + 1e-4:  # within that of the optimum
            break
        a = np.zeros(n)
        for g, c in column.items():
            a[g] = c
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[:, out], columns[out] = a, column
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
    return [(c, float(v)) for c, v in zip(columns, x, strict=True) if v > 0]


class Plan:
    """Runs of sequences with equal contents; rows: (length, from, to, per_sequence, sequence, offset), where pieces
    numbered from..to-1 of a length go ``per_sequence`` to a sequence, beginning with ``sequence`` at ``offset``."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.taken: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free tokens: runs (first sequence, how many)

    def open(self, how_many: int) -> int:
        first, self.sequences = self.sequences, self.sequences + how_many
        return first

    def put(self, length: int, sequence: int, how_many: int, offset: int, each: int = 1) -> None:
        at = self.taken[length]
        self.taken[length] += how_many * each
        self.rows.append((length, at, at + how_many * each, each, sequence, offset))

    def leave(self, sequence: int, how_many: int, used: int) -> None:
        if used < self.capacity and how_many:
            self.room[self.capacity - used].append((sequence, how_many))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            free = min((r for r, runs in self.room.items() if r >= length and runs), default=0)
            if not free:
                each = self.capacity // length
                self.room[self.capacity].append((self.open(-(-count // each)), -(-count // each)))
                free = self.capacity
            first, many = self.room[free].pop()
            each, used = free // length, self.capacity - free
            full = min(many, count // each)
            if full:
                self.put(length, first, full, used, each)
                self.leave(first, full, used + each * length)
                count -= full * each
            first, many = first + full, many - full
            if count and many:  # one more sequence takes what is left
                self.put(length, first, 1, used, count)
                self.leave(first, 1, used + count * length)
                first, many, count = first + 1, many - 1, 0
            self.leave(first, many, used)


#: What counts as small, as shares of the capacity: the plan with the fewest sequences is taken. Where many
#: lengths can fill the room that rounding leaves, a high share wins; where lengths are few, a low one.
SMALL = (1 / 16, 1 / 4, 3 / 8, 1 / 2)


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = 64, shares: tuple[float, ...] = SMALL) -> Plan:
    """histogram: pieces by length."""
    return min((_plan(histogram, capacity, groups, int(capacity * x)) for x in shares), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> Plan:
    out = Plan(capacity)
    left = {s: c for s, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        out.put(capacity, out.open(full), full, 0)
    large = sorted((s for s in left if s > small), reverse=True)
    total = sum(left[s] for s in large)
    # Groups of equal cardinality, from the largest; a length may be shared by neighbours.
    queues: list[list[list[int]]] = []
    per, k = max(1, -(-total // groups)), 0
    for s in large:
        c = left[s]
        while c:
            if k % per == 0:
                queues.append([])
            take = min(c, per - k % per)
            queues[-1].append([s, take])
            c, k = c - take, k + take
    rounded: dict[int, list[list[list[int]]]] = defaultdict(list)
    for q in queues:
        rounded[q[0][0]].append(q)
    sizes = sorted(rounded, reverse=True)
    stock = [[run for q in rounded[s] for run in q] for s in sizes]
    demand = [sum(c for _, c in q) for q in stock]
    for column, times in configurations(sizes, demand, capacity) if sizes else []:
        times = min([int(times + 1e-6), *(sum(c for _, c in stock[g]) // k for g, k in column.items())])
        if times <= 0:
            continue
        slots = []
        for g in sorted(column):
            for _ in range(column[g]):
                runs, need = [], times
                while need:
                    s, c = stock[g][0]
                    take = min(c, need)
                    runs.append([s, take])
                    need -= take
                    stock[g][0][1] -= take
                    if not stock[g][0][1]:
                        stock[g].pop(0)
                slots.append(runs)
        first, done = out.open(times), 0
        while done < times:
            many = min(runs[0][1] for runs in slots)
            offset = 0
            for runs in slots:
                out.put(runs[0][0], first + done, many, offset)
                offset += runs[0][0]
                runs[0][1] -= many
                if not runs[0][1]:
                    runs.pop(0)
            out.leave(first + done, many, offset)
            done += many
    rest: dict[int, int] = defaultdict(int)
    for q in stock:
        for s, c in q:
            rest[s] += c
    for s in left:
        if s <= small:
            rest[s] += left[s]
    for s in sorted(rest, reverse=True):
        out.best_fit(s, rest[s])
    return out


def pack(cut: DataFrame, capacity: int = 1024, groups: int = 64, shares: tuple[float, ...] = SMALL) -> DataFrame:
    """Add sequence_id and offset to materialised pieces (see ``pieces``)."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    made = plan(histogram, capacity, groups, shares)
    spread = [(s, max(1, -(-c // NUMBERED))) for s, c in histogram.items()]
    salts = spark.createDataFrame(spread, "length long, salts long")
    rows = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    rows = rows.withColumn("own", own).join(counts, ["length", "salt"]).withColumn("number", F.col("base") + F.col("own"))
    steps = spark.createDataFrame(made.rows, "length long, from long, to long, each long, first long, at long")
    if len(made.rows) <= BROADCAST_ROWS:
        steps = F.broadcast(steps)
    steps = steps.withColumnRenamed("length", "of")
    found = rows.join(steps, (F.col("length") == F.col("of")) & (F.col("number") >= F.col("from")) & (F.col("number") < F.col("to")))
    k = F.col("number") - F.col("from")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, **settings) -> DataFrame:
    return pack(materialize(pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer), "pieces"), capacity, **settings)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
