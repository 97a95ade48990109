"""Approximate nearest neighbours by largest inner product, with an inverted multi-index.

Both halves of the vectors are quantised separately (k-means on a bounded sample); a vector's cell is its pair of
centroids. A query walks the pairs in order of summed distance (minus the inner product with each half's
centroid) with a heap until the cells it has met hold enough entries, and those are reranked by their exact
inner product in double precision. How many are enough is measured on sample vectors for a wanted recall.

Equal vectors are one entry of the index that knows its smallest ids, and equal queries are searched once, so
copies of one vector cost nothing extra. Entries are handed out by first centroid, in blocks of bounded size,
and the queries that visit a block in bounded lots.

Defined results: vectors that are null, zero, hold null or non-finite components or differ in length from most
take no part, neither as queries nor as candidates; ties go to the smaller id; of rows that repeat an id and a
vector one stays; with fewer candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, materialize, table

#: Vectors on which centroids are fitted, entries of a block, queries of a lot, centroids of a half at most,
#: vectors on which the walk is measured, and walks of a task at most.
FITTED, BLOCK, LOT, MOST, TRIALS, WALKS = 20_000, 4_000, 4_000, 256, 100, 4_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, c)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()), replace=False)]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def walk(a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs (i, j) with entries, in order of a[i] + b[j], until they hold enough."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa], b[ob]
    heap, seen, out, got = [(float(sa[0] + sb[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i]), int(ob[j])
        if held[cell]:
            out.append(cell)
            got += int(held[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(sa) and q < len(sb) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(sa[p] + sb[q]), p, q))
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def entries_needed(placed: DataFrame, sample, ca: np.ndarray, cb: np.ndarray, half: int, held: np.ndarray, top: int, recall: float) -> int:
    """How many entries a query must meet to find that share of its true neighbours: TRIALS sample vectors are
    searched by brute force over all entries, and the walk to each of their neighbours' cells is measured."""
    trial = np.array(sample[:TRIALS].tolist(), np.float64).reshape(min(TRIALS, len(sample)), -1)

    def nearest_of(batches):
        for g in batches:
            score = trial @ _matrix(g.column(1)).T
            best = np.argsort(-score, axis=1)[:, : top + 1]
            at = pa.array(best.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(trial)), best.shape[1]), pa.int32()), pa.array(np.take_along_axis(score, best, 1).ravel()), g.column(2).take(at), g.column(3).take(at)], ["t", "s", "a", "b"])

    best = Window.partitionBy("t").orderBy(F.desc("s"))
    near = placed.select("entry", "v", "a", "b").mapInArrow(nearest_of, "t int, s double, a int, b int").withColumn("k", F.row_number().over(best)).where(F.col("k") <= top + 1)
    met = []
    walks = {}
    for r in near.collect():  # at most TRIALS * (top + 1)
        if r.t not in walks:
            x = trial[r.t]
            order = np.argsort(-(ca @ x[:half])[:, None] - (cb @ x[half:])[None, :], axis=None, kind="stable")
            walks[r.t] = np.empty(len(order), np.int64)
            walks[r.t][order] = np.cumsum(held.ravel()[order])
        met.append(walks[r.t][r.a * held.shape[1] + r.b])
    return int(np.quantile(met, recall, method="higher")) + top + 1


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, recall: float = 0.95, centroids: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id, score: per query its ``top`` nearest among all other rows found."""
    spark = vectors.sparkSession
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks")).where("id is not null and v is not null").where(sound)
    rows = materialize(rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")  # -0.0 becomes 0.0
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id long, rank int, {id_col} long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["d"]
    rows = rows.where(F.size("v") == dim)
    # Of equal vectors only the smallest ids can be among the nearest: the row limit is pushed below the shuffle.
    first = rows.select("id", "v").withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("k") <= top + 1)
    entries = materialize(first.groupBy("v").agg(F.min("id").alias("entry"), F.array_sort(F.collect_set("id")).alias("ids")), "entries")
    n = entries.count()
    sample = entries.orderBy(F.xxhash64("entry")).limit(FITTED).select("v").toPandas()["v"]
    x, half = np.array(sample.tolist(), np.float64).reshape(len(sample), dim), max(1, dim // 2)
    k = min(centroids or max(4, min(MOST, round((n / 8) ** 0.5))), len(x))
    ca, cb = kmeans(x[:, :half], k), kmeans(x[:, half:], k) if dim > half else np.zeros((1, 0))

    def place(batches):
        for g in batches:
            m = _matrix(g.column(1))
            yield pa.RecordBatch.from_arrays([*g.columns, pa.array(nearest(m[:, :half], ca), pa.int32()), pa.array(nearest(m[:, half:], cb) if dim > half else np.zeros(len(m)), pa.int32())], ["entry", "v", "a", "b"])

    placed = materialize(entries.select("entry", "v").mapInArrow(place, "entry long, v array<double>, a int, b int"), "placed")
    held = np.zeros((k, len(cb)), np.int64)
    for r in placed.groupBy("a", "b").count().collect():  # at most MOST squared
        held[r[0], r[1]] = r[2]
    enough = entries_needed(placed, sample, ca, cb, half, held, top, recall)
    asked = rows.where("asks").select("id", "v").distinct()
    asked = materialize(asked.join(entries.select("entry", F.col("v").alias("w")), F.col("v") == F.col("w")).select("id", "entry", "v"), "asked")
    cells = spark.sparkContext.broadcast(held)

    def visits(batches):
        for g in batches:
            m = _matrix(g.column(1))
            out: tuple[list, ...] = ([], [], [])
            for r, (da, db) in enumerate(zip(-m[:, :half] @ ca.T, -m[:, half:] @ cb.T if dim > half else np.zeros((len(m), 1)), strict=True)):
                per: dict[int, list[int]] = {}
                for i, j in walk(da, db, cells.value, enough):
                    per.setdefault(i, []).append(j)
                for i, js in per.items():
                    for column, value in zip(out, (r, i, js), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([g.column(0).take(at), g.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32()))], ["query", "q", "a", "bs"])

    # Walks are long and their input is small: they are dealt by number, as partitions by size would end in one task (and
    # by another key than the rows already are, or Spark leaves the exchange out).
    wanted = asked.select("entry", "v").dropDuplicates(["entry"])
    walkers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // WALKS))
    met = materialize(wanted.repartition(walkers, F.xxhash64("entry")).mapInArrow(visits, "query long, q array<double>, a int, bs array<int>"), "visits")
    lots = met.groupBy("a").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    size = [(int(i), int(-(-c // BLOCK))) for i, c in enumerate(held.sum(axis=1)) if c]
    parts = F.broadcast(spark.createDataFrame(size, "a int, blocks int").join(lots, "a"))  # a row per centroid
    left = placed.join(parts, "a").withColumn("block", F.pmod(F.xxhash64("entry"), "blocks").cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    right = met.join(parts, "a").withColumn("lot", F.pmod(F.xxhash64("query"), "lots").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def rank(key, entry, query):
        out: tuple[list, ...] = ([], [], [])
        if entry.num_rows and query.num_rows:
            m, b, name = _matrix(entry.column("v")), entry.column("b").to_numpy(), entry.column("entry").to_numpy()
            ids, bs = query.column("query").to_numpy(), query.column("bs").to_pylist()
            q = _matrix(query.column("q"))
            for at in range(0, len(q), 256):
                score = q[at : at + 256] @ m.T
                for r, s in enumerate(score):
                    visited = np.zeros(len(cb), bool)
                    visited[bs[at + r]] = True
                    some = np.flatnonzero(visited[b])
                    if len(some) > top + 1:
                        least = np.partition(s[some], len(some) - top - 1)[len(some) - top - 1]
                        some = some[s[some] >= least - 1e-9 * abs(least)]
                    exact = (m[some] * q[at + r]).sum(axis=1)
                    best = np.lexsort((name[some], -exact))[: top + 1]
                    out[0].append(np.full(len(best), ids[at + r]))
                    out[1].append(name[some][best])
                    out[2].append(exact[best])
        cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query": pa.array(cat[0].astype(np.int64)), "entry": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})

    found = left.select("a", "block", "lot", "entry", "v", "b").groupBy("a", "block", "lot").cogroup(right.select("a", "block", "lot", "query", "q", "bs").groupBy("a", "block", "lot")).applyInArrow(rank, "query long, entry long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    found = found.withColumn("k", best).where(F.col("k") <= top + 1).drop("k")
    found = found.join(entries.select(F.col("entry").alias("e"), "ids"), F.col("entry") == F.col("e")).select("query", "score", F.explode("ids").alias("near"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))
    found = found.withColumn("k", best).where(F.col("k") <= top + 1)
    # By ascending (minus score, id): nearest first.
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "near"))).alias("near"))
    ranked = attach(asked.select(F.col("id").alias("query_id"), F.col("entry").alias("query")), materialize(lists, "nearest"), ["query"], "inner")
    own = F.slice(F.expr("filter(near, x -> x.near <> query_id)"), 1, top)
    return ranked.select("query_id", F.posexplode(own).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.near").alias(id_col), (-F.col("x.s")).alias("score"))


def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
