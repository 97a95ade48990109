"""Language-model scores by deleted interpolation.

The probability of a word after another is a mixture of maximum-likelihood estimates: bigram, unigram, and a
uniform share for words never met. The mixture weights depend on how often the context was met: contexts fall
into frequency buckets, and each bucket's weights are learnt by expectation-maximisation on held-out counts:
every training bigram is taken out of its own counts once ("deleted"), so each estimate is that of other data.

Data flow: documents are dealt into splits. A split asks for the counts of its distinct unigrams and bigrams, once
each, in blocks keyed by a range of hashes; blocks are answered from the counts of all training documents and
return to their split, which writes the counts of each document's words. Weights and scores are then read off
that table. Hot n-grams cost one request per split, and nothing is broadcast but the mixture weights.

Defined results: null and empty texts hold the end token alone; a null id belongs to the training documents; rows
that share an id are scored one by one; an empty table gives an empty result; if nothing is learnt from, every
word has probability 1 (the uniform share of an empty vocabulary).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table, text_of
from .words import combine, mix, slices, word_hashes

END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
#: Bytes of a split of documents, and bytes of text whose counts one block of hashes answers; buckets of context frequency (powers of two); bins of each estimate in the
#: histogram on which weights are learnt.
SPLIT_BYTES, PART_BYTES, BUCKETS, BINS = 24_000_000, 96_000_000, 24, 40


def pack(numbers: np.ndarray) -> bytes:
    """Byte planes of unsigned integers: the shuffle's compression then removes the empty ones."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    return unpack(data, f"<u{len(data) // n}" if n else "<u4").astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    top = int(counts.max()) if len(counts) else 0
    return pack(counts.astype(np.uint8 if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and the hashes of all unigrams and bigrams in order."""
    words, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for some in slices(texts):
        bounds, h = word_hashes(some)
        words.append(np.insert(h, bounds[1:], END))
        sizes.append(np.diff(bounds) + 1)
    size, w = np.concatenate(sizes), np.concatenate(words)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.cumsum(size) - size] = START
    return size, mix(w ^ np.uint64(1)), combine(v, w)


def _text(group: pa.Table) -> pa.Array:
    chunks = [x.cast(pa.large_string()) for x in group.column("text").chunks]
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts + 1))


def counts_of(dealt: DataFrame, parts: int) -> DataFrame:
    """dealt(id, held, split, text) -> rows (split, part, kind, counts) that answer the splits' distinct n-grams, and
    rows without a split that hold the sums of each part: kind, n (training tokens), v (distinct training tokens)."""

    def ask(key, group):
        size, *keys = grams(_text(group))
        learnt = np.repeat(~group.column("held").to_numpy(), size)
        out: tuple[list, ...] = ([], [], [], [], [])
        for kind, k in enumerate(keys):
            known, at = np.unique(k, return_inverse=True)
            counts = np.bincount(at[learnt], minlength=len(known))
            cut = _cuts(known, parts)
            for part, (x, c) in enumerate(zip(np.split(known, cut), np.split(counts, cut), strict=True)):
                if len(x):
                    for column, value in zip(out, (kind, part, key[0].as_py(), pack(np.diff(x, prepend=np.uint64(0))), pack_counts(c)), strict=True):
                        column.append(value)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "part", "split", "keys", "counts"])

    def answer(key, group):
        splits = group.column("split").to_pylist()
        keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in group.column("keys").to_pylist()]
        counts = [unpack_counts(c, len(k)) for c, k in zip(group.column("counts").to_pylist(), keys, strict=True)]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
        cut = np.cumsum([len(k) for k in keys])[:-1]
        replies = [pack_counts(total[x]) for x in np.split(at, cut)]
        n = len(splits)
        kind, part = key[0].as_py(), key[1].as_py()
        sums = [int(total.sum()), int((total > 0).sum())]
        return pa.table([pa.array([*splits, None], pa.int32()), pa.array([part] * (n + 1), pa.int32()), pa.array([kind] * (n + 1), pa.int32()), pa.array([*replies, None], pa.binary()), pa.array([None] * n + sums[:1], pa.int64()), pa.array([None] * n + sums[1:], pa.int64())], ["split", "part", "kind", "counts", "n", "v"])

    asked = dealt.groupBy("split").applyInArrow(ask, "kind int, part int, split int, keys binary, counts binary")
    return asked.groupBy("kind", "part").applyInArrow(answer, "split int, part int, kind int, counts binary, n long, v long")


def counted(dealt: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Per document the training counts of its words and bigrams, in order."""

    def lay(key, group, replies):
        if not group.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "held": pa.array([], pa.bool_()), "n": pa.array([], pa.int64()), "c1": pa.array([], pa.binary()), "c2": pa.array([], pa.binary())})
        size, *keys = grams(_text(group))
        got = {(k, p): c for k, p, c in zip(*(replies.column(x).to_pylist() for x in ("kind", "part", "counts")), strict=True)}
        ends = np.cumsum(size)
        columns = []
        for kind, k in enumerate(keys):
            known, at = np.unique(k, return_inverse=True)
            cut = [0, *_cuts(known, parts).tolist(), len(known)]
            c = np.concatenate([unpack_counts(got[kind, p], b - a) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a])[at]
            columns.append(pa.array([pack_counts(c[e - n : e]) for n, e in zip(size.tolist(), ends.tolist(), strict=True)], pa.binary()))
        return pa.table([group.column("id"), group.column("held"), pa.array(size, pa.int64()), *columns], ["id", "held", "n", "c1", "c2"])

    of = answers.where("split is not null").select("split", "kind", "part", "counts")
    return dealt.groupBy("split").cogroup(of.groupBy("split")).applyInArrow(lay, "id long, held boolean, n long, c1 binary, c2 binary")


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never met, else one more than the exponent of two."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, np.log2(np.maximum(context, 1)).astype(np.int64) + 1), 0)


def _numbers(n: int, c1: bytes, c2: bytes, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, two = unpack_counts(c1, n), unpack_counts(c2, n)
    context = np.empty_like(one)
    context[0], context[1:] = texts, one[:-1]
    return one, two, context


def weights(rows: DataFrame, tokens: int, distinct: int, texts: int, rounds: int = 200) -> np.ndarray:
    """Per bucket the shares of bigram, unigram and uniform estimates."""

    def bins(batches):
        total = np.zeros((BUCKETS * BINS * BINS, 3))
        for g in batches:
            for n, c1, c2 in zip(*(g.column(k).to_pylist() for k in range(3)), strict=True):
                one, two, context = _numbers(n, c1, c2, texts)
                two, one, context = (two - 1) / np.maximum(context - 1, 1), (one - 1) / max(tokens - 1, 1), context - 1
                i2, i1 = (np.where(f > 0, np.clip((-2 * np.log2(np.maximum(f, 1e-30))).astype(np.int64), 0, BINS - 2), BINS - 1) for f in (two, one))
                at = (bucket(context) * BINS + i2) * BINS + i1
                for k, x in enumerate((None, two, one)):
                    total[:, k] += np.bincount(at, weights=x, minlength=len(total))
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, k]) for k in range(3))], ["at", "n", "two", "one"])

    met = rows.where("not held").select("n", "c1", "c2").mapInArrow(bins, "at long, n double, two double, one double").groupBy("at").agg(F.sum("n"), F.sum("two"), F.sum("one")).orderBy("at").collect()
    out = np.tile([0.0, 0.999, 0.001], (BUCKETS, 1))
    of = np.array([r[0] // (BINS * BINS) for r in met], int)
    n = np.array([r[1] for r in met], float)
    f = np.array([[r[2] / r[1], r[3] / r[1], 1 / (distinct + 1)] for r in met], float).reshape(-1, 3)
    for b in range(BUCKETS):
        some = of == b
        if not some.any():
            continue
        share = np.array([0.5, 0.4, 0.1]) if b else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            part = f[some] * share
            part /= part.sum(axis=1, keepdims=True)
            share = (part * n[some, None]).sum(axis=0) / n[some].sum()
        # The uniform share never vanishes, so words never met keep a probability.
        share[2] = max(share[2], 1e-6)
        out[b] = share / share.sum()
    for b in range(2, BUCKETS):  # buckets that held-out counts never reached take the shares of the last that they did
        if not (of == b).any() and (of == b - 1).any() or b > 2 and not (of >= b).any():
            out[b] = out[b - 1]
    return out


def score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """held: whether a row is kept from the training counts. Returns id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-half unigrams), score (the model's log10 probability of the whole text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), text_of(text_col).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")), F.sum(F.when(F.col("held"), 0).otherwise(1))).first()
    splits, parts, texts = (*(max(least, -(-(size[0] or 0) // x)) for x in (SPLIT_BYTES, PART_BYTES)), int(size[1] or 0))
    dealt = rows.withColumn("split", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(splits)).cast("int"))
    answers = materialize(counts_of(dealt, parts), "lm-counts")
    release(spark)
    total = answers.where("split is null and kind = 0").agg(F.sum("n"), F.sum("v")).first()
    tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    found = materialize(counted(dealt, answers, parts), "lm-documents")
    release(spark)
    share = weights(found, tokens, distinct, texts)

    def add(batches):
        for g in batches:
            out: tuple[list, ...] = ([], [], [])
            for n, c1, c2 in zip(*(g.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                one, two, context = _numbers(n, c1, c2, texts)
                w = share[bucket(context)]
                p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(tokens, 1) + w[:, 2] / (distinct + 1) if tokens else np.ones(n)
                base = np.log10((one + 0.5) / (tokens + 0.5 * (distinct + 1)))
                for column, value in zip(out, (int((one > 0).sum()), float(base.sum()), float(np.log10(p).sum())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([g.column(0), g.column(1), g.column(2), pa.array(out[0], pa.int64()), pa.array([tokens] * g.num_rows, pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return found.mapInArrow(add, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
