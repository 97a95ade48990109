"""Token-id output: documents' ids in ascending id order, as one wavelet-matrix file per shard.

Documents are ranged by id, sorted within each range, encoded and written in shards of a bounded number of
tokens. A file is written under a temporary name and moved into place, so a repeated task overwrites it with
the same bytes. Files are read back through Spark's own file source.

Defined results: null text counts as empty; an empty text has its end id alone; rows that share an id stay
apart, in text order; a null id sorts first; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, wavelet
from .common import attach, materialize, mkdirs, scratch, table, text_of

#: A shard is closed after this many tokens: about 8 MB of planes.
SHARD_TOKENS = 4_000_000


def _put(folder: str, name: str, data: bytes, attempt: int) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    part = posixpath.join(root, f"_{name}.{attempt}")
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, posixpath.join(root, name))


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards into folder; return one row per shard: shard (file name), docs, tokens."""
    mkdirs(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, end, enc = TaskContext.get(), np.array([end_id], np.uint32), bpe.encoder(tokenizer)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[int] = []
        done, k = [], 0

        def close() -> None:
            nonlocal k
            name = f"shard-{task.partitionId():07d}-{k:05d}.wvmx"
            _put(folder, name, wavelet.dump(np.concatenate(ids), names, counts), task.taskAttemptId())
            done.append((name, len(names), sum(counts)))
            for x in (ids, names, counts):
                x.clear()
            k += 1

        held = 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                ids += (data, end)
                names.append(name)
                counts.append(len(data) + 1)
                held += counts[-1]
                if held >= shard_tokens:
                    close()
                    held = 0
        if names:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["shard", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(rows.mapInArrow(write, "shard string, docs long, tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix, names, counts = wavelet.load(data.as_py())
                raw, ends = memoryview(matrix.ids().astype("<u4").tobytes()), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, counts, strict=True)]
                size = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([posixpath.basename(path)] * size), pa.array(names, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wvmx").load(folder).select("path", "content")
    rows = files.mapInArrow(read, "shard string, doc_id long, within long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return attach(rows, starts, ["shard"], "inner").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, manifest)
