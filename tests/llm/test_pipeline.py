from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

BASE = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark):
    line = "terms and conditions of this site apply to every visit number {}"
    near = [f"n{k}" for k in range(60)]
    rows = [(k, f"own words {'abcdefghijkl'[k] * 4} of document\n{line.format(k)}") for k in range(10)]
    rows += [(20, " ".join(near)), (21, " ".join([*near, "extra"])), (22, None), (23, ""), (24, line.format(7)), (30, "you idiot scum " + " ".join(f"t{k}" for k in range(20)))]
    rows += [(40 + k, f"idiot scum t{k} t{k + 1}") for k in range(12)] + [(60 + k, f"kind friend t{k} t{k + 1}") for k in range(12)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], BASE)


def test_stages(spark, tmp_path):
    docs = _docs(spark)
    labels = docs.where("doc_id between 40 and 80").select("doc_id", (F.col("doc_id") < 60).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        at = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(sorted(r.doc_id for r in at.select("doc_id").collect()))
        if k < 4:
            assert at.columns == docs.columns
    toxic, lines, near = (set(x) for x in seen[:3])
    assert 30 not in toxic and set(range(10)) | {20, 21, 22, 23} <= toxic
    assert toxic - lines == {24}  # nothing but a recurring line is left of it
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage1").collect()}
    assert "conditions" in texts[0] and all("conditions" not in texts[k] for k in range(1, 10))
    assert 20 in near and 21 not in near
    assert set(seen[3]) <= near and set(seen[4]) <= near
    packed = at.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_no_rows(spark, tmp_path):
    at = _docs(spark).where("false")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
    assert at.count() == 0
