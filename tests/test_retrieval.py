"""BM25, dense search, fusion, reranking, duplicates."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spanloom.functions import kernels
from spanloom.operators import dedup, dense, fusion, lexical
from spanloom.shared import written


def ranking(spark, name, items):
    return spark.createDataFrame([(name, 1, c, float(s), k + 1) for k, (c, s) in enumerate(items)], "retriever string, query_id int, chunk_id string, score double, rank int")


def test_bm25(spark):
    chunks = spark.createDataFrame([("c1", "Set retry_limit before a job is sent again."), ("c2", "A limit on each retry keeps queues short."), ("c3", "Workers read tasks in order of age."), ("c4", None), ("c5", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "retry_limit"), (2, "weather"), (3, "!!!")], "query_id int, question string")
    found = lexical.search(lexical.build(chunks), asked, 5).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in found} == {1} and found[0]["chunk_id"] == "c1" and "c3" not in {r["chunk_id"] for r in found}
    assert lexical.search(lexical.build(chunks.limit(0)), asked, 3).collect() == []
    with pytest.raises(ValueError):
        lexical.search(lexical.build(chunks), asked, 0)


def test_bm25_counts_repeated_terms(spark):
    chunks = spark.createDataFrame([("a", "x y x"), ("b", "y z"), ("c", "w"), ("d", "v u")], "chunk_id string, text string")
    got = {r["chunk_id"]: r["score"] for r in lexical.search(lexical.build(chunks), spark.createDataFrame([(1, "x x y")], "query_id int, question string"), 5).collect()}
    idf = lambda df: math.log(4 - df + 0.5) - math.log(df + 0.5)
    part = lambda df, tf, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert abs(got["a"] - (2 * part(1, 2, 3) + part(2, 1, 3))) < 1e-5


def test_rrf_vectors(spark):
    both = ranking(spark, "dense", [("x", 0.9), ("y", 0.8)]).unionByName(ranking(spark, "sparse", [("y", 12)]))
    rows = {r["chunk_id"]: r for r in fusion.reciprocal_rank_fusion(both).collect()}
    assert rows["y"]["score"] == round(1 / 62 + 1 / 61, 9) and rows["x"]["score"] == round(1 / 61, 9) and rows["y"]["rank"] == 1
    assert set(rows["x"]["hits"]) == {"dense"} and set(rows["y"]["hits"]) == {"dense", "sparse"}
    tie = ranking(spark, "dense", [("zebra", 1)]).unionByName(ranking(spark, "sparse", [("apple", 1)]))
    assert [r["chunk_id"] for r in fusion.reciprocal_rank_fusion(tie).orderBy("rank").collect()] == ["apple", "zebra"]
    assert [r["chunk_id"] for r in fusion.reciprocal_rank_fusion(tie, {"sparse": 0.0}).collect()] == ["zebra"]
    for bad in ({"rank_constant": 0}, {"limit": 0}, {"weights": {"dense": -1.0}}):
        with pytest.raises(ValueError):
            fusion.reciprocal_rank_fusion(tie, **bad)
    with pytest.raises(ValueError):
        fusion.check_weights({"spares": 1.0}, ["dense", "sparse"])
    with pytest.raises(ValueError):
        fusion.unified({"dense": tie}, ["sparse"])


def test_dense_top_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0]), (4, None)], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["chunk_id"], r["score"]) for r in dense.top_k(rows, asked, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.6)]
    assert dense.top_k(rows, asked.limit(0), 3).collect() == []


def test_lsh_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(r["query_id"], r["chunk_id"]) for r in dense.top_k(vectors, asked, 10).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in dense.lsh_top_k(vectors, asked, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_lsh_shuffles_no_pairs(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    found = dense.lsh_top_k(vectors, asked, 4, tables=2, bucket_length=0.05)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    features = lambda rows: rows.withColumn("features", array_to_vector("vector")).drop("vector")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.05, numHashTables=2, seed=7).fit(features(vectors))
    near = model.approxSimilarityJoin(features(vectors), features(asked), 2.0, "distance").select("datasetB.query_id", "datasetA.chunk_id", F.round(1 - F.col("distance") * F.col("distance") / 2, 6).alias("score"))
    assert sorted(found.collect()) == sorted(lexical.ranked(near, 4).collect())
    assert len(found.collect()) > len(dense.lsh_top_k(vectors, asked, 4, radius=0.9, tables=2, bucket_length=0.05).collect())


def test_dense_in_blocks(spark, monkeypatch):
    drawn = np.random.default_rng(3).integers(-2, 3, (60, 3)) / 2.0  # many ties
    vectors = spark.createDataFrame([(f"c{k:02}", v.tolist()) for k, v in enumerate(drawn)], "chunk_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(drawn[::4])], "query_id int, vector array<double>")
    want = sorted((q, f"c{c:02}", s, r + 1) for q in range(15) for r, (s, c) in enumerate([(-x, c) for x, c in sorted((-round(float(drawn[c] @ drawn[q * 4]), 6), c) for c in range(60))[:5]]))
    one = dense.top_k(vectors, asked, 5)
    assert sorted(map(tuple, one.collect())) == want
    monkeypatch.setattr(dense, "QUESTIONS_PER_BLOCK", 4)
    monkeypatch.setattr(kernels, "CELLS", 20)
    made = []
    monkeypatch.setattr(dense, "written", lambda df, name: made.append(name) or written(df, name))
    several = dense.top_k(vectors, asked, 5)
    assert sorted(map(tuple, several.collect())) == want and made == ["vectors"]  # once for all blocks


def test_hydrate_and_rerank(spark):
    results = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2)], "query_id int, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "nothing here"), ("b", "the wanted words")], "chunk_id string, text string")
    rows = fusion.hydrate(results, chunks).withColumn("question", F.lit("wanted words"))
    assert [r["chunk_id"] for r in fusion.rerank(rows, 1).collect()] == ["b"]
    with pytest.raises(Exception, match="no chunk with id"):
        fusion.hydrate(results, chunks.where("chunk_id = 'a'")).collect()


def test_greedy_dedup_over_batches(spark):
    texts = ["red apple tree", "red apple tree", "apple tree red", "slow train", "red apple", "tree red apple", "", "train slow"]
    rows = [(f"{d}#{k}", d, k, t) for d in ("p", "q") for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, relative_path string, chunk_index int, text string").repartition(5)
    found = dedup.near_duplicates(dedup.with_vectors(chunks, ["chunk_index"]), ["chunk_index"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2")
        got = {(r["chunk_id"], r["duplicate_of"], r["exact"]) for r in found.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {(f"{d}#{k}", f"{d}#{of}", k == 1) for d in ("p", "q") for k, of in ((1, 0), (2, 0), (5, 0), (7, 3))}


def test_greedy_dedup(spark):
    unit = lambda *v: [x / math.hypot(*v) for x in v]
    rows = [(0, "p", "alpha", unit(1.0, 0.0)), (1, "p", "alpha", unit(1.0, 0.0)), (2, "p", "near", unit(1.0, 0.29)), (3, "p", "cousin", unit(1.0, 0.7)), (4, "q", "alpha", unit(1.0, 0.0))]
    chunks = spark.createDataFrame(rows, "chunk_id int, relative_path string, text string, vector array<double>")
    got = {r["chunk_id"]: (r["duplicate_of"], r["exact"]) for r in dedup.near_duplicates(chunks, ["chunk_id"]).collect()}
    assert got == {1: (0, True), 2: (0, False)}
    assert 3 in {r["chunk_id"] for r in dedup.near_duplicates(chunks, ["chunk_id"], 0.8).collect()}
    assert {r["chunk_id"] for r in dedup.exact_duplicates(chunks, ["chunk_id"], "corpus").collect()} == {1, 4}
    assert {r["chunk_id"] for r in dedup.exact_duplicates(chunks, ["chunk_id"]).collect()} == {1}
    summary = dedup.summary(chunks, dedup.near_duplicates(chunks, ["chunk_id"])).first()
    assert (summary["examined"], summary["exact"], summary["near"], summary["kept"]) == (5, 1, 1, 3)
    with pytest.raises(ValueError):
        dedup.near_duplicates(chunks, ["chunk_id"], 0)
