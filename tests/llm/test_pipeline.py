"""The pipeline's stages one after another, each against what it must do to its own input."""

import re

import corpus_pipeline
from spanloom.llm import jaccard
from spanloom.shared import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), "stage")
        frames.append((before, docs))
    ids = [[{r["doc_id"]: r for r in df.collect()} for df in pair] for pair in frames]
    for before, after in frames[:-1]:
        assert after.columns == before.columns
    (start, good), (_, unique), (_, clean), (_, masked), (_, packed) = ids
    assert sum(labels[i] for i in good if i in labels) >= 0.97 * sum(labels[i] for i in start if i in labels)
    assert sum(1 - labels[i] for i in good if i in labels) <= 0.4 * sum(1 - labels[i] for i in start if i in labels)
    assert len({r["text"] for r in unique.values()}) == len(unique)
    assert all(not any(b in " ".join(r["text"].lower().split()) for b in benchmark) for r in clean.values())
    assert {i for i, r in unique.items() if not any(b in " ".join(r["text"].lower().split()) for b in benchmark)} == set(clean)
    assert set(masked) == set(clean) and not any(re.search(r'token = "[0-9a-f]{40}"', r["text"]) for r in masked.values())
    assert set(packed) == set(masked)


def test_phrases_in_many_documents_make_no_candidates(spark, monkeypatch):
    """Near-duplicates are sought among few candidates, though passages repeat in more documents than pairs are counted for."""
    monkeypatch.setattr(jaccard, "FREQUENT_TOKENS", 1)
    monkeypatch.setattr(jaccard, "PAIRED_GROUP", 4)
    verified, candidates = jaccard._verified_links, []
    monkeypatch.setattr(jaccard, "_verified_links", lambda rows, sets, t: candidates.append(sets.count()) or verified(rows, sets, t))
    texts = [" ".join([*(f"w{k}x{j}" for j in range(45)), *(f"p{k % 3}x{j}" for j in range(7))]) for k in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (40, texts[0] + " end")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()} == set(range(40))
    assert candidates == [2]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    fills = {}
    for r in rows:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(fills.values()) <= 2048 and len(fills) <= -(-sum(fills.values()) // 2048) + 2
