"""Stores by bucket, evaluation files, generated questions, reports, models behind a call."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import generation, metrics, models, reports, stats
from spanloom.plans import registry
from spanloom.shared import is_table
from spanloom.sources import evaluation, files, store

CHUNK = "chunk_id string, relative_path string, text string"


def chunks(spark, *rows):
    return spark.createDataFrame([(f"{p}#{k}", p, t) for p, *texts in rows for k, t in enumerate(texts)], CHUNK)


def held(df):
    return {} if df is None else {r["chunk_id"]: r["text"] for r in df.collect()}


def test_chunk_store(spark, tmp_path):
    own = store.ChunkStore(spark, f"file://{tmp_path}/s", 4)
    assert own.read("fixed") is None and own.size("fixed") == 0 and own.get("fixed", "p#0") is None
    own.replace("fixed", chunks(spark, ("p", "a", "b"), ("q", "c"), ("r", "d")))
    own.replace("other", chunks(spark, ("p", "z")))
    before = own._held()["fixed"]
    own.upsert("fixed", spark.createDataFrame([("p#1", "p", "B"), ("p#9", "p", "n")], CHUNK))
    assert held(own.read("fixed")) == {"p#0": "a", "p#1": "B", "p#9": "n", "q#0": "c", "r#0": "d"}
    touched = str(own._bucket_of("p"))
    assert all(f == before[b] for b, f in own._held()["fixed"].items() if b != touched)  # other buckets keep their files
    own.replace_documents("fixed", spark.createDataFrame([("q",), ("s",)], "relative_path string"), chunks(spark, ("s", "e")))
    assert set(held(own.read("fixed"))) == {"p#0", "p#1", "p#9", "r#0", "s#0"}
    assert own.delete_document("fixed", "p") == 3 and own.delete_document("fixed", "nowhere") == 0
    assert own.contains("fixed", "r#0") and not own.contains("fixed", "p#0") and own.size("fixed") == 2
    assert [r["chunk_id"] for r in own.iterate("fixed")] == ["r#0", "s#0"] and own.ids("fixed", relative_path="s").collect()[0][0] == "s#0"
    assert held(own.read("fixed", "s")) == {"s#0": "e"}
    assert own.strategies() == ["fixed", "other"] and own.delete_strategy("other") == 1 and own.strategies() == ["fixed"]
    assert len(own._numbers()) <= 2
    with pytest.raises(ValueError, match="format"):
        store.ChunkStore(spark, f"file://{tmp_path}/s", 8).read("fixed")


def test_a_lost_race_is_an_error(spark, tmp_path, monkeypatch):
    own = store.ChunkStore(spark, f"file://{tmp_path}/s", 2)
    own.replace("fixed", chunks(spark, ("p", "a")))
    monkeypatch.setattr(own, "_numbers", lambda: [])
    with pytest.raises(RuntimeError, match="another writer"):
        own._publish({})


def test_lexical_and_vector_stores(spark, tmp_path):
    from spanloom.operators import lexical

    rows = chunks(spark, ("p", "alpha beta", "beta gamma"), ("q", "delta"), ("r", "epsilon zeta"))
    own = store.LexicalStore(spark, f"file://{tmp_path}/l", 2)
    own.index("fixed", rows)
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id int, question string")
    found = lambda index: [(r["chunk_id"], r["score"]) for r in lexical.search(index, asked, 3).orderBy("rank").collect()]
    assert found(own.load("fixed")) == found(lexical.build(rows))
    new = chunks(spark, ("q", "alpha alpha"))
    own.index_documents("fixed", spark.createDataFrame([("q",)], "relative_path string"), new)
    assert found(own.load("fixed")) == found(lexical.build(rows.where("relative_path != 'q'").unionByName(new)))  # every idf follows
    with pytest.raises(ValueError):
        own.load("semantic")
    vectors = store.VectorStore(spark, f"file://{tmp_path}/v", 2)
    vectors.embed("fixed", store.LexicalStore.lists(rows), 16)
    q = spark.createDataFrame([(1, [1.0] * 16)], "query_id int, vector array<double>")
    assert {r["chunk_id"] for r in vectors.search("fixed", q, 5, relative_path="p").collect()} == {"p#0", "p#1"}


def test_stores_shuffle_no_rows(spark, tmp_path):
    rows = chunks(spark, *((f"d{k}", "one text", "and more") for k in range(40))).repartition(3)
    own = store.LexicalStore(spark, f"file://{tmp_path}/l", 2)
    own.index("fixed", rows)
    assert all(len(list(b.glob("*.parquet"))) == 3 for b in tmp_path.glob("l/strategy=fixed/*/bucket=*"))  # no task gets a whole bucket
    index = own.load("fixed")
    assert is_table(index.corpus) and index.chunks.count() == 80 and {r["term"]: r["df"] for r in index.stats.collect()} == dict.fromkeys(("one", "text", "and", "more"), 40)
    assert "ArrowPythonRunner" not in (plan := index.stats._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan  # counted once


def test_listings_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(registry, "_index", None)
    assert registry.document_listing(spark, "/root/testdata/sf0.001").count() > 0
    assert registry.chunk_store(spark, "/root/testdata/sf0.001").count() > 0


def test_document_store(spark, tmp_path):
    docs = files.text_documents(spark.createDataFrame([("a.txt", "one"), ("b.txt", "two")], "relative_path string, text string"))
    own = store.DocumentStore(spark, f"file://{tmp_path}/d")
    assert {r["relative_path"]: (r["sections"], r["digest"]) for r in own.save(docs, spark.createDataFrame([("a.txt", "x")], "relative_path string, digest string")).collect()} == {"a.txt": (1, "x"), "b.txt": (1, None)}
    assert {r["relative_path"] for r in own.load().collect()} == {"a.txt", "b.txt"}


def test_golden_and_sheets(spark, tmp_path):
    questions = spark.createDataFrame([("q1", "tuning", "lookup", "what?", "that\nand this", True, None, None, [("a.md", 'a "quote"\n\nof two')]), ("q2", "tuning", "no_answer", "why?", "", False, None, "note", [])], evaluation.QUESTION)
    path = f"file://{tmp_path}/golden.yaml"
    evaluation.save_golden(questions, path, "1.0")
    again, ref = evaluation.load_golden(spark, path)
    assert ref == "1.0" and sorted(again.collect()) == sorted(questions.collect())
    assert evaluation.spans_of(again).first()["quote"] == 'a "quote"\n\nof two'
    (tmp_path / "twice.yaml").write_text("format_version: 2\nquestions:\n- question_id: a\n- question_id: a\n")
    (tmp_path / "old.yaml").write_text("format_version: 1\nquestions: []\n")
    for name in ("twice", "old"):
        with pytest.raises(ValueError):
            evaluation.load_golden(spark, f"file://{tmp_path}/{name}.yaml")
    items = spark.createDataFrame([("q1", "what?", "that", "this", "long\ncontext", None, None)], evaluation.ITEM)
    evaluation.save_sheet(items, f"file://{tmp_path}/sheet.yaml", arm="hybrid")
    assert evaluation.load_sheet(spark, f"file://{tmp_path}/sheet.yaml").collect() == items.collect()


def test_confusable_documents(spark):
    rows = chunks(spark, ("a", "red apple tree", "red apple"), ("b", "red apple fruit"), ("c", "slow green train"))
    got = generation.confusable(rows, spark.createDataFrame([("a",)], "relative_path string"), k=3).collect()
    assert [(r["relative_path"], r["other"]) for r in got] == [("a", "b")]


def test_every_chunk_of_an_asking_document_asks(spark):
    fruit, trains = ("apple", "pear", "plum"), ("north", "south", "east", "west")
    rows = chunks(spark, ("a", *(f"red {x}" for x in fruit), *(f"train to the {x}" for x in trains)), ("b", *(f"red {x} pie" for x in fruit)), ("c", *(f"train to the {x} coast" for x in trains)))
    got = generation.confusable(rows, spark.createDataFrame([("a",)], "relative_path string"), k=2).collect()
    assert [(r["relative_path"], r["other"], r["n"]) for r in got] == [("a", "c", 4)]


def test_models_behind_a_call(spark):
    seen = spark.sparkContext.accumulator(0)

    def call(prompt):
        seen.add(1)
        return {"text": f" {prompt}! ", "prompt_tokens": 3, "completion_tokens": 9, "reasoning_tokens": 4}

    rows = models.with_usage(models.hosted(call)(spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string"))).orderBy("id").collect()
    assert [(r["reply"], r["input_tokens"], r["output_tokens"], r["thinking_tokens"]) for r in rows] == [("a!", 3, 5, 4), ("b!", 3, 5, 4)]
    with pytest.raises(Exception, match="no text"):
        models.hosted(lambda p: {"text": " "})(spark.createDataFrame([("a",)], "prompt string")).collect()
    with pytest.raises(Exception, match="no price"):
        models.priced(spark.createDataFrame([("unknown", 1, 1)], "model string, input_tokens int, output_tokens int")).collect()


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([("b", 0.5, 2), ("a|x", 0.25, None)], "arm string, recall double, n int")
    assert reports.markdown_table(table) == "| arm | recall | n |\n|---|---|---|\n| a\\|x | 0.250 |  |\n| b | 0.500 | 2 |"
    with pytest.raises(ValueError):
        reports.markdown_table(table, 1)
    golden = spark.createDataFrame([("lookup", True), ("lookup", False)], "category string, verified boolean")
    about = reports.provenance(spark, golden, str(tmp_path), depth=10)
    assert (about.first()["commit"], about.first()["questions"], about.first()["settings"]) == ("unknown", {"lookup": 1}, {"depth": "10"})
    with pytest.raises(RuntimeError):
        reports.provenance(spark, golden, str(tmp_path), require_clean=True)
    reports.save(f"file://{tmp_path}/r", "Retrieval", about, {"Means": table})
    assert "## Means" in (tmp_path / "r/report.md").read_text() and list((tmp_path / "r/means").glob("*.json"))


def test_verdicts(spark):
    rows = [("fixed", arm, q, (q % 4 > 0) if arm == "rerank" else (q % 2 > 0)) for q in range(40) for arm in ("hybrid", "rerank")] + [("semantic", arm, q, q % 2 > 0) for q in range(10) for arm in ("hybrid", "rerank")]
    got = {r["strategy"]: r["verdict"] for r in reports.rerank_verdict(spark.createDataFrame(rows, "strategy string, arm string, question_id int, hit_5 boolean"), resamples=500).collect()}
    assert got == {"fixed": "better", "semantic": "not separated from zero"}
    claims = lambda status: spark.createDataFrame([(a, k, status) for a in range(5) for k in range(3)] + [(9, 0, "uncited")], "answer_id int, index int, status string")
    row = reports.separation(claims("supported"), claims("unsupported"), 200).first()
    assert (row["n"], row["real"], row["control"], row["excludes_zero"]) == (15, 1.0, 0.0, True)


def test_numbering_and_hits(spark):
    rows = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "id int").repartition(5)
    assert sorted((r["id"], r["i"]) for r in stats.numbered(rows, "id").collect()) == [(k, k) for k in range(101)]
    assert stats.numbered(rows.limit(0), "id").count() == 0
    ranked = spark.createDataFrame([("x", 1, 1, "p", 0, 10, 5), ("x", 2, 1, "p", 0, 10, 5)], "arm string, question_id int, rank int, relative_path string, start_char int, end_char int, token_count int")
    spans = spark.createDataFrame([(1, "s", "p", 0, 8), (1, "t", "q", 0, 5), (2, "s", "p", 2, 9), (2, "t", "q", 0, 4)], "question_id int, span string, relative_path string, start_char int, end_char int")
    kinds = spark.createDataFrame([(1, "multi_hop"), (2, "ambiguous")], "question_id int, category string")
    assert {r["question_id"]: r["hit"] for r in metrics.is_hit(ranked, spans, kinds).collect()} == {1: False, 2: True}


def test_include_root(tmp_path):
    (tmp_path / "docs_src").mkdir()
    (tmp_path / "docs/en").mkdir(parents=True)
    assert files.include_root(str(tmp_path / "docs/en")) == str(tmp_path)
    assert files.include_root("/", "no-such-folder") is None
