"""Files, stores, incremental ingest."""

import pytest
from pyspark.sql import functions as F

from spanloom.sources import files, store
from spanloom.streaming.ingest import ingest_batch, windowed_costs

MARKDOWN = """---
title: x
---
# Basics { #basics }

Intro <dfn>word</dfn>.

/// tip
kept
///

```python
# comment
```

### Notes

one

### Notes

two
"""


def test_markdown(spark):
    rows = spark.createDataFrame([("guide/basics.md", MARKDOWN, "markdown"), ("a.txt", "plain", "text"), ("b.html", "<title>HTML Guide</title><h1>Guide</h1><script>x</script><p>a<h2>Configuration</h2>b", "html")], "relative_path string, text string, source_format string")
    docs = {r["relative_path"]: r for r in files.assemble(files.parsed(rows)).collect()}
    basics = docs["guide/basics.md"]
    assert basics["title"] == "Basics" and "# comment" in basics["text"] and "///" not in basics["text"] and "<dfn>" not in basics["text"]
    assert len({s["section_id"] for s in basics["sections"]}) == len(basics["sections"]) == 3
    for doc in docs.values():
        assert all(doc["text"][s["start_char"] : s["end_char"]] == s["text"] for s in doc["sections"])
    assert docs["a.txt"]["title"] == "a" and docs["b.html"]["title"] == "HTML Guide"
    assert [s["heading_path"] for s in docs["b.html"]["sections"]] == [["Guide"], ["Guide", "Configuration"]]
    assert "x" not in docs["b.html"]["text"]
    with pytest.raises(Exception, match="no PDF library"):
        files.parsed(rows.limit(1).withColumn("source_format", F.lit("pdf"))).collect()


def test_dispatch_and_uploads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# A")
    (tmp_path / "b.bin").write_text("x")
    rows = files.read_corpus(spark, str(tmp_path)).collect()
    assert [(r["relative_path"], r["source_format"]) for r in rows] == [("sub/a.md", "markdown")]
    with pytest.raises(Exception, match="unsupported file"):
        spark.range(1).select(files.source_format(F.lit("x.doc"))).collect()
    status = spark.createDataFrame([("../x.md", "t"), ("x.exe", "t"), ("x.txt", " ")], "n string, t string").select(files.upload_status(F.col("n"), F.col("t")).alias("s"))
    assert [r["s"] for r in status.collect()] == [200, 415, 422]


def test_includes(spark):
    pages = spark.createDataFrame([("p", "a\n{* ../../docs_src/x.py hl[1] *}\n{* missing.py *}\nb")], "relative_path string, text string")
    full, unresolved = files.expand_includes(pages, spark.createDataFrame([("docs_src/x.py", "print()\n")], "path string, content string"))
    assert full.first()["text"] == "a\n```py\nprint()\n```\nb"
    assert [r["path"] for r in unresolved.collect()] == ["missing.py"]


def test_staleness_and_last_write(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "relative_path string, digest string")
    found = files.stale(rows([("a", "1"), ("b", "1"), ("c", "1")]), rows([("a", "1"), ("b", "2"), ("d", "1")]))
    assert {(r["relative_path"], r["change"]) for r in found.collect()} == {("b", "edited"), ("c", "deleted"), ("d", "new")}
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, i int, v string")
    assert files.last_of_each(log, "k", "i").first()["v"] == "y"


def _chunks(spark, rows):
    return spark.createDataFrame([(c, p, "fixed", t) for c, p, t in rows], "chunk_id string, relative_path string, strategy string, text string")


def test_store(spark, tmp_path):
    held = store.ChunkStore(spark, f"file://{tmp_path}/s")
    assert held.read("fixed") is None and held.delete_document("fixed", "p") == 0
    held.upsert("fixed", _chunks(spark, [("a", "p", "1"), ("b", "q", "2")]))
    held.upsert("fixed", _chunks(spark, [("a", "p", "3"), ("c", "p", "4")]))
    assert {(r["chunk_id"], r["text"]) for r in held.read("fixed").collect()} == {("a", "3"), ("b", "2"), ("c", "4")}
    wanted = spark.createDataFrame([(0, "c"), (1, "a"), (2, "c")], "position int, chunk_id string")
    assert [r["chunk_id"] for r in store.get_many(held.read("fixed"), wanted).collect()] == ["c", "a", "c"]
    assert held.delete_document("fixed", "p") == 2 and held.read("fixed").count() == 1
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id string")
    assert {tuple(r) for r in store.consistency(a=ids("1", "2"), b=ids("2", "3")).collect()} == {("a", "b", "1"), ("b", "a", "3")}


def test_ingest_replaces_documents(spark, tmp_path):
    held = store.ChunkStore(spark, f"file://{tmp_path}/s")
    batch = lambda *rows: spark.createDataFrame(rows, "relative_path string, text string, position int")
    ingest_batch(held, batch(("p", "one two three", 0), ("q", "x y", 0)), 2, 0)
    for _ in range(2):  # a retried batch changes nothing
        ingest_batch(held, batch(("p", "old", 0), ("p", "new text", 1)), 2, 0)
        assert {(r["relative_path"], r["text"]) for r in held.read("fixed").collect()} == {("p", "new text"), ("q", "x y")}


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 23:00:00", "a", 2.0), ("2024-01-02 00:00:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["events"], r["total"]) for r in windowed_costs(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_shared_tables(spark):
    from types import SimpleNamespace

    from spanloom import shared

    table = shared.written(spark.range(5).toDF("id"), "some")
    path = shared._PATHS[id(table)]
    assert table.count() == 5
    shared.discard(table)
    assert id(table) not in shared._PATHS and all(p != path for _, p in shared._OWNED)
    with pytest.raises(Exception, match="(?i)not.?exist|not found|FAILED_READ"):
        table.count()
    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.work_dir(elsewhere)
