"""Text functions against the vectors of the specification."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.ids import cache_key, chunk_id, document_id, section_id
from spanloom.functions.vectors import dot, hashed_terms, l2_normalised
from spanloom.shared import slices


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


TERMS = {
    "response_model": ["response_model", "response", "model"],
    '@app.get("/items/")': ["app.get", "app", "get", "items"],
    "HTTPException(status_code=404)": ["httpexception", "http", "exception", "status_code", "status", "code", "404"],
    "Hello, world!": ["hello", "world"],
    "cosine above 0.95": ["cosine", "above", "0.95"],
    "---": [],
    "": [],
}
CITED = {"x [1][3]": [1, 3], "x [1, 3]": [1, 3], "[3] a [1] b [3]": [3, 1], "a `argv[1]` b [2]": [2], "```\n[2248755]\n```\nx [4]": [4], "```\nopen [7]": [], "none": []}


def test_terms_and_citations(spark):
    rows = spark.createDataFrame(list(TERMS.items()), "t string, want array<string>")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", T.terms(F.col("t"))).collect())
    rows = spark.createDataFrame(list(CITED.items()), "t string, want array<int>")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", T.citation_numbers(F.col("t"))).collect())


def test_normalise_keeps_indentation(spark):
    assert one(spark, T.normalise_text(F.lit("\n a  \r\n\r\n\r\n\r\n  b\t\rc\n"))) == "a\n\n  b\nc"


def test_only_line_feeds_end_lines(spark):
    assert one(spark, T.normalise_text(F.lit("a \u2028b \u0085c\t\u2029 d  \ne "))) == "a \u2028b \u0085c\t\u2029 d\ne"


def test_slices_follow_the_bytes_of_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["xx", None, "yyyyyyyyy", "z", "zz", ""])], names=["id", "text"])
    assert [s.column(0).to_pylist() for s in slices(batch, 1, 4)] == [[0, 1], [2], [3, 4, 5]]
    assert [s.column(0).to_pylist() for s in slices(batch, 1, 100, 4)] == [[0, 1, 2, 3], [4, 5]]
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_sentences_paragraphs_and_spans(spark):
    assert one(spark, T.sentences(F.lit('One. Two! "Three" is here? (Four). five.\n\nSix.'))) == ["One.", "Two!", '"Three" is here?', "(Four). five.", "Six."]
    assert one(spark, T.paragraphs(F.lit("a\n \nb\nc"))) == ["a", "b\nc"]
    spans = one(spark, T.piece_spans(F.array(F.lit("😀a"), F.lit("bc")), 1))
    assert [(s["start"], s["stop"]) for s in spans] == [(0, 2), (3, 5)]


def test_assertions_sentinel_and_labels(spark):
    assert one(spark, T.is_assertion(F.lit("ab [1]"))) is False
    assert one(spark, T.is_assertion(F.lit("abc [1]"))) is True
    assert one(spark, T.is_assertion(F.lit("|---|:--|"))) is False
    assert one(spark, T.is_insufficient(F.lit(' "INSUFFICIENT_CONTEXT". '))) is True
    assert [one(spark, T.bare_line(F.lit(x))) for x in ("  - > item", "> - item", "1) - item", ">> item")] == ["> item", "item", "- item", "> item"]
    assert one(spark, T.labelled_value(F.lit("**Verdict:** correct\nREASON: x"), "VERDICT", ["CORRECT"])) == "CORRECT"
    assert one(spark, T.labelled_value(F.lit("VERDICT: maybe"), "VERDICT", ["CORRECT"])) is None


def test_ids(spark):
    sha1 = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert one(spark, document_id(F.lit("a/b.md"))) == sha1("a/b.md")
    assert one(spark, chunk_id(F.lit("d"), F.lit("fixed"), F.lit(3))) == sha1("d:fixed:3")
    assert one(spark, section_id(F.lit("p"), F.array(F.lit("A"), F.lit("B")))) == sha1("p#A > B")
    assert one(spark, section_id(F.lit("p"), F.array(F.lit("A")), F.lit("page=2"))) == sha1("p#A#page=2")
    assert one(spark, cache_key(F.lit("m"), F.lit(None).cast("string"), F.lit("t"))) == hashlib.sha256(b"m\0\0t").hexdigest()


def test_vectors(spark):
    assert one(spark, dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    assert one(spark, l2_normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, l2_normalised(F.array(F.lit(0.0)))) == [0.0]
    rows = hashed_terms(spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string"), "id", 8).collect()
    assert [r["id"] for r in rows] == [1] and abs(sum(x * x for x in rows[0]["vector"]) - 1) < 1e-9
