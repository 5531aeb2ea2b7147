"""Golden questions: where their quotes lie in the corpus, and whether their shape is right."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.shared import bounded_batches, written

CATEGORIES = ("lookup", "multi_hop", "ambiguous", "no_answer", "off_topic")
QUOTES_PER_BLOCK = 4000  #: quotes searched for in one pass over the documents; more quotes, more passes
ANSWERABLE = ("lookup", "multi_hop", "ambiguous")


def occurrences(text: Column, quote: Column) -> Column:
    """Non-overlapping occurrences of the quote; none for an empty quote."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")).otherwise(0)


def find_quotes(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(question_id, relative_path, start_char, occurrences): the documents that hold a quote, its first place and how often it occurs.

    documents: relative_path, text; quotes: question_id, quote; rows with a null or empty quote find nothing.  One pass
    over the texts with an automaton of ``QUOTES_PER_BLOCK`` quotes; blocks beyond the first are tables before the next
    is read.  Occurrences don't overlap.
    """
    bounded_batches(documents.sparkSession)
    held = quotes.where("question_id IS NOT NULL AND quote != ''").select("question_id", "quote").distinct()
    n = -(-held.count() // QUOTES_PER_BLOCK)
    asked_type, path_type = quotes.schema["question_id"].dataType, documents.schema["relative_path"].dataType
    kind = T.StructType([T.StructField("question_id", asked_type), T.StructField("relative_path", path_type), T.StructField("start_char", T.IntegerType()), T.StructField("occurrences", T.IntegerType())])

    def searching(block: list[tuple]) -> Callable:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            owners: dict[str, list] = {}
            for name, quote in block:
                owners.setdefault(quote, []).append(name)
            automaton = ahocorasick.Automaton()
            for quote, names in owners.items():
                automaton.add_word(quote, (quote, names))
            automaton.make_automaton()
            schema = to_arrow_schema(kind)
            for batch in batches:
                found = []
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen = {quote: names for _, (quote, names) in automaton.iter(text)}
                    found += [(name, path, text.index(quote), text.count(quote)) for quote, names in seen.items() for name in names]
                columns = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return search

    out = None
    for k in range(n):
        block = [(r["question_id"], r["quote"]) for r in (held if n == 1 else held.where(F.pmod(F.xxhash64("question_id", "quote"), F.lit(n)) == k)).collect()]
        if block:
            own = documents.where("text IS NOT NULL").select("relative_path", "text").mapInArrow(searching(block), kind)
            own = own if n == 1 else written(own, "quotes")
            out = own if out is None else out.unionByName(own)
    return documents.sparkSession.createDataFrame([], kind) if out is None else out


def _loose(quote: Column) -> Column:
    """A pattern for the quote in which any run of white space matches any other."""
    plain = F.replace(F.trim(quote), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), F.regexp_replace(plain, r"\s+", r"\\E\\s+\\Q"), F.lit("\\E"))


def locate(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Quotes with their place: status, start_char, end_char (null unless ``located``).

    spans: question_id, relative_path, quote; documents: relative_path, text.  Exactly one exact occurrence locates a
    quote; without any, exactly one that differs in white space only does; otherwise the status says why not:
    missing_document, not_found or ambiguous.
    """
    rows = spans.join(documents.select("relative_path", "text"), "relative_path", "left")
    exact, pattern = occurrences(F.col("text"), F.col("quote")), _loose(F.col("quote"))
    loose = F.when(exact == 0, F.regexp_count("text", pattern)).otherwise(0)
    rows = rows.withColumns({"_exact": exact, "_loose": loose})
    status = F.when(F.col("text").isNull(), "missing_document").when(F.col("_exact") == 1, "located").when(F.col("_exact") > 1, "ambiguous").when(F.col("_loose") == 1, "located").when(F.col("_loose") > 1, "ambiguous").otherwise("not_found")
    before = F.when(F.col("_exact") == 1, F.expr("locate(quote, text) - 1"))
    start = F.coalesce(before, F.when(F.col("_loose") == 1, F.length(F.element_at(F.split("text", pattern, 2), 1))))
    size = F.when(F.col("_exact") == 1, F.length("quote")).otherwise(F.length(F.call_function("regexp_extract", F.col("text"), F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))))
    rows = rows.withColumn("status", status)
    located = F.col("status") == "located"
    return rows.select("question_id", "relative_path", "quote", "status", F.when(located, start).cast("int").alias("start_char"), F.when(located, start + size).cast("int").alias("end_char"))


def shape_errors(questions: DataFrame, spans: DataFrame) -> DataFrame:
    """(question_id, error) for questions whose spans don't suit their category.

    lookup has one span; multi_hop two or more in two documents or more; ambiguous two or more; no_answer and
    off_topic none; a held_out question needs a source_url.
    """
    counts = spans.groupBy("question_id").agg(F.count("*").alias("n"), F.countDistinct("relative_path").alias("docs"))
    rows = questions.join(counts, "question_id", "left").fillna(0, ["n", "docs"])
    c = F.col("category")
    error = F.when(~c.isin(*CATEGORIES), "unknown category").when((c == "lookup") & (F.col("n") != 1), "lookup needs one span").when((c == "multi_hop") & ((F.col("n") < 2) | (F.col("docs") < 2)), "multi_hop needs spans in two documents").when((c == "ambiguous") & (F.col("n") < 2), "ambiguous needs two spans").when(c.isin("no_answer", "off_topic") & (F.col("n") > 0), "unanswerable questions have no spans").when((F.col("split") == "held_out") & (F.coalesce("source_url", F.lit("")) == ""), "held_out needs a source url")
    return rows.withColumn("error", error).where("error IS NOT NULL").select("question_id", "error")


def select(questions: DataFrame, split: str | None = None, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Verified questions of a split and of some categories; none at all is an error."""
    rows = questions.where("verified")
    rows = rows if split is None else rows.where(F.col("split") == split)
    rows = rows if categories is None else rows.where(F.col("category").isin(*categories))
    if rows.isEmpty():
        raise ValueError("no verified question is left")
    return rows
