"""BM25 over postings tables: build once, answer whole tables of questions.

k1, b and the floor for terms in more than half of the chunks are those of Okapi BM25 as commonly packaged: a
negative inverse document frequency is replaced by ``EPSILON`` times the mean of all raw ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.kernels import term_lists, weighted_scores
from spanloom.shared import written

K1, B, EPSILON = 1.5, 0.75, 0.25


QUESTIONS_PER_BLOCK = 2048  #: questions that a task scores at once; more questions, more passes


@dataclass(frozen=True)
class LexicalIndex:
    """chunks (chunk_id, dl, terms, tfs), stats (term, df, idf) and corpus (one row: n, avgdl)."""

    chunks: DataFrame
    stats: DataFrame
    corpus: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, term, tf)."""
        return _postings(self.chunks)


def _postings(lists: DataFrame) -> DataFrame:
    pairs = F.arrays_zip("terms", "tfs")
    return lists.select("chunk_id", F.explode(pairs).alias("p")).select("chunk_id", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))


def postings_of(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(chunk_id, term, tf) of every row, counted within the row: no shuffle; a null text has no terms."""
    return _postings(term_lists(chunks, key))


def statistics(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term statistics and the one-row corpus table of term lists, as tables in the shared folder; chunks without terms count."""
    corpus = written(lists.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).select("n", (F.col("total") / F.nullif("n", F.lit(0))).alias("avgdl")), "corpus-stats")
    df = written(lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "term-counts")
    raw = df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    stats = raw.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return stats, corpus


def build(chunks: DataFrame, key: str = "chunk_id") -> LexicalIndex:
    """Index of chunks with ``key`` and ``text``; statistics never mix strategies: build one index for each.

    Term lists and statistics are tables in the shared folder: no text is cut twice.
    """
    lists = written(term_lists(chunks, key), "term-lists")
    stats, corpus = statistics(lists)
    return LexicalIndex(lists, stats, corpus)


def ranked(scores: DataFrame, k: int, score: str = "score", item: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """The k best of each question with ``rank`` from 1: score descending, then id ascending."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: LexicalIndex, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each question; only positive scores count.

    questions: ``query_id`` and ``question``.  A repeated term counts as often as it is asked for.  Every task scores
    its chunks for a block of questions and keeps the k best of each, so no posting is shuffled; blocks beyond the
    first are tables before the next is asked.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = _postings(term_lists(questions.select("query_id", F.col("question").alias("text")), "query_id")).withColumnRenamed("chunk_id", "query_id")
    weighted = asked.join(index.stats.select("term", "idf"), "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    average = index.corpus.first()["avgdl"]
    best = lambda block: ranked(weighted_scores(index.chunks, block, k, float(average or 1), K1, B), k)
    return in_blocks(weighted, questions.select("query_id").distinct().count(), best, ranked(index.chunks.select(F.lit(None).cast(dict(questions.dtypes)["query_id"]).alias("query_id"), "chunk_id", F.lit(0.0).alias("score")), k))


def in_blocks(asked: DataFrame, questions: int, best, empty: DataFrame, size: int = QUESTIONS_PER_BLOCK) -> DataFrame:
    """The best of all questions, ``size`` of them at a time; the driver and a task hold one block, and of a block of several only its best are kept."""
    n = -(-questions // size)
    out = None
    for k in range(n):
        block = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)).toArrow()
        if block.num_rows:
            own = best(block)
            own = own if n == 1 else written(own, "block-scores")
            out = own if out is None else out.unionByName(own)
    return empty.limit(0) if out is None else out
