"""Reciprocal rank fusion of rankings, with weights, ablation and sweeps; hydration and reranking of the winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import terms
from spanloom.operators.lexical import ranked

RANK_CONSTANT = 60
CANDIDATES = 50  #: each index is searched to max(k, CANDIDATES) before fusion
RERANK_DEPTH = 20


def unified(rankings: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """One table (retriever, query_id, chunk_id, score, rank) of several rankings; ``only`` keeps some of them."""
    unknown = sorted(set(only or []) - set(rankings))
    if unknown:
        raise ValueError(f"unknown retrievers: {', '.join(unknown)}")
    out = None
    for name, ranking in sorted(rankings.items()):
        if only is None or name in only:
            part = ranking.select(F.lit(name).alias("retriever"), "query_id", "chunk_id", "score", "rank")
            out = part if out is None else out.unionByName(part)
    return out


def reciprocal_rank_fusion(rankings: DataFrame, weights: dict[str, float] | None = None, rank_constant: float = RANK_CONSTANT, limit: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, hits, rank): sum of weight / (constant + rank) over the retrievers that found a chunk.

    Scores of 0 are left out; order is score descending, then id ascending.  hits maps each retriever that found the
    chunk to its rank, score and contribution; one that didn't is absent.
    """
    if rank_constant <= 0 or limit <= 0:
        raise ValueError("rank_constant and limit must be positive")
    if weights and min(weights.values()) < 0:
        raise ValueError("weights can't be negative")
    weight: Column = F.lit(1.0)
    for name, value in sorted((weights or {}).items()):
        weight = F.when(F.col("retriever") == name, F.lit(float(value))).otherwise(weight)
    rows = rankings.withColumn("contribution", weight / (F.lit(float(rank_constant)) + F.col("rank")))
    hit = F.struct("retriever", F.struct("rank", "score", F.round("contribution", 9).alias("contribution")).alias("hit"))
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("contribution"), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(hit))).alias("hits"))
    return ranked(fused.where("score > 0"), limit)


def check_weights(weights: dict[str, float], retrievers: list[str]) -> None:
    unknown = sorted(set(weights) - set(retrievers))
    if unknown:
        raise ValueError(f"weights for unknown retrievers: {', '.join(unknown)}")


def weight_sweep(rankings: DataFrame, retriever: str, values: list[float], rank_constant: float = RANK_CONSTANT, limit: int = 10) -> DataFrame:
    """Fusions for several weights of one retriever in one plan: (weight, query_id, chunk_id, score, rank)."""
    grid = F.explode(F.array(*(F.lit(float(v)) for v in values))).alias("weight")
    rows = rankings.select("*", grid)
    part = F.when(F.col("retriever") == retriever, F.col("weight")).otherwise(1.0) / (F.lit(float(rank_constant)) + F.col("rank"))
    fused = rows.groupBy("weight", "query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    order = Window.partitionBy("weight", "query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hydrate(results: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Results in their order with the chunk's columns, joined after the top-k; an id without a chunk is an error."""
    marked = chunks.withColumn("_held", F.lit(True))
    joined = results.join(marked, key, "left")
    known = F.when(F.col("_held").isNull(), F.raise_error(F.concat(F.lit("no chunk with id "), F.col(key).cast("string")))).otherwise(F.col(key))
    return joined.withColumn(key, known).drop("_held")


def term_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that occur in the text: the offline stand-in for a joint scorer."""
    asked = F.array_distinct(terms(question))
    return F.size(F.array_intersect(asked, terms(text))) / F.nullif(F.size(asked), F.lit(0))


def rerank(results: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = term_overlap, depth: int = RERANK_DEPTH) -> DataFrame:
    """The first ``depth`` results scored jointly with the question: best k by that score, then id; the fused score stays.

    results: query_id, chunk_id, score, rank, question, text.
    """
    scored = results.where(F.col("rank") <= depth).withColumn("rerank_score", F.round(F.coalesce(scorer(F.col("question"), F.col("text")), F.lit(0.0)), 6)).withColumnRenamed("rank", "fused_rank")
    return ranked(scored, k, "rerank_score")
