"""Named queries over the test tables.

The tables play the reference roles: ``documents`` the corpus (one path a document), ``benchmark`` the golden
quotes and, as they are, the questions; ``embeddings`` the vectors; ``conversations`` answers; ``labels``
two labellers; ``events`` request logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.ids import chunk_id, document_id, section_id
from spanloom.functions.kernels import hashed_vectors
from spanloom.functions.vectors import hashed_terms
from spanloom.operators import answering, chunking, dedup, dense, fusion, generation, golden, lexical, metrics, models, quality, reports, stats
from spanloom.plans.oracles import oracle_sql  # noqa: F401
from spanloom.shared import table_path, work_dir, written
from spanloom.sources import evaluation, files, store

MAX, OVERLAP = 64, 8  #: chunk size of the queries; the operators default to 512 and 64
DISTRACTOR = "doc/0"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(doc_id: Column) -> Column:
    return F.concat(F.lit("doc/"), doc_id.cast("string"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(_path(F.col("doc_id")).alias("relative_path"), "text", "source")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(_documents(spark, sf_dir), MAX, OVERLAP)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("text").alias("quote"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each benchmark passage lies: the documents that hold it once. A passage in none has no span."""
    items = _questions(spark, sf_dir).select(F.col("query_id").alias("question_id"), "quote")
    rows = golden.find_quotes(_documents(spark, sf_dir), items).where("occurrences = 1").join(items, "question_id")
    return rows.select("question_id", F.col("relative_path").alias("span"), "relative_path", "start_char", (F.col("start_char") + F.length("quote")).alias("end_char"))


def _categories(spans: DataFrame) -> DataFrame:
    return spans.groupBy("question_id").agg(F.when(F.count("*") > 1, "ambiguous").otherwise("lookup").alias("category"))


def _dense(spark: SparkSession, sf_dir: str, lists: DataFrame, k: int = fusion.CANDIDATES) -> DataFrame:
    asked = hashed_terms(_questions(spark, sf_dir).select("query_id", F.col("question").alias("text")), "query_id")
    return dense.top_k(hashed_vectors(lists, "chunk_id"), asked, k)


_STORES: dict[tuple[str, str, str], tuple[str, lexical.LexicalIndex]] = {}


def _index(spark: SparkSession, sf_dir: str, strategy: str = "fixed") -> tuple[DataFrame, lexical.LexicalIndex]:
    """(chunks, lexical index) of a strategy, from stores that the first query of a session builds and the others read; whole documents are no chunks to store."""
    key = (spark.sparkContext.applicationId, sf_dir, strategy)
    if key not in _STORES:
        root = table_path(spark, "index")
        held, terms = store.ChunkStore(spark, f"{root}/chunks", 16), store.LexicalStore(spark, f"{root}/terms", 16)
        if strategy != "documents":
            held.replace(strategy, {"fixed": _chunks, "structure": _structure, "semantic": _semantic}[strategy](spark, sf_dir))
        terms.index(strategy, _whole(spark, sf_dir) if strategy == "documents" else held.read(strategy))
        _STORES[key] = root, terms.load(strategy)
    root, index = _STORES[key]
    return _whole(spark, sf_dir) if strategy == "documents" else store.ChunkStore(spark, f"{root}/chunks", 16).read(strategy), index


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), _path(F.col("doc_id")).alias("relative_path"), "text")


def _rankings(spark: SparkSession, sf_dir: str, k: int = fusion.CANDIDATES, strategy: str = "fixed") -> tuple[DataFrame, DataFrame]:
    """(chunks, both rankings as one table); the rankings are a table in the shared folder, as every arm reads them."""
    chunks, index = _index(spark, sf_dir, strategy)
    sparse = lexical.search(index, _questions(spark, sf_dir), k)
    return chunks, written(fusion.unified({"dense": _dense(spark, sf_dir, index.chunks, k), "sparse": sparse}), "rankings")


def _arms(spark: SparkSession, sf_dir: str, limit: int = 10, strategy: str = "fixed", reranked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, ranked chunks of the arms hybrid, dense and sparse, and if wanted rerank, with places and token counts)."""
    chunks, rankings = _rankings(spark, sf_dir, strategy=strategy)
    fused = fusion.reciprocal_rank_fusion(rankings, limit=max(limit, fusion.RERANK_DEPTH)).select("query_id", "chunk_id", "score", "rank")
    hybrid = fused.where(F.col("rank") <= limit).select(F.lit("hybrid").alias("arm"), "query_id", "chunk_id", "rank")
    rows = hybrid.unionByName(rankings.where(F.col("rank") <= limit).select(F.col("retriever").alias("arm"), "query_id", "chunk_id", "rank"))
    if reranked:
        joint = fusion.hydrate(fused, chunks).join(_questions(spark, sf_dir).select("query_id", "question"), "query_id")
        rows = rows.unionByName(fusion.rerank(joint, 5).select(F.lit("rerank").alias("arm"), "query_id", "chunk_id", "rank"))
    rows = rows.join(chunks.select("chunk_id", "relative_path", "start_char", "end_char", "token_count"), "chunk_id")
    return chunks, written(rows.withColumnRenamed("query_id", "question_id"), "arms")


def _scored(spark: SparkSession, sf_dir: str, strategy: str = "fixed", gains: bool = False) -> tuple[DataFrame, DataFrame]:
    """(per-question metrics, categories); with ``gains`` nDCG too, and the reranked arm."""
    chunks, arms = _arms(spark, sf_dir, strategy=strategy, reranked=gains)
    spans = written(_spans(spark, sf_dir), "spans")
    scored = metrics.per_question(arms, spans, _categories(spans), budget=400)
    if gains:
        scored = scored.join(metrics.ndcg(arms, chunks, spans, _categories(spans)).select("arm", "question_id", "ndcg"), ["arm", "question_id"])
    return scored, _categories(spans)


# -- text, tokens, chunks -----------------------------------------------------------------------------------------


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings_of(_t(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("chunk_id", "doc_id")


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tokenize_terms(spark, sf_dir)
    return terms.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("distinct_terms"), F.max("tf").alias("max_tf"))


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.normalise_text(F.concat(F.col("text"), F.lit(" \r\n\n\n\nend  ")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha1(clean).alias("content_hash"), F.length(clean).alias("n_chars"))


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("relative_path")
    doc = document_id(path)
    return _documents(spark, sf_dir).select("relative_path", doc.alias("doc_id"), section_id(path, F.array("source", F.lit("body")), F.lit("occurrence=1")).alias("section_id"), chunk_id(doc, F.lit("fixed"), F.lit(0)).alias("first_chunk_id"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.token_table(_t(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "relative_path", "chunk_index", "start_char", "end_char", "token_count", F.sha1("text").alias("text_hash"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(_chunks(spark, sf_dir))


def _line_sections(documents: DataFrame) -> DataFrame:
    """A section for each line of a document."""
    rows = documents.select("relative_path", F.posexplode(F.arrays_zip(F.split("text", "\n").alias("line"), T.piece_spans(F.split("text", "\n"), 1).alias("at"))).alias("i", "x"))
    path = F.array(F.concat(F.lit("line "), F.col("i").cast("string")))
    return rows.select("relative_path", F.concat_ws("#", "relative_path", F.col("i").cast("string")).alias("section_id"), path.alias("heading_path"), F.lit(None).cast("int").alias("page"), F.col("x.at.start").alias("start_char"), F.col("x.at.stop").alias("end_char"))


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.with_sections(_chunks(spark, sf_dir).select("chunk_id", "relative_path", "chunk_index", "start_char", "end_char"), _line_sections(_documents(spark, sf_dir)))
    return rows.select("chunk_id", F.size("section_ids").alias("sections"), F.try_element_at("section_ids", F.lit(1)).alias("first_section"), F.array_join("heading_path", " > ").alias("heading"))


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", "i", F.length("sentence").alias("n_chars"), F.sha1("sentence").alias("digest"))


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.concat(F.col("text"), F.lit("\n \n"), F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    rows = _t(spark, sf_dir, "conversations").withColumn("two", two).select("conv_id", "turn", F.posexplode(T.paragraphs(F.col("two"))).alias("i", "paragraph"))
    return rows.select("conv_id", "turn", "i", F.sha1("paragraph").alias("digest"))


# -- lexical, dense, fusion ---------------------------------------------------------------------------------------


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats_ = _index(spark, sf_dir, "documents")[1].stats
    return stats_.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_index(spark, sf_dir, "documents")[1], _questions(spark, sf_dir), 10).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_index(spark, sf_dir)[1], _questions(spark, sf_dir), 10)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return rows, rows.where(F.pmod("chunk_id", F.lit(100)) == 0).select(F.col("chunk_id").alias("query_id"), "vector", F.col("label").alias("query_label"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return dense.top_k(*_vectors(spark, sf_dir), 10)


def dense_label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _vectors(spark, sf_dir)
    found = dense.top_k(rows, asked, 11).where(F.col("query_id") != F.col("chunk_id")).join(rows.select("chunk_id", "label"), "chunk_id").join(asked.select("query_id", "query_label"), "query_id")
    return found.groupBy("query_id").agg(F.count("*").alias("neighbours"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("precision"))


def dense_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.lsh_top_k(*_vectors(spark, sf_dir), 10)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_rankings(spark, sf_dir)[1]).select("query_id", "chunk_id", "score", "rank")


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"dense": 2.0, "sparse": 1.0}
    fusion.check_weights(weights, ["dense", "sparse"])
    return fusion.reciprocal_rank_fusion(_rankings(spark, sf_dir)[1], weights).select("query_id", "chunk_id", "score", "rank")


def rrf_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = _rankings(spark, sf_dir)[1]
    out = None
    for name in ("dense", "sparse"):
        own = fusion.reciprocal_rank_fusion(rankings.where(F.col("retriever") == name)).select(F.lit(name).alias("retriever"), "query_id", "chunk_id", "score", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def rrf_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(_rankings(spark, sf_dir)[1])
    of = lambda name: F.try_element_at("hits", F.lit(name))["rank"]
    return fused.select("query_id", "chunk_id", "rank", of("dense").alias("dense_rank"), of("sparse").alias("sparse_rank"), (F.size("hits") > 1).alias("in_both"))


def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weight_sweep(_rankings(spark, sf_dir)[1], "dense", [0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0], limit=5)


def hydrate_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, rankings = _rankings(spark, sf_dir)
    fused = fusion.reciprocal_rank_fusion(rankings, limit=5).select("query_id", "chunk_id", "rank")
    return fusion.hydrate(fused, chunks).select("query_id", "rank", "chunk_id", "relative_path", "chunk_index", F.sha1("text").alias("text_hash"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, rankings = _rankings(spark, sf_dir)
    fused = fusion.reciprocal_rank_fusion(rankings, limit=fusion.RERANK_DEPTH).select("query_id", "chunk_id", "score", "rank")
    rows = fusion.hydrate(fused, chunks).join(_questions(spark, sf_dir).select("query_id", "question"), "query_id")
    return fusion.rerank(rows, 5).select("query_id", "chunk_id", "rerank_score", "rank")


# -- duplicates ---------------------------------------------------------------------------------------------------


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("relative_path"), "text")


def exact_dedup_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_by_source(spark, sf_dir), ["chunk_id"], "document")


def exact_dedup_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_by_source(spark, sf_dir), ["chunk_id"], "corpus")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy near-duplicates among the chunks of each document."""
    found = dedup.near_duplicates(dedup.with_vectors(_chunks(spark, sf_dir), ["chunk_index"]), ["chunk_index"])
    return found.withColumn("similarity", F.round("similarity", 6))


def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_source(spark, sf_dir)
    return dedup.summary(rows, dedup.exact_duplicates(rows, ["chunk_id"], "corpus").withColumn("exact", F.lit(True)))


# -- golden spans and metrics -------------------------------------------------------------------------------------


def locate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).select("question_id", "relative_path").join(_questions(spark, sf_dir).select(F.col("query_id").alias("question_id"), "quote"), "question_id")
    found = golden.locate(spans, _documents(spark, sf_dir))
    return found.select("question_id", "relative_path", "status", "start_char", "end_char")


def quote_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each passage occurs, and how often in all."""
    found = golden.find_quotes(_documents(spark, sf_dir), _questions(spark, sf_dir).select(F.col("query_id").alias("question_id"), "quote"))
    hit = found.groupBy(F.col("question_id").alias("query_id")).agg(F.count("*").alias("documents"), F.sum("occurrences").alias("occurrences"))
    return _questions(spark, sf_dir).select("query_id").join(hit, "query_id", "left").fillna(0)


def ideal_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select("chunk_id", "relative_path", "start_char", "end_char")
    spans = _spans(spark, sf_dir).select("question_id", "relative_path", F.col("start_char").alias("s"), F.col("end_char").alias("e"))
    rows = chunks.join(spans, "relative_path").where((F.col("start_char") < F.col("e")) & (F.col("end_char") > F.col("s")))
    return rows.select("question_id", "chunk_id", (F.least("end_char", "e") - F.greatest("start_char", "s")).alias("overlap"))


def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, arms = _arms(spark, sf_dir)
    return metrics.span_coverage(arms, _spans(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("arm", "question_id", "hit_1", "hit_3", "hit_5", "hit_10")


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("arm", "question_id", "first_hit_rank", "reciprocal_rank")


def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("arm", "question_id", "budget_hit")


def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, arms = _arms(spark, sf_dir)
    spans = written(_spans(spark, sf_dir), "spans")
    return metrics.ndcg(arms, chunks, spans, _categories(spans))


def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that no chunk of the index overlaps: none for windows without gaps."""
    pools = ideal_pools(spark, sf_dir).select("question_id").distinct()
    return _spans(spark, sf_dir).select("question_id").distinct().join(pools.withColumn("held", F.lit(True)), "question_id", "left").select("question_id", F.coalesce("held", F.lit(False)).alias("reachable"))


def arm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.arm_means(_scored(spark, sf_dir)[0], ["arm"])


def arm_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, categories = _scored(spark, sf_dir)
    return metrics.arm_means(scored.join(categories, "question_id"), ["arm", "category"])


def leader_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leader(arm_grid(spark, sf_dir), second="mrr").select("arm", "recall_5", "mrr")


def strategy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy with every retriever and with reranking: recall, MRR, nDCG and recall within the budget."""
    out = None
    for strategy in chunking.STRATEGIES:
        own = metrics.arm_means(_scored(spark, sf_dir, strategy, gains=True)[0], ["arm"]).withColumn("arm", F.concat("arm", F.lit(f"/{strategy}")))
        out = own if out is None else out.unionByName(own)
    return out


def leader_by_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leader(strategy_grid(spark, sf_dir)).select("arm", "recall_5", "ndcg_10")


def rerank_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether reranking separates from the hybrid arm, for each strategy."""
    out = None
    for strategy in chunking.STRATEGIES:
        own = _scored(spark, sf_dir, strategy, gains=True)[0].select(F.lit(strategy).alias("strategy"), "arm", "question_id", "hit_5")
        out = own if out is None else out.unionByName(own)
    return reports.rerank_verdict(written(out, "grid"))


def is_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = written(_spans(spark, sf_dir), "spans")
    return metrics.is_hit(_arms(spark, sf_dir)[1], spans, _categories(spans))


def tier1_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hits joined to answers of the same arms and of one that was never scored."""
    scored = _scored(spark, sf_dir)[0]
    path = table_path(spark, "results")
    evaluation.save_results(scored, path)
    answered = scored.select("arm", F.col("question_id").cast("string").alias("question_id"))
    records = answered.unionByName(answered.where("arm = 'dense'").withColumn("arm", F.lit("other")))
    return evaluation.with_retrieval(records, evaluation.load_results(spark, path)).select("arm", "question_id", "span_retrieved")


def distractor_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distractor_rate(_arms(spark, sf_dir)[1], DISTRACTOR)


def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: recall for each arm, and for each arm and category, in one pass."""
    scored, categories = _scored(spark, sf_dir)
    rows = scored.join(categories, "question_id").groupingSets([["arm"], ["arm", "category"]], "arm", "category")
    return rows.agg(F.coalesce(F.col("category"), F.lit("all")).alias("slice"), F.count("*").alias("questions"), F.round(F.avg(F.col("hit_5").cast("double")), 6).alias("recall_5")).select("arm", "slice", "questions", "recall_5")


# -- statistics ---------------------------------------------------------------------------------------------------

RESAMPLES = stats.RESAMPLES


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_interval(_labels(spark, sf_dir), "doc_id", "a", RESAMPLES)


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_delta(_labels(spark, sf_dir), "doc_id", "a", "b", RESAMPLES)


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kappa(_labels(spark, sf_dir), "a", "b")


def bootstrap_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_kappa(_labels(spark, sf_dir), "doc_id", "a", "b", RESAMPLES)


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label pair with its place and whether it agrees."""
    rows = stats.numbered(_labels(spark, sf_dir), "doc_id", "position")
    return rows.select("doc_id", "position", (F.col("a") == F.col("b")).alias("agree"))


def seeded_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).select(F.lit("quality").alias("series"), F.col("doc_id").alias("question_id"), F.col("a").alias("value"))
    return stats.seeded_interval(rows, "series", "value")


# -- answering ----------------------------------------------------------------------------------------------------


def _retrieved(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    chunks, rankings = _rankings(spark, sf_dir)
    fused = fusion.reciprocal_rank_fusion(rankings, limit=k)
    rows = fusion.hydrate(fused, chunks).withColumn("heading_path", F.array(F.concat(F.lit("chunk "), F.col("chunk_index").cast("string"))))
    asked = _questions(spark, sf_dir).select("query_id", "question", "quote")
    return asked.join(answering.retrieved_sets(rows), "query_id", "left")


def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answering.with_gate(_retrieved(spark, sf_dir), threshold=0.55)
    return rows.select("query_id", F.round("confidence", 6).alias("confidence"), "refusal", "both_agree")


def refusal_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = answering.with_gate(_retrieved(spark, sf_dir), threshold=0.55)
    known = _spans(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.lit(True).alias("answerable")).distinct()
    probes = gated.join(known, "query_id", "left").select(F.lit("hybrid").alias("arm"), F.coalesce("answerable", F.lit(False)).alias("answerable"), "confidence")
    return quality.refusal_calibration(probes, 0.55)


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answering.near_misses(_retrieved(spark, sf_dir))
    return rows.select("query_id", F.array_join(F.col("what_was_found.source"), "|").alias("found"), F.array_join("documents_to_check", "|").alias("documents_to_check"))


def confidence_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answering.with_gate(_retrieved(spark, sf_dir))
    agree = F.when(F.col("both_agree"), 1.0)
    parts = answering.composite({"agreement": agree, "retrieval": answering.ramp(F.col("confidence"))})
    return rows.select("query_id", parts["score"].alias("score"), F.array_join(parts["components"], ",").alias("components"))


def render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _retrieved(spark, sf_dir, 3)
    made = answering.prompt(F.col("question"), F.col("results"))
    return rows.select("query_id", F.length(made).alias("n_chars"), F.sha1(made).alias("digest"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers: each sentence cites by its length, some code is put in, so that parsing has work to do."""
    rows = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.length("text")
    cite = F.concat(F.lit(" ["), (F.pmod(n, F.lit(7))).cast("string"), F.lit(", "), (F.pmod(n, F.lit(5)) + 1).cast("string"), F.lit("] `x["), F.pmod(n, F.lit(3)).cast("string"), F.lit("]`"))
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), F.concat(F.col("text"), cite, F.lit(" Then more [2].")).alias("answer"))


def parse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("answer_id", F.array_join(F.transform(T.citation_numbers(F.col("answer")), lambda n: n.cast("string")), ",").alias("cited"))


def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answering.resolve_citations(F.col("answer"), F.lit(4))
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    return _answers(spark, sf_dir).select("answer_id", joined(found["resolved"]).alias("resolved"), joined(found["unresolved"]).alias("unresolved"), joined(found["uncited"]).alias("uncited"))


def split_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answering.split_claims(_answers(spark, sf_dir))
    return rows.select("answer_id", "index", "text", F.array_join(F.transform("citations", lambda n: n.cast("string")), ",").alias("citations"))


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.structural_coverage(answering.split_claims(_answers(spark, sf_dir)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.extractive_answers(answering.with_gate(_retrieved(spark, sf_dir), threshold=0.55).withColumn("results", F.coalesce("results", F.array().cast("array<struct<rank:int,chunk_id:string,relative_path:string,heading_path:array<string>,text:string,hits:map<string,struct<rank:int,score:double,contribution:double>>>>"))))
    return rows.withColumn("outcome", answering.outcome(F.col("reply"), F.col("refusal"))).withColumn("answer", F.when(F.col("outcome") == "answered", F.col("reply")))


def ask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir)
    cites = answering.resolve_citations(F.coalesce("answer", F.lit("")), F.size("results"))
    return rows.select("query_id", "outcome", "answer", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform(cites["resolved"], lambda n: n.cast("string")), ",").alias("citations"))


def verify_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(_asked(spark, sf_dir).select("query_id", "answer", "results"), "answers")
    claims = answering.split_claims(rows.select(F.col("query_id").alias("answer_id"), "answer"))
    return answering.verification_report(answering.verify(claims, rows, models.overlap_verifier))


def verification_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims verified against what they cite, and against chunks that their question didn't retrieve."""
    rows = written(_asked(spark, sf_dir).select("query_id", "answer", "results"), "answers")
    claims = answering.split_claims(rows.select(F.col("query_id").alias("answer_id"), "answer"))
    chunks = _index(spark, sf_dir)[0].select("chunk_id", "text")
    got = rows.select("query_id", F.explode("results").alias("r")).select("query_id", "r.chunk_id", F.col("r.rank").alias("rank"))
    other = quality.control_blocks(chunks, got).join(chunks, "chunk_id")
    control = other.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("results"))
    return reports.separation(answering.verify(claims, rows, models.overlap_verifier), answering.verify(claims, control, models.overlap_verifier))


def judge_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir)
    judged = models.overlap_judge(rows.select("query_id", F.col("quote").alias("reference"), F.coalesce("answer", F.lit("")).alias("answer"), answering.context(F.col("results")).alias("context")))
    return judged.select("query_id", answering.judgement(F.col("reply")).alias("j")).select("query_id", "j.verdict", "j.grounded")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records made from labels and documents: verdicts, refusals and citations by arithmetic on ids."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    n = F.col("n_chars")
    verdict = F.when((F.col("quality") == 1) & (F.pmod(n, F.lit(3)) > 0), "CORRECT").when(F.pmod(n, F.lit(2)) == 0, "PARTIAL").otherwise("INCORRECT")
    rows = rows.select(F.col("doc_id").alias("question_id"), F.col("source").alias("arm"), verdict.alias("verdict"), (F.col("toxic") == 0).alias("answerable"), (F.pmod(n, F.lit(5)) > 0).alias("span_retrieved"), (F.pmod(n, F.lit(7)) > 0).alias("answered"), F.when(F.pmod(n, F.lit(4)) > 0, F.pmod(n, F.lit(4)) == 1).alias("grounded"), F.pmod(n, F.lit(6)).alias("citations"), F.when(F.pmod(n, F.lit(11)) == 0, 1).otherwise(0).alias("fabricated_citations"))
    return rows.withColumn("failure", quality.classify(F.col("verdict"), F.col("answerable"), F.col("span_retrieved"), F.col("answered")))


def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("question_id", "verdict", "failure")


def failure_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failure_table(_records(spark, sf_dir))


def quality_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.series(_records(spark, sf_dir)).groupBy("arm").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("correct", "correct_or_partial", "grounded_score", "cited_honestly")))


def arm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request logs as answers: refusals, live answers, their median latency, costs."""
    n = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.pmod(n, F.lit(7)) > 0).alias("answered"), (F.pmod(n, F.lit(5)) == 0).alias("cached"), F.col("value").alias("latency_s"), (F.col("value") / 1000).alias("cost_usd"))
    return quality.arm_report(rows)


def judge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty answers to label by hand first."""
    return quality.judge_sample(_records(spark, sf_dir).withColumn("category", F.col("arm")), 40).select("question_id")


def cheapest_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as judges: their share of good documents as agreement, their length as cost."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    judges = rows.groupBy(F.col("source").alias("judge")).agg(F.round(F.avg("quality"), 6).alias("kappa"), F.sum("n_chars").alias("cost_usd"))
    return quality.cheapest_judge(judges)


def merged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("toxic") == 1, "INCORRECT").alias("human_verdict"))
    new = sheet.where("question_id % 2 = 0").select("question_id", F.lit("CORRECT").alias("human_verdict"))
    return quality.merge_verdicts(sheet, new)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(F.pmod(n, F.lit(2)) == 0, "gpt-4.1-mini").otherwise("gpt-4.1-nano").alias("model"), (F.pmod(n, F.lit(5)) == 0).alias("cached"), F.col("user_id").alias("prompt_tokens"), F.pmod(n, F.lit(500)).alias("completion_tokens"), F.pmod(n, F.lit(300)).alias("reasoning_tokens"))
    return models.priced(models.with_usage(rows))


def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).select("event_id", "input_tokens", "output_tokens", "thinking_tokens", F.round("cost_usd", 9).alias("cost_usd"))


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.ledger(_usage(spark, sf_dir))


def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of verifier, completeness scorer and judge in the forms that are tolerated, read back."""
    n = F.col("item_id")
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))
    rows = _t(spark, sf_dir, "benchmark").select(n, pick("SUPPORT: supported", "**SUPPORT:** Unsupported\nREASON: none", "thought\nSUPPORTED.\n").alias("support"), pick("COMPLETENESS: Complete", "**COMPLETENESS**: partial", "x\ncompleteness: MISSING").alias("completeness"), F.concat(pick("VERDICT: correct", "**VERDICT:** PARTIAL"), F.lit("\nGROUNDED: yes\nREASON: it is "), n.cast("string")).alias("judge"))
    judged = answering.judgement(F.col("judge"))
    return rows.select("item_id", answering.support(F.col("support")).alias("support"), answering.completeness(F.col("completeness")).alias("completeness"), judged["verdict"].alias("verdict"), judged["grounded"].alias("grounded"), judged["reason"].alias("reason"))


def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of judge and verifier over benchmark passages."""
    n, text = F.col("item_id"), F.col("text")
    result = lambda path, body: F.struct(F.lit(path).alias("relative_path"), F.array(F.lit("A"), F.lit("B")).alias("heading_path"), body.alias("text"))
    results = F.array(result("a.md", text), result("b.md", F.concat(F.lit("x "), text)))
    judge = answering.judge_prompt(text, F.when(F.pmod(n, F.lit(2)) == 0, F.lower(text)).otherwise(""), F.concat(F.lit(" so "), text), F.lit("some context"))
    verifier = answering.verification_prompt(F.concat(text, F.lit(" ")), F.array(F.lit(2), F.lit(9)), results)
    return _t(spark, sf_dir, "benchmark").select("item_id", F.sha1(judge).alias("judge"), F.sha1(verifier).alias("verifier"))


def refusal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answering.near_misses(_retrieved(spark, sf_dir))
    found = F.transform("what_was_found", lambda m: F.struct(m["source"].alias("source"), F.lit(None).cast("double").alias("similarity")))
    text = answering.refusal_text(F.lit("low_confidence"), found, F.lit("the answer"), F.col("documents_to_check"))
    return rows.select("query_id", F.sha1(text).alias("digest"))


def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").groupBy("source").agg((F.avg("n_chars") / 1000).alias("m"), (F.min("n_chars") / 1000).alias("a"), (F.max("n_chars") / 1000).alias("b"))
    return rows.select("source", reports.interval_text(F.col("m"), F.col("a"), F.col("b")).alias("interval"), reports.delta_text(F.col("m"), F.col("a") - 0.5, F.col("b")).alias("delta"))


# -- golden questions ---------------------------------------------------------------------------------------------


def eligible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"), "text")
    return generation.eligible(rows, ["src1/", "src2/9"]).select("relative_path")


def golden_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in marked blocks: whole, without a question, or without blocks."""
    n, text = F.col("item_id"), F.col("text")
    block = F.concat(F.lit("<<<ITEM>>>\nQUESTION: what of "), n.cast("string"), F.lit("\nANSWER: this\n<<<SPAN>>> a.md\n"), text, F.lit("\n\n```py\n\"x\"\n```\n<<<ENDSPAN>>>\n<<<SPAN>>> b.md\n\n<<<ENDSPAN>>>\n<<<ENDITEM>>>"))
    reply = F.when(n % 3 == 0, F.concat(F.lit("Here:\n"), block, F.lit("\n"), block)).when(n % 3 == 1, "<<<ITEM>>>\nANSWER: only\n<<<ENDITEM>>>").otherwise("I can't.")
    rows = generation.parsed_items(_t(spark, sf_dir, "benchmark").select(n.alias("reply_id"), reply.alias("reply")))
    return rows.select("reply_id", "i", "question", "answer", F.size("spans").alias("spans"), F.sha1(F.try_element_at("spans", F.lit(1))["quote"]).alias("quote"), "problem")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each passage that lies in a document, some spoilt."""
    n = F.col("question_id")
    held = _spans(spark, sf_dir).groupBy("question_id").agg(F.min("relative_path").alias("relative_path")).join(_questions(spark, sf_dir).select(F.col("query_id").alias("question_id"), "quote"), "question_id")
    quote = F.when(n % 4 == 1, F.concat("quote", F.lit("zz"))).otherwise(F.col("quote"))
    span = F.array(F.struct("relative_path", quote.alias("quote")))
    return held.select("question_id", F.when(n % 4 == 3, "no_answer").otherwise("lookup").alias("category"), F.lit("what?").alias("question"), F.when(n % 4 == 2, F.filter(span, lambda s: F.lit(False))).otherwise(span).alias("spans"))


def candidate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.judged_candidates(_candidates(spark, sf_dir), _documents(spark, sf_dir))


def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.rejections(candidate_reasons(spark, sf_dir))


def suspicious_no_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = answering.with_gate(_retrieved(spark, sf_dir)).select(F.col("query_id").alias("question_id"), "confidence")
    asked = best.select("question_id", F.lit("no_answer").alias("category"))
    return generation.suspicious(asked, best).withColumn("confidence", F.round("confidence", 6))


def confusable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whose id is divisible by 100 the document that its chunks retrieve most."""
    asking = _t(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(_path(F.col("doc_id")).alias("relative_path"))
    return generation.confusable(_chunks(spark, sf_dir), asking)


def _golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("item_id")
    kinds = F.element_at(F.array(*map(F.lit, golden.CATEGORIES)), (F.pmod(n, F.lit(5)) + 1).cast("int"))
    rows = _t(spark, sf_dir, "benchmark").select(n.alias("question_id"), kinds.alias("category"), F.when(n % 2 == 0, "tuning").otherwise("held_out").alias("split"), F.when(n % 7 > 0, "http://x").alias("source_url"), (n % 3 > 0).alias("verified"))
    spans = _t(spark, sf_dir, "benchmark").select(n.alias("question_id"), F.explode(F.filter(F.sequence(F.lit(0), (F.pmod(n, F.lit(4))).cast("int")), lambda k: k > 0)).alias("k"))
    return rows, spans.select("question_id", F.concat(F.lit("d"), F.col("k").cast("string")).alias("relative_path"))


def golden_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.shape_errors(*_golden(spark, sf_dir))


def golden_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.select(_golden(spark, sf_dir)[0], "tuning", golden.ANSWERABLE).select("question_id", "category")


# -- listings, stores, sources ------------------------------------------------------------------------------------


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("relative_path")
    counts = _chunks(spark, sf_dir).groupBy("relative_path").agg(F.count("*").alias("chunks"))
    return docs.join(counts, "relative_path", "left").fillna(0, ["chunks"])


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed documents and later ingested ones, of which the later wins, with their chunks."""
    docs = _documents(spark, sf_dir).select("relative_path", "source")
    both = docs.select("relative_path", F.lit("processed").alias("origin"), F.lit(0).alias("turn")).unionByName(docs.where("source = 'src1'").select("relative_path", F.lit("ingested").alias("origin"), F.lit(1).alias("turn")))
    counts = _chunks(spark, sf_dir).groupBy("relative_path").agg(F.count("*").alias("chunks"))
    return files.last_of_each(both, "relative_path", "turn").join(counts, "relative_path", "left").fillna(0, ["chunks"]).select("relative_path", "origin", "chunks")


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored, some upserted, a document deleted, another strategy stored and deleted; what is left."""
    held = store.ChunkStore(spark, table_path(spark, "chunk-store"), 8)
    held.replace("fixed", _chunks(spark, sf_dir))
    chunks = held.read("fixed").drop("bucket")
    held.replace("other", chunks.where("chunk_index = 0"))
    held.upsert("fixed", chunks.where("relative_path = 'doc/1'").withColumn("token_count", F.col("token_count") + 1000))
    held.delete_document("fixed", "doc/0")
    held.delete_strategy("other")
    return held.read("fixed").groupBy("relative_path").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored with their label, then the five nearest of one label."""
    held = store.VectorStore(spark, table_path(spark, "vector-store"), 8)
    rows, asked = _vectors(spark, sf_dir)
    held.upsert("embeddings", rows.withColumn("relative_path", F.concat(F.lit("label/"), F.col("label").cast("string"))))
    return held.search("embeddings", asked, 5, label=3)


def vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = store.VectorStore(spark, table_path(spark, "vector-store"), 8)
    held.upsert("embeddings", _vectors(spark, sf_dir)[0].withColumn("relative_path", F.concat(F.lit("label/"), F.col("label").cast("string"))))
    return held.ids("embeddings", label=3)


def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts processed, saved with a manifest and loaded."""
    held = store.DocumentStore(spark, table_path(spark, "document-store"))
    held.save(files.text_documents(_documents(spark, sf_dir).select(F.concat("relative_path", F.lit(".txt")).alias("relative_path"), "text")))
    return held.load().select("relative_path", "title", "content_hash", F.size("sections").alias("sections"))


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, ("a/b.md", "x.TXT", "y.pdf", "..\\z.md"))), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", files.upload_status(name, F.when(n % 3 == 0, " \n").otherwise(F.col("html"))).alias("status"))


def multi_hop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100, the label other than its own that its neighbours have most often."""
    rows, asked = _vectors(spark, sf_dir)
    near = dense.top_k(rows, asked, 50).join(rows.select("chunk_id", "label"), "chunk_id").join(asked.select("query_id", "query_label"), "query_id").where("label != query_label")
    counts = near.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "label")).alias("m")).select("query_id", F.col("m.label").alias("other"), (-F.col("m.less")).alias("n"))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("relative_path"), F.col("html").alias("text"), F.lit("html").alias("source_format"))


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.assemble(files.parsed(_page_files(spark, sf_dir)))
    return docs.select("relative_path", "title", F.explode("sections").alias("s")).select("relative_path", "title", F.col("s.section_id").alias("section_id"), "s.level", F.array_join("s.heading_path", " > ").alias("heading"), "s.start_char", "s.end_char")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts without script and style, by patterns alone."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|noscript)\b.*?</\1>", "")
    title = F.regexp_extract(bare, r"(?is)<title>(.*?)</title>", 1)
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))
    return _t(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(body).alias("n_chars"), F.sha1(body).alias("digest"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: the source as a heading, every paragraph under a heading of its own."""
    made = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## Notes\n\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n### Notes\n\n")))
    docs = files.assemble(files.parsed(_documents(spark, sf_dir).select(F.concat("relative_path", F.lit(".md")).alias("relative_path"), made.alias("text"), F.lit("markdown").alias("source_format"))))
    return docs.select("relative_path", "title", F.size("sections").alias("sections"), "content_hash")


def include_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that include the two documents after them; the last ones name files that don't exist."""
    docs = _t(spark, sf_dir, "documents")
    pages = docs.select(_path(F.col("doc_id")).alias("relative_path"), F.concat(F.lit("intro\n{* ../../doc/"), (F.col("doc_id") + 1).cast("string"), F.lit(".txt *}\nmid\n{* doc/"), (F.col("doc_id") + 2).cast("string"), F.lit(".txt hl[1] *}")).alias("text"))
    full, _ = files.expand_includes(pages, docs.select(F.concat(_path(F.col("doc_id")), F.lit(".txt")).alias("path"), F.col("text").alias("content")))
    return full.select("relative_path", F.length("text").alias("n_chars"), F.sha1("text").alias("digest"))


def _sections_of(documents: DataFrame) -> DataFrame:
    return documents.withColumn("section_spans", T.piece_spans(F.split("text", "\n"), 1))


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.structure_chunks(_sections_of(_documents(spark, sf_dir)), MAX, OVERLAP)


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic_chunks(_sections_of(_documents(spark, sf_dir)), MAX)


def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).drop("text", "strategy")


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir).drop("text", "strategy")


def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against the corpus: thirds of the documents by length are unchanged, edited or missing on either side."""
    docs = _documents(spark, sf_dir).withColumn("kind", F.pmod(F.length("text"), F.lit(4)))
    digest = F.sha1("text")
    manifest = docs.where("kind != 0").select("relative_path", F.when(F.col("kind") == 1, F.sha1(F.concat("text", F.lit("!")))).otherwise(digest).alias("digest"))
    return files.stale(manifest, docs.where("kind != 2").select("relative_path", digest.alias("digest")))


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user: the ingest log's rule that a later line replaces an earlier one."""
    return files.last_of_each(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case versions of the documents from one source put over the held ones."""
    held = _documents(spark, sf_dir).select(F.col("relative_path").alias("chunk_id"), F.sha1("text").alias("digest"))
    new = _documents(spark, sf_dir).where("source = 'src1'").select(F.col("relative_path").alias("chunk_id"), F.sha1(F.concat("text", F.lit("+"))).alias("digest"))
    return store.upserted(held, new)


def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, gone = store.without_document(_chunks(spark, sf_dir).select("chunk_id", "relative_path", "strategy"), "doc/0", "fixed")
    return left.agg(F.count("*").alias("chunks_left")).crossJoin(gone)  # one row by one row


def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three holders of chunk ids that disagree on some documents."""
    ids = _documents(spark, sf_dir).select(F.col("relative_path").alias("chunk_id"), F.length("text").alias("n"))
    return store.consistency(store=ids.select("chunk_id"), dense=ids.where("n % 10 != 0").select("chunk_id"), sparse=ids.where("n % 15 != 0").select("chunk_id"))


def cost_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.streaming.ingest import windowed_costs

    return windowed_costs(_t(spark, sf_dir, "events"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken in as a stream of files into a chunk store, then the store's chunks."""
    from spanloom.streaming.ingest import stream_ingest as start

    incoming, root, checkpoint = (table_path(spark, n) for n in ("incoming", "stream-store", "stream-checkpoint"))
    docs = _documents(spark, sf_dir).select("relative_path", "text", F.lit(0).alias("position"))
    n = max(4, docs.rdd.getNumPartitions())  # files, of which each of two batches takes half
    docs.repartition(n, "relative_path").write.parquet(incoming)
    query = start(spark, incoming, root, checkpoint, "relative_path string, text string, position int", lambda rows: rows, MAX, OVERLAP, files_per_trigger=-(-n // 2))
    query.awaitTermination()
    return store.ChunkStore(spark, root).read("fixed").drop("text", "bucket")


_QUERIES = (
    tokenize_terms, token_stats, normalise_text, content_ids, token_offsets, fixed_chunks, chunk_stats, chunk_sections, sentence_spans, paragraph_spans,
    bm25_term_stats, bm25_search, bm25_batch, dense_topk, dense_label_precision, dense_lsh, rrf_hybrid, rrf_weighted, rrf_ablation, rrf_breakdown, weight_sweep,
    hydrate_ranked, rerank_topk, exact_dedup_document, exact_dedup_corpus, near_dedup, dedup_summary, locate_quotes, quote_ambiguity, ideal_pools, span_coverage,
    recall_at_k, mrr, recall_at_budget, ndcg, unreachable, arm_grid, arm_by_category, leader_arm, distractor_rate, metrics_grouping_sets, bootstrap_ci, paired_delta,
    kappa, bootstrap_kappa, label_agreement, seeded_bootstrap, refusal_gate, refusal_calibration, near_misses, confidence_composite, render_context, parse_citations,
    resolve_citations, split_claims, citation_coverage, ask_pipeline, verify_pipeline, judge_pipeline, failure_attribution, failure_pivot, quality_series,
    document_summary, multi_hop_pairs, html_sections, html_text, markdown_sections, include_expansion, structure_chunks, semantic_chunks, stale_documents,
    strategy_grid, leader_by_gain, rerank_verdict, is_hit, tier1_join, verification_separation, arm_report, judge_sample, cheapest_judge, merged_verdicts, usage_costs, usage_ledger,
    reply_parsing, model_prompts, refusal_texts, interval_texts, eligible_sources, golden_items, candidate_reasons, rejection_counts, suspicious_no_answer, confusable_documents,
    golden_shape, golden_select, document_listing, chunk_store, vector_store, vector_ids, document_store, upload_checks,
    last_write_wins, upsert_latest, delete_document, index_consistency, cost_by_window, stream_ingest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
