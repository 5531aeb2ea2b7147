"""Answer quality: failure attribution, score series, refusal calibration, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.stats import numbered

FAILURES = ("none", "retrieval_miss", "wrong_refusal", "ignored_context", "missing_refusal")


def classify(verdict: Column, answerable: Column, span_retrieved: Column, answered: Column) -> Column:
    """Why an answer failed: right first, then questions without an answer, then retrieval, then refusal, else the context was ignored."""
    return F.when(verdict == "CORRECT", "none").when(~answerable, F.when(answered, "missing_refusal").otherwise("none")).when(~F.coalesce(span_retrieved, F.lit(False)), "retrieval_miss").when(~answered, "wrong_refusal").otherwise("ignored_context")


def series(records: DataFrame) -> DataFrame:
    """0/1 columns correct, correct_or_partial, grounded (null counts 0) and cited_honestly (cited, and nothing made up)."""
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return records.withColumns({"correct": one(F.col("verdict") == "CORRECT"), "correct_or_partial": one(F.col("verdict").isin("CORRECT", "PARTIAL")), "grounded_score": one(F.col("grounded")), "cited_honestly": one((F.col("citations") > 0) & (F.col("fabricated_citations") == 0))})


def failure_table(records: DataFrame, by: str = "arm") -> DataFrame:
    """One row an arm, a column a kind of failure."""
    return records.groupBy(by).pivot("failure", list(FAILURES)).agg(F.count(F.lit(1))).fillna(0, list(FAILURES))


def refusal_calibration(probes: DataFrame, threshold: float) -> DataFrame:
    """For each arm: best cosines of answerable and unanswerable questions, the gap between their means, false refusals and catches.

    probes: arm, answerable, confidence; a null confidence is left out, a confidence of 0 isn't.
    """
    good, bad = F.col("answerable"), ~F.col("answerable")
    held = probes.where("confidence IS NOT NULL")
    mean = lambda c: F.avg(F.when(c, F.col("confidence")))
    return held.groupBy("arm").agg(F.round(F.min(F.when(good, F.col("confidence"))), 6).alias("answerable_min"), F.round(mean(good), 6).alias("answerable_mean"), F.round(F.max(F.when(bad, F.col("confidence"))), 6).alias("unanswerable_max"), F.round(mean(good) - mean(bad), 6).alias("gap"), F.count_if(good & (F.col("confidence") < threshold)).alias("false_refusals"), F.count_if(bad & (F.col("confidence") < threshold)).alias("catches"))


def arm_report(records: DataFrame) -> DataFrame:
    """Refusal rate, live answers, median live latency and costs of each arm."""
    return records.groupBy("arm").agg(F.count("*").alias("questions"), F.round(F.avg((~F.col("answered")).cast("double")), 6).alias("refusal_rate"), F.count_if(~F.col("cached")).alias("live"), F.round(F.percentile(F.when(~F.col("cached"), F.col("latency_s")), 0.5), 6).alias("median_live_latency"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def judge_sample(records: DataFrame, n: int) -> DataFrame:
    """Questions for hand labels: misses first, then unanswerable ones, then the others in turn over categories by id."""
    priority = F.when(~F.coalesce("span_retrieved", F.lit(False)) & F.col("answerable"), 0).when(~F.col("answerable"), 1).otherwise(2)
    rows = records.withColumn("priority", priority).withColumn("turn", F.row_number().over(Window.partitionBy("priority", "category").orderBy("question_id")))
    return rows.orderBy("priority", F.when(F.col("priority") == 2, F.col("turn")).otherwise(0), F.when(F.col("priority") == 2, F.col("category")).otherwise(""), "question_id").limit(n)


def cheapest_judge(judges: DataFrame, least_kappa: float = 0.60) -> DataFrame:
    """The cheapest judge that agrees well enough; the first by name of equals."""
    return judges.where(F.col("kappa") >= least_kappa).orderBy("cost_usd", "judge").limit(1)


def merge_verdicts(sheet: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The sheet with new human verdicts by question; a verdict for an unknown question is an error."""
    unknown = verdicts.join(sheet, "question_id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("verdicts for questions that the sheet lacks")
    new = verdicts.select("question_id", F.col("human_verdict").alias("_new"))
    return sheet.join(new, "question_id", "left").withColumn("human_verdict", F.coalesce("_new", "human_verdict")).drop("_new").select(*sheet.columns)


def control_blocks(pool: DataFrame, retrieved: DataFrame, seed: int = 7) -> DataFrame:
    """For each cited place another chunk that its question didn't retrieve: a negative control for the verifier.

    pool: chunk_id; retrieved: query_id, chunk_id, rank.  The pool is put in order of a seeded hash and each question
    starts 7 places after the one before; places that hold a retrieved chunk are passed over.  The pool must be larger
    than all that one question retrieves, else a place stays without a control.
    """
    placed = numbered(pool.select("chunk_id").distinct().withColumn("_h", F.xxhash64(F.lit(seed), "chunk_id")), "_h").select("i", "chunk_id")
    n = F.broadcast(placed.agg(F.count("*").alias("n")))
    cited = retrieved.groupBy("query_id").agg(F.max("rank").alias("places")).transform(numbered, "query_id", "q")
    tries = cited.crossJoin(n).select("query_id", "places", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("places") * 2 - 1), lambda j: F.pmod(F.col("q") * 7 + j, F.col("n")))).alias("j", "i"))  # one row
    free = tries.join(placed, "i").join(retrieved.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return free.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("j"))).where("rank <= places").select("query_id", "rank", "chunk_id")
