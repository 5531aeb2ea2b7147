"""Claims, citations, confidence, spans, metrics, statistics and quality."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import answering, golden, metrics, models, quality, stats


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_claims():
    assert [c for _, c in answering.claims_of("First is so [2]. Second is too [3].")] == [[2], [3]]
    assert [c for _, c in answering.claims_of("Plain sentence here. Another one is.\n[1] [2] [4] [5]")] == [[], [1, 2, 4, 5]]
    assert [t for t, _ in answering.claims_of("# Head\n- one item [1]\n---\n- two items [2]\n|---|---|")] == ["one item [1]", "two items [2]"]
    assert answering.claims_of("[1] [2] Real text.")[0][0] == "Real text."
    text, cites = answering.claims_of("Do this [1]:\n```\ncode [9]\n```\n")[0]
    assert "code" in text and cites == [1]
    assert answering.claims_of("") == []


def test_citation_resolution(spark):
    row = one(spark, answering.resolve_citations(F.lit("a [0] b [2] c [9]"), F.lit(3)))
    assert (row["resolved"], row["unresolved"], row["uncited"]) == ([2], [0, 9], [1, 3])


def test_coverage_of_claims(spark):
    rows = answering.split_claims(spark.createDataFrame([(1, "Cited well [1]. Uncited sentence here."), (2, None)], "answer_id int, answer string"))
    assert [(r["answer_id"], r["coverage"]) for r in answering.structural_coverage(rows).collect()] == [(1, 0.5)]


def test_confidence(spark):
    rows = spark.createDataFrame([(0.3,), (0.7,), (0.1,), (0.9,), (None,)], "c double").select(answering.ramp(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in rows] == [0.0, 1.0, 0.0, 1.0, None]
    row = one(spark, answering.composite({"b": F.lit(0.5), "a": F.lit(1.0), "c": F.lit(None).cast("double")}))
    assert (row["score"], row["components"]) == (0.75, ["a", "b"])
    assert one(spark, answering.composite({"c": F.lit(None).cast("double")}))["score"] is None


def test_replies(spark):
    assert one(spark, answering.support(F.lit("**SUPPORT:** supported"))) == "SUPPORTED"
    for bad in ("**SUPPORT:** partial", "SUPPORT: partial\nSUPPORTED", "hm", ""):
        with pytest.raises(Exception, match="can't be read"):
            one(spark, answering.support(F.lit(bad)))
    for bad in ("COMPLETENESS: incomplete", "complete", ""):
        with pytest.raises(Exception, match="can't be read"):
            one(spark, answering.completeness(F.lit(bad)))
    assert one(spark, answering.completeness(F.lit("**COMPLETENESS:** missing"))) == 0.0
    assert one(spark, answering.support(F.lit("thinking\nUNSUPPORTED.\n"))) == "UNSUPPORTED"
    assert one(spark, answering.completeness(F.lit("COMPLETENESS: complete\nREASON: x"))) == 1.0
    row = one(spark, answering.judgement(F.lit("VERDICT: Partial\nGROUNDED: no\nREASON: because")))
    assert (row["verdict"], row["grounded"], row["reason"]) == ("PARTIAL", False, "because")
    with pytest.raises(Exception, match="can't be read"):
        one(spark, answering.judgement(F.lit("hm")))


def test_verification(spark):
    sets = spark.createDataFrame([(1, [("blue sky above",), ("green grass",)])], "query_id int, results array<struct<text:string>>")
    claims = spark.createDataFrame([(1, 0, "blue sky above", [1]), (1, 1, "nothing alike", [2]), (1, 2, "made up", [7]), (1, 3, "plain", [])], "answer_id int, index int, text string, citations array<int>")
    found = answering.verify(claims, sets, models.overlap_verifier)
    assert {r["index"]: r["status"] for r in found.collect()} == {0: "supported", 1: "unsupported", 2: "unsupported", 3: "uncited"}
    report = answering.verification_report(found).first()
    assert (report["coverage"], report["precision"]) == (0.25, round(1 / 3, 6))


def test_read_through_cache(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, prompt string")
    cache = spark.createDataFrame([], "key string, reply string")
    model = lambda df: df.withColumn("reply", F.upper("prompt"))
    answered, fresh = models.read_through(rows, cache, model, "m")
    assert fresh.count() == 2 and {r["reply"] for r in answered.collect()} == {"A", "B"}
    again, none = models.read_through(rows, fresh, model, "m")
    assert none.count() == 0 and all(r["cached"] for r in again.collect())
    with pytest.raises(Exception, match="no price"):
        models.priced(spark.createDataFrame([("x", 1, 1)], "model string, input_tokens int, output_tokens int")).collect()


def test_locate(spark):
    docs = spark.createDataFrame([("g", "Alpha declares.\n\nBeta  validates it. Beta twice. Beta twice."), ("n", None)], "relative_path string, text string")
    quotes = [(1, "g", "Alpha declares."), (2, "g", "Beta validates it."), (3, "g", "Beta twice."), (4, "g", "paraphrase"), (5, "x", "Alpha"), (6, "g", "declares. Beta")]
    rows = {r["question_id"]: r for r in golden.locate(spark.createDataFrame(quotes, "question_id int, relative_path string, quote string"), docs).collect()}
    assert [rows[k]["status"] for k in range(1, 7)] == ["located", "located", "ambiguous", "not_found", "missing_document", "located"]
    assert (rows[1]["start_char"], rows[1]["end_char"]) == (0, 15) and (rows[2]["start_char"], rows[2]["end_char"]) == (17, 36)


def test_shapes(spark):
    questions = spark.createDataFrame([(1, "lookup", "tuning", None), (2, "multi_hop", "tuning", None), (3, "no_answer", "tuning", None), (4, "lookup", "held_out", "")], "question_id int, category string, split string, source_url string")
    spans = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "a"), (4, "b")], "question_id int, relative_path string")
    assert {r["question_id"] for r in golden.shape_errors(questions, spans).collect()} == {2, 3, 4}


def _rankings(spark, rows):
    return spark.createDataFrame([("a", q, k + 1, p, s, e, t) for q, k, p, s, e, t in rows], "arm string, question_id int, rank int, relative_path string, start_char int, end_char int, token_count int")


def test_metrics(spark):
    spans = spark.createDataFrame([(1, "s", "g", 0, 25), (2, "s", "g", 0, 25), (3, "s", "g", 0, 25)], "question_id int, span string, relative_path string, start_char int, end_char int")
    questions = spark.createDataFrame([(1, "lookup"), (2, "lookup"), (3, "lookup")], "question_id int, category string")
    ranks = _rankings(spark, [(1, 0, "g", 44, 70, 10), (1, 1, "g", 26, 43, 10), (1, 2, "g", 0, 25, 10), (2, 0, "g", 0, 12, 1200), (2, 1, "g", 12, 30, 1200), (3, 0, "g", 0, 12, 5)])
    rows = {r["question_id"]: r for r in metrics.per_question(ranks, spans, questions).collect()}
    assert (rows[1]["hit_1"], rows[1]["hit_3"], rows[1]["first_hit_rank"], rows[1]["reciprocal_rank"]) == (False, True, 3, 0.333333)
    assert (rows[2]["first_hit_rank"], rows[2]["budget_hit"]) == (2, False)
    assert rows[3]["first_hit_rank"] is None and rows[3]["reciprocal_rank"] == 0.0
    chunks = spark.createDataFrame([("c1", "g", 0, 25), ("c2", "g", 26, 43)], "chunk_id string, relative_path string, start_char int, end_char int")
    late = metrics.ndcg(_rankings(spark, [(1, 0, "g", 26, 43, 1), (1, 1, "g", 0, 25, 1)]), chunks, spans.where("question_id = 1"), questions).first()
    assert late["ndcg"] == round(1 / 1.5849625, 6) and late["reachable"]
    assert metrics.ndcg(_rankings(spark, [(1, 0, "g", 26, 43, 1)]), chunks.where("chunk_id = 'c2'"), spans.where("question_id = 1"), questions).first()["reachable"] is False


def test_budget_stops_at_the_first_overflow(spark):
    ranks = _rankings(spark, [(1, 0, "g", 0, 1, 800), (1, 1, "g", 0, 1, 800), (1, 2, "g", 0, 1, 800), (1, 3, "g", 0, 1, 10)])
    assert metrics.within_budget(ranks).count() == 2


def test_statistics(spark):
    flat = spark.createDataFrame([(k, 0.7, 0.6) for k in range(10)], "id int, x double, y double")
    row = stats.bootstrap_interval(flat, "id", "x", 50).first()
    assert (row["n"], row["mean"], row["low"], row["high"]) == (10, 0.7, 0.7, 0.7)
    delta = stats.paired_delta(flat, "id", "x", "y", 50).first()
    assert (delta["delta"], delta["low"], delta["p_positive"], delta["significant"]) == (0.1, 0.1, 1.0, True)
    kappa = lambda pairs: stats.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    one_sided = kappa([("c", "c")] * 18 + [("o", "c")] * 2)
    assert (one_sided["raw_agreement"], one_sided["kappa"]) == (0.9, 0.0)
    assert kappa([("a", "a")] * 3)["kappa"] == 1.0
    assert kappa([("a", "b"), ("b", "a"), ("a", "b"), ("b", "a")])["kappa"] < 0


def test_failures(spark):
    rows = [("CORRECT", True, False, True, "none"), ("PARTIAL", True, False, False, "retrieval_miss"), ("PARTIAL", True, True, False, "wrong_refusal"), ("INCORRECT", True, True, True, "ignored_context"), ("INCORRECT", False, None, True, "missing_refusal"), ("PARTIAL", True, None, True, "retrieval_miss")]
    df = spark.createDataFrame(rows, "v string, a boolean, s boolean, d boolean, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", quality.classify(F.col("v"), F.col("a"), F.col("s"), F.col("d"))).collect())
