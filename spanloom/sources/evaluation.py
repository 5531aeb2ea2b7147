"""Files of an evaluation: golden questions and label sheets (YAML), and stored results of retrieval (JSON).

A golden set or a label sheet is written by hand and small, so the driver parses it; results are read by Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN_VERSION, SHEET_VERSION = 2, 1
QUESTION = "question_id string, split string, category string, question string, answer string, verified boolean, source_url string, notes string, spans array<struct<relative_path:string,quote:string>>"
ITEM = "question_id string, question string, reference_answer string, system_answer string, context string, human_verdict string, human_grounded boolean"


def _parse(text: str, path: str, version: int) -> dict:
    try:
        import yaml
    except ImportError:  # JSON is YAML too
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict) or found.get("format_version") != version:
        raise ValueError(f"{path} isn't of format version {version}")
    return found


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def _dump(payload: dict) -> str:
    try:
        import yaml
    except ImportError:
        return json.dumps(payload, ensure_ascii=False, indent=1)

    class Readable(yaml.SafeDumper):
        """Texts of several lines as literal blocks."""

    Readable.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))
    return yaml.dump(payload, Dumper=Readable, sort_keys=False, allow_unicode=True, width=100)


def _write(spark: SparkSession, path: str, text: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def load_golden(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(questions, corpus reference) of a golden set; ids must be unique."""
    found = _parse(_text(spark, path), path, GOLDEN_VERSION)
    rows = [{"verified": False, "spans": []} | q for q in found.get("questions") or []]
    names = [r.get("question_id") for r in rows]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"question ids that occur twice: {', '.join(map(str, twice))}")
    return _frame(spark, [r | {"spans": [(s["relative_path"], s["quote"]) for s in r["spans"]]} for r in rows], QUESTION), found.get("corpus_ref", "")


def save_golden(questions: DataFrame, path: str, corpus_ref: str) -> None:
    rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in questions.orderBy("question_id").toLocalIterator()]
    _write(questions.sparkSession, path, _dump({"format_version": GOLDEN_VERSION, "corpus_ref": corpus_ref, "questions": rows}))


def load_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet's items; a human verdict is null where nobody has judged yet."""
    return _frame(spark, _parse(_text(spark, path), path, SHEET_VERSION).get("items") or [], ITEM)


def save_sheet(items: DataFrame, path: str, **about: str) -> None:
    rows = [r.asDict(recursive=True) for r in items.orderBy("question_id").toLocalIterator()]
    _write(items.sparkSession, path, _dump({"format_version": SHEET_VERSION, **about, "items": rows}))


def spans_of(questions: DataFrame) -> DataFrame:
    """(question_id, relative_path, quote) of a golden set's questions."""
    return questions.select("question_id", F.explode("spans").alias("s")).select("question_id", "s.relative_path", "s.quote")


def save_results(scored: DataFrame, path: str) -> None:
    """Per-question hits as JSON lines, a line an arm: arm and questions (question_id, hits by cutoff)."""
    hits = F.create_map(*(x for k in (1, 3, 5, 10) for x in (F.lit(str(k)), F.col(f"hit_{k}"))))
    rows = scored.select("arm", F.struct(F.col("question_id").cast("string").alias("question_id"), hits.alias("hits")).alias("q"))
    rows.groupBy("arm").agg(F.array_sort(F.collect_list(F.to_json("q"))).alias("questions")).write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str, cutoff: int = 10) -> DataFrame:
    """(arm, question_id, span_retrieved) of stored results: whether the span was found within the cutoff."""
    rows = spark.read.schema("arm string, questions array<string>").json(path).select("arm", F.explode("questions").alias("q"))
    q = F.from_json("q", "question_id string, hits map<string,boolean>")
    return rows.select("arm", q["question_id"].alias("question_id"), F.coalesce(F.try_element_at(q["hits"], F.lit(str(cutoff))), F.lit(False)).alias("span_retrieved"))


def with_retrieval(records: DataFrame, results: DataFrame) -> DataFrame:
    """Answer records with ``span_retrieved`` of the stored results; false where there is none."""
    return records.drop("span_retrieved").join(results, ["arm", "question_id"], "left").withColumn("span_retrieved", F.coalesce("span_retrieved", F.lit(False)))
