"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, jaccard, jpeg, license_scan, packing, pii, quality, repair, secret_scan, superkmer
from spanloom.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text in Re-Pair shards, read back: place, number and checksum of each document's ids."""
    shards = repair.write_token_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return repair.read_documents(shards, with_ids=False)


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by a classifier trained on the labels outside the held-out fifth."""
    documents = _table(spark, sf_dir, "documents")
    scored = quality.score(documents.select("doc_id", "text"), quality.train(documents, _table(spark, sf_dir, "labels")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), "predicted")


def op3_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text packed into sequences of 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=2048)


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a progressive JPEG in a table, read back and decoded: digests of the payload, the stored form and the pixels."""
    media = written(jpeg.store(_table(spark, sf_dir, "documents")), "media")
    images = jpeg.decode(media)
    feature = F.concat_ws(":", F.concat_ws("x", "height", "width"), "scans", F.hex(F.crc32("rgb")))
    return images.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op5_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words that windows of 35 words occurring elsewhere cover."""
    return superkmer.remove_repeats(_table(spark, sf_dir, "documents"), window=35, with_text=False)


def op10_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items found in them within the edit budget."""
    return decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _tree_path() -> Column:
    """A place in a tree for each document: its number by powers of ten; every hundredth is its folder's licence file."""
    n = F.col("doc_id")
    name = F.when(F.pmod(n, F.lit(100)) == 0, "LICENSE").otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", *(F.floor(n / 10**k).cast("string") for k in (4, 3, 2)), name)


def op6_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document: its own header's, or that of the nearest folder above."""
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), _tree_path().alias("path"), "text")
    return license_scan.scan(files).withColumnRenamed("key", "doc_id")


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's probability."""
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat_ws("/", "source", "lang").alias("path"), "text")
    found = secret_scan.scan(files, secret_scan.train(secret_scan.labelled_findings(spark)))
    return found.select(F.col("key").alias("doc_id"), "start", "stop", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op7_combination_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document: the base spans' digest and all spans."""
    found = pii.detect(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda m: m["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repair_token_ids, op2_compression_quality, op3_residual_packing, op4_progressive_jpeg, op5_superkmer_dedup, op6_license_inheritance, op7_combination_jaccard, op8_secret_forest, op9_weak_pii, op10_pigeonhole_decontamination)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_REPEATS = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, k, array_to_string(w[k + 1 : k + 35], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS k FROM w WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT doc_id, k + o AS p FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g) CROSS JOIN range(35) t(o)),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COMPONENTS = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * hits >= 75 * (a.n + b.n - hits)),
ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM ways UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.y, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x) r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Of the operators without a model, tokeniser or codec whose whole result SQL can say."""
    return {"op5_superkmer_dedup": _REPEATS, "op7_combination_jaccard": _COMPONENTS}
