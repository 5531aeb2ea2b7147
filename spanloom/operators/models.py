"""Models behind small interfaces, with deterministic offline stand-ins and read-through caches.

A model is a function of a DataFrame that adds ``reply`` to the rows.  The stand-ins are Column expressions; a hosted
model would be a ``mapInPandas`` of the same shape.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.ids import cache_key
from spanloom.functions.text import sentences, terms

# Prices in dollars for a million tokens, input and output.
PRICES = {"offline-extractive": (0.0, 0.0), "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1-nano": (0.10, 0.40), "text-embedding-3-small": (0.02, 0.0)}

Model = Callable[[DataFrame], DataFrame]


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct terms of ``a`` found in ``b``; 0 without terms."""
    own = F.array_distinct(terms(a))
    return F.coalesce(F.size(F.array_intersect(own, terms(b))) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0))


def extractive_answers(rows: DataFrame) -> DataFrame:
    """Adds ``reply``: the first sentence of each of the first two results that share terms with the question, cited; the sentinel if none does."""
    scored = F.transform("results", lambda r, i: F.struct((i + 1).alias("n"), F.try_element_at(sentences(r["text"]), F.lit(1)).alias("s"), overlap(F.col("question"), r["text"]).alias("o")))
    used = F.slice(F.filter(scored, lambda x: (x["o"] > 0) & x["s"].isNotNull()), 1, 2)
    said = F.array_join(F.transform(used, lambda x: F.concat(F.regexp_replace(x["s"], r"[.!?]+$", ""), F.lit(" ["), x["n"].cast("string"), F.lit("]."))), " ")
    return rows.withColumn("reply", F.when(F.size(used) > 0, said).otherwise("INSUFFICIENT_CONTEXT"))


def overlap_verifier(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """Adds ``reply`` with a SUPPORT line by the share of the claim's terms in the evidence."""
    verdict = F.when(overlap(F.col("claim"), F.col("evidence")) >= least, "SUPPORTED").otherwise("UNSUPPORTED")
    return rows.withColumn("reply", F.concat(F.lit("**SUPPORT:** "), verdict, F.lit("\nREASON: term overlap")))


def overlap_judge(rows: DataFrame) -> DataFrame:
    """Adds ``reply`` with VERDICT, GROUNDED and REASON lines. rows: reference, answer, context."""
    right, grounded = overlap(F.col("reference"), F.col("answer")), overlap(F.col("answer"), F.col("context"))
    verdict = F.when(right >= 0.6, "CORRECT").when(right >= 0.25, "PARTIAL").otherwise("INCORRECT")
    return rows.withColumn("reply", F.concat(F.lit("VERDICT: "), verdict, F.lit("\nGROUNDED: "), F.when(grounded >= 0.6, "yes").otherwise("no"), F.lit("\nREASON: term overlap")))


def overlap_completeness(rows: DataFrame) -> DataFrame:
    """Adds ``reply`` with a COMPLETENESS line. rows: question, answer."""
    share = overlap(F.col("question"), F.col("answer"))
    level = F.when(share >= 0.6, "COMPLETE").when(share >= 0.25, "PARTIAL").otherwise("MISSING")
    return rows.withColumn("reply", F.concat(F.lit("COMPLETENESS: "), level, F.lit("\nREASON: term overlap")))


def priced(rows: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds ``cost_usd`` from model, input_tokens and output_tokens; a model without a price is an error."""
    table = prices or PRICES
    pick = lambda k: F.coalesce(*(F.when(F.col("model") == n, p[k]) for n, p in table.items()), F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("double"))
    return rows.withColumn("cost_usd", F.col("input_tokens") / 1e6 * pick(0) + F.col("output_tokens") / 1e6 * pick(1))


def with_usage(rows: DataFrame) -> DataFrame:
    """Adds output_tokens (visible: completion less reasoning) and thinking_tokens. rows: prompt_tokens, completion_tokens, reasoning_tokens."""
    thinking = F.coalesce("reasoning_tokens", F.lit(0))
    done = F.coalesce("completion_tokens", F.lit(0))
    return rows.withColumns({"input_tokens": F.coalesce("prompt_tokens", F.lit(0)), "output_tokens": F.greatest(F.lit(0), done - thinking), "thinking_tokens": thinking})


def ledger(rows: DataFrame) -> DataFrame:
    """(model, calls, cached_calls, input_tokens, output_tokens, cost_usd): cached replies count as calls without tokens or cost."""
    live = lambda c: F.coalesce(F.sum(F.when(~F.col("cached"), F.col(c))), F.lit(0))
    return rows.groupBy("model").agg(F.count_if(~F.col("cached")).alias("calls"), F.count_if("cached").alias("cached_calls"), live("input_tokens").alias("input_tokens"), live("output_tokens").alias("output_tokens"), F.round(live("cost_usd"), 6).alias("cost_usd"))


def hosted(call: Callable[[str], dict], text: str = "prompt", parallel: int = 1, pause_s: float = 0.0, attempts: int = 3) -> Model:
    """A model behind a function of a prompt that gives text, prompt_tokens, completion_tokens and reasoning_tokens.

    Requests go out from ``parallel`` tasks, each ``pause_s`` apart, and are tried ``attempts`` times with doubled
    pauses; a reply without text is an error, as a cut one would count as an answer.
    """

    def ask(prompt: str) -> dict:
        for k in range(attempts):
            time.sleep(pause_s * 2**k)
            try:
                found = call(prompt)
            except Exception:
                if k == attempts - 1:
                    raise
                continue
            if not (found.get("text") or "").strip():
                raise ValueError("the model returned no text")
            return found
        raise ValueError("attempts must be positive")

    def model(rows: DataFrame) -> DataFrame:
        numbers = ("prompt_tokens", "completion_tokens", "reasoning_tokens")
        out = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), *(T.StructField(n, T.LongType()) for n in numbers)])

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [ask(p) for p in batch[text]]
                yield batch.assign(reply=[f["text"].strip() for f in found], **{n: [int(f.get(n) or 0) for f in found] for n in numbers})

        return rows.repartition(parallel).mapInPandas(answer, out)

    return model


def read_through(rows: DataFrame, cache: DataFrame, model: Model, fingerprint: str, text: str = "prompt", bypass: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with reply and cached, new cache rows): asks the model once for each text that the cache lacks.

    cache: key, reply.  A cache row without a reply counts as a miss; ``bypass`` reads nothing but still writes.
    """
    keyed = rows.withColumn("key", cache_key(F.lit(fingerprint), F.col(text)))
    held = cache.where("reply IS NOT NULL").select("key", F.col("reply").alias("_held")).dropDuplicates(["key"])
    held = held.limit(0) if bypass else held
    fresh = model(keyed.join(held, "key", "left_anti").dropDuplicates(["key"])).where("reply IS NOT NULL").select("key", "reply")
    answered = keyed.join(held, "key", "left").join(fresh, "key", "left")
    return answered.withColumn("cached", F.col("_held").isNotNull()).withColumn("reply", F.coalesce("_held", "reply")).drop("_held", "key"), fresh
