"""Answering a table of questions: gate, context, citations, claims, refusals, confidence, verification, judging.

Models are functions DataFrame -> DataFrame behind :mod:`spanloom.operators.models`; everything else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import LIST_MARKER, citation_numbers, is_insufficient, labelled, labelled_value, readable, reason_line, source_label

GATE = 0.30  #: best cosine below which a question is refused
RAMP = (0.30, 0.70)
MAX_DOCUMENTS = 3
COMPLETENESS = {"COMPLETE": 1.0, "PARTIAL": 0.5, "MISSING": 0.0}
SUPPORT = ["SUPPORTED", "UNSUPPORTED"]
VERDICTS = ["CORRECT", "PARTIAL", "INCORRECT"]


def retrieved_sets(results: DataFrame) -> DataFrame:
    """One row a question: its results in rank order as an array. results: query_id, rank, chunk_id, relative_path, heading_path, text, hits."""
    item = F.struct("rank", "chunk_id", "relative_path", "heading_path", "text", "hits")
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(item), lambda a, b: a["rank"] - b["rank"]).alias("results"))


def dense_score(result: Column) -> Column:
    return F.try_element_at(result["hits"], F.lit("dense"))["score"]


def with_gate(sets: DataFrame, threshold: float = GATE) -> DataFrame:
    """confidence (best dense score, null without any), refusal (no_results, low_confidence or null) and both_agree (the first result was found twice)."""
    best = F.array_max(F.transform("results", dense_score))
    first = F.try_element_at("results", F.lit(1))
    rows = sets.withColumn("confidence", best)
    refusal = F.when(F.coalesce(F.size("results"), F.lit(0)) <= 0, "no_results").when(F.col("confidence") < threshold, "low_confidence")
    return rows.withColumn("refusal", refusal).withColumn("both_agree", F.coalesce(F.size(first["hits"]) > 1, F.lit(False)))


def near_misses(sets: DataFrame) -> DataFrame:
    """what_was_found: source label and cosine of the first three results; documents_to_check: the first three different paths."""
    label = lambda r: F.struct(source_label(r["relative_path"], r["heading_path"]).alias("source"), F.round(dense_score(r), 6).alias("similarity"))
    return sets.withColumn("what_was_found", F.transform(F.slice("results", 1, 3), label)).withColumn("documents_to_check", F.slice(F.array_distinct(F.transform("results", lambda r: r["relative_path"])), 1, MAX_DOCUMENTS))


def refusal_text(reason: Column, found: Column, missing: Column, documents: Column) -> Column:
    """The refusal as text; parts without content are left out."""
    seen = F.array_join(F.transform(found, lambda m: F.concat(F.lit("- "), m["source"], F.coalesce(F.concat(F.lit(" ("), F.format_number(m["similarity"], 2), F.lit(")")), F.lit("")))), "\n")
    lines = F.array(reason, F.when(F.size(found) > 0, F.concat(F.lit("Closest passages:\n"), seen)), F.when(F.coalesce(missing, F.lit("")) != "", F.concat(F.lit("Missing: "), missing)), F.when(F.size(documents) > 0, F.concat(F.lit("Documents to check: "), F.array_join(documents, ", "))))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def context(results: Column) -> Column:
    """Numbered blocks ``[i] source`` and text, apart by a blank line."""
    block = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), source_label(r["relative_path"], r["heading_path"]), F.lit("\n"), r["text"])
    return F.array_join(F.transform(results, block), "\n\n")


def prompt(question: Column, results: Column) -> Column:
    return F.concat(F.lit("CONTEXT\n\n"), context(results), F.lit("\n\nQUESTION\n\n"), question)


def resolve_citations(answer: Column, blocks: Column) -> Column:
    """cited, resolved (1 to blocks), unresolved and uncited numbers."""
    cited = citation_numbers(answer)
    inside = lambda n: (n >= 1) & (n <= blocks)
    every = F.when(blocks > 0, F.sequence(F.lit(1), blocks)).otherwise(F.array().cast("array<int>"))
    return F.struct(cited.alias("cited"), F.filter(cited, inside).alias("resolved"), F.filter(cited, lambda n: ~inside(n)).alias("unresolved"), F.array_except(every, cited).alias("uncited"))


def outcome(answer: Column, refusal: Column) -> Column:
    """answered, refused by the gate, or refused by the model's sentinel."""
    return F.when(refusal.isNotNull(), refusal).when(is_insufficient(answer), "insufficient_context").otherwise("answered")


def claims_of(text: str) -> list[tuple[str, list[int]]]:
    """Claims of an answer with the citations of each.

    Lines, then sentences; headings, rules and table separators are no claims; a fenced block belongs to the claim
    before it; a sentence of citations alone merges into the claim before it; what comes before any claim is dropped.
    """
    import re

    from spanloom.operators.chunking import fence_spans

    cite = re.compile(r"\[(\d+(?:\s*,\s*\d+)*)\]")
    numbers = lambda s: list(dict.fromkeys(int(n) for g in cite.findall(re.sub(r"`[^`\n]+`", " ", s)) for n in re.split(r"\s*,\s*", g)))
    fences, claims, at = fence_spans(text), [], 0
    stretches: list[tuple[bool, str]] = []
    for a, b in fences:
        stretches += [(False, text[at:a]), (True, text[a:b])]
        at = b
    stretches.append((False, text[at:]))
    for fenced, stretch in stretches:
        if fenced:
            if claims:
                claims[-1][0] += "\n" + stretch.strip("\n")
            continue
        for line in stretch.split("\n"):
            if re.match(r"\s*#{1,6}\s", line):
                continue
            line = re.sub(LIST_MARKER, "", re.sub(r"^>\s?", "", line.strip())).strip()
            for sentence in re.split(r"(?<=[.!?])[ \t]+(?=[A-Z\"'(\[])", line):
                cut = re.match(r"((?:\[\d+(?:\s*,\s*\d+)*\]\s*)+)(?=[A-Z\"'(])", sentence)
                pieces = [cut.group(1), sentence[cut.end() :]] if cut else [sentence]
                for piece in pieces:
                    bare = cite.sub("", piece)
                    if len(re.sub(r"[^A-Za-z]", "", bare)) >= 3 and not re.fullmatch(r"[-*_|:\s]+", bare.strip()):
                        claims.append([piece.strip(), numbers(piece)])
                    elif claims and numbers(piece):
                        claims[-1][0] += " " + piece.strip()
                        claims[-1][1] = list(dict.fromkeys(claims[-1][1] + numbers(piece)))
    return [(t, c) for t, c in claims]


def split_claims(answers: DataFrame) -> DataFrame:
    """(answer_id, index, text, citations). answers: answer_id and answer; null answers have no claims."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(a, k, t, c) for a, text in zip(batch["answer_id"], batch["answer"], strict=True) for k, (t, c) in enumerate(claims_of(text or ""))]
            yield pd.DataFrame(rows, columns=["answer_id", "index", "text", "citations"])

    return answers.select("answer_id", "answer").mapInPandas(split, f"answer_id {dict(answers.dtypes)['answer_id']}, index int, text string, citations array<int>")


def structural_coverage(claims: DataFrame) -> DataFrame:
    """(answer_id, claims, coverage): share of claims with a citation."""
    return claims.groupBy("answer_id").agg(F.count("*").alias("claims"), F.round(F.avg((F.size("citations") > 0).cast("double")), 6).alias("coverage"))


def ramp(cosine: Column) -> Column:
    """0 up to 0.30, 1 from 0.70, straight between; null stays null."""
    low, high = RAMP
    return F.when(cosine.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - low) / (high - low))))


def composite(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the parts that aren't null, with their names in order; null without any."""
    items = F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"), F.lit(float((weights or {}).get(n, 1.0))).alias("weight")) for n, c in sorted(parts.items())))
    held = F.filter(items, lambda x: x["value"].isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda s, x: s + x["weight"])
    value = F.aggregate(held, F.lit(0.0), lambda s, x: s + x["value"] * x["weight"]) / F.nullif(total, F.lit(0.0))
    return F.struct(F.round(value, 8).alias("score"), F.transform(held, lambda x: x["name"]).alias("components"))


def completeness(reply: Column) -> Column:
    """1, 0.5 or 0 from a ``COMPLETENESS:`` line; a reply without one that can be read is an error."""
    level = readable(labelled_value(reply, "COMPLETENESS", list(COMPLETENESS)), "the completeness reply", reply)
    out: Column = F.lit(None).cast("double")
    for name, value in COMPLETENESS.items():
        out = F.when(level == name, value).otherwise(out)
    return out


def support(reply: Column) -> Column:
    """Verdict of a ``SUPPORT:`` line or, without such a line, of a line that is a bare verdict; any other reply is an error."""
    bare = F.nullif(F.upper(F.regexp_extract(reply, rf"(?im)^\s*\**\s*({'|'.join(SUPPORT)})\s*\**\s*\.?\s*$", 1)), F.lit(""))
    found = F.coalesce(labelled(reply, "SUPPORT"), bare)
    return readable(F.when(found.isin(*SUPPORT), found), "the verifier's reply", reply)


def judgement(reply: Column) -> Column:
    """verdict, grounded and reason of a judge's reply; a reply without verdict is an error."""
    verdict = labelled_value(reply, "VERDICT", VERDICTS)
    grounded = labelled_value(reply, "GROUNDED", ["YES", "NO"])
    return F.struct(readable(verdict, "the judge's reply", reply).alias("verdict"), (grounded == "YES").alias("grounded"), reason_line(reply).alias("reason"))


def verification_prompt(claim: Column, citations: Column, results: Column) -> Column:
    """The claim, then only the blocks that it cites, numbered as the answer numbers them."""
    real = F.filter(citations, lambda n: (n >= 1) & (n <= F.size(results)))
    block = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("] "), source_label(F.element_at(results, n)["relative_path"], F.element_at(results, n)["heading_path"]), F.lit("\n"), F.trim(F.element_at(results, n)["text"]))
    return F.concat(F.lit("CLAIM\n"), F.trim(claim), F.lit("\n\nCITED PASSAGES\n"), F.array_join(F.transform(real, block), "\n\n"), F.lit("\n"))


def judge_prompt(question: Column, reference: Column, answer: Column, shown: Column) -> Column:
    """Question, reference answer (or that declining is right), the system's answer and the context it was shown."""
    standard = F.coalesce(F.nullif(F.trim(reference), F.lit("")), F.lit("(none: the documents do not answer this question, so declining is correct)"))
    parts = (("QUESTION", question), ("REFERENCE ANSWER", standard), ("ASSISTANT'S ANSWER", answer), ("CONTEXT THE ASSISTANT WAS SHOWN", shown))
    return F.concat(F.concat_ws("\n\n", *(F.concat(F.lit(f"{name}\n"), F.trim(F.coalesce(value, F.lit("")))) for name, value in parts)), F.lit("\n"))


def verify(claims: DataFrame, sets: DataFrame, verifier) -> DataFrame:
    """(answer_id, index, status): cited claims judged against all the blocks they cite together.

    Claims without citations are uncited; claims that cite only blocks that don't exist are unsupported without asking
    the verifier, a function of a DataFrame with ``claim`` and ``evidence`` that adds ``reply``.
    """
    blocks = sets.select(F.col("query_id").alias("answer_id"), F.transform("results", lambda r: r["text"]).alias("blocks"))
    rows = claims.join(blocks, "answer_id", "left").withColumn("real", F.filter("citations", lambda n: (n >= 1) & (n <= F.coalesce(F.size("blocks"), F.lit(0)))))
    asked = rows.where(F.size("real") > 0).select("answer_id", "index", F.col("text").alias("claim"), F.array_join(F.transform("real", lambda n: F.element_at("blocks", n)), "\n\n").alias("evidence"))
    judged = verifier(asked).select("answer_id", "index", F.lower(support(F.col("reply"))).alias("status"))
    rest = rows.where(F.size("real") <= 0).select("answer_id", "index", F.when(F.size("citations") > 0, "unsupported").otherwise("uncited").alias("status"))
    return judged.unionByName(rest)


def verification_report(verified: DataFrame) -> DataFrame:
    """(answer_id, coverage, precision): supported by all and by cited claims; null where there are none."""
    n, cited, good = F.count("*"), F.count_if(F.col("status") != "uncited"), F.count_if(F.col("status") == "supported")
    return verified.groupBy("answer_id").agg(n.alias("claims"), F.round(good / F.nullif(n, F.lit(0)), 6).alias("coverage"), F.round(good / F.nullif(cited, F.lit(0)), 6).alias("precision"))
