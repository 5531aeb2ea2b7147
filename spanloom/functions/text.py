"""Text functions as Column expressions: normalisation, terms, sentences, offsets, citations, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that results depend on.
RUN = r"[A-Za-z0-9][A-Za-z0-9_.\-]*"
RUN_TAIL = r"[_.\-]+$"
PART_BREAK = r"[_.\-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SENTENCE_BREAK = r"(?<=[.!?])[ \t]+(?=[A-Z\"'(\[])"
PARAGRAPH_BREAK = r"\n[ \t]*\n"
LIST_MARKER = r"^\s*(?:[-*+]|\d+[.)])\s+"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
PROTECTED = r"(?s)(?:^|(?<=\n))[ \t]*(```+|~~~+).*?(?:\n[ \t]*\1[^\n]*|\z)|`[^`\n]+`"


def normalise_text(text: Column) -> Column:
    """Line ends to LF, no blanks at line ends, at most one blank line in a row, none around; indentation stays."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    bare = F.regexp_replace(unix, r"(?md)[ \t\x0b\f]+$", "")
    single = F.regexp_replace(bare, "\n{3,}", "\n\n")
    return F.regexp_replace(single, r"\A\s+|\s+\z", "")


def terms(text: Column) -> Column:
    """Search terms in order: each run in lower case, followed by its parts if it has a letter and falls into several."""
    runs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda x: F.regexp_replace(x, RUN_TAIL, "")), lambda x: x != "")
    parts = lambda x: F.filter(F.split(x, PART_BREAK), lambda p: p != "")
    extra = lambda x: F.when(x.rlike("[A-Za-z]") & (F.size(parts(x)) > 1), F.transform(parts(x), F.lower)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, lambda x: F.concat(F.array(F.lower(x)), extra(x))))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space: the default token counter."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def piece_spans(pieces: Column, gap: int = 0) -> Column:
    """(start, stop) of consecutive pieces that lie ``gap`` characters apart, in code points."""
    kind = "array<struct<start:int,stop:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + F.length(piece)
        return F.struct((stop + F.lit(gap)).alias("at"), F.concat(state["out"], F.array(F.struct(state["at"].alias("start"), stop.alias("stop")))).alias("out"))

    return F.aggregate(pieces, begin, step, lambda s: s["out"])


def sentences(text: Column) -> Column:
    """Sentences of a text without fences: cut after . ! ? before a capital, quote or bracket, and at blank lines."""
    return F.filter(F.flatten(F.transform(F.split(text, PARAGRAPH_BREAK), lambda p: F.split(p, SENTENCE_BREAK))), lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_BREAK), lambda p: F.trim(p) != "")


def masked(text: Column) -> Column:
    """The text without fenced blocks and inline code, so that nothing in them counts as a citation."""
    return F.regexp_replace(text, PROTECTED, " ")


def citation_numbers(text: Column) -> Column:
    """Numbers cited in square brackets outside code, each once, in order of first appearance."""
    groups = F.regexp_extract_all(masked(text), F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.try_cast("int")))))


def source_label(path: Column, headings: Column) -> Column:
    return F.concat_ws(" > ", path, headings)


def is_assertion(text: Column) -> Column:
    """Three letters at least once citations are gone, and neither rule nor table separator."""
    bare = F.regexp_replace(text, CITATION, "")
    return (F.length(F.regexp_replace(bare, "[^A-Za-z]", "")) >= 3) & ~F.trim(bare).rlike(r"^[-*_|:\s]+$")


def bare_line(text: Column) -> Column:
    """Without one block-quote sign and then one list marker; more of them are part of what is said."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*>\s?", ""), LIST_MARKER, ""))


def is_insufficient(text: Column) -> Column:
    """The answer is the sentinel of a model that lacks context, give or take quotes, dots and blanks."""
    return F.regexp_replace(text, r"^[\s.\"'`]+|[\s.\"'`]+$", "") == "INSUFFICIENT_CONTEXT"


def labelled(text: Column, label: str) -> Column:
    """Word of a ``LABEL: word`` line in upper case, bold markers tolerated; null without such a line."""
    return F.nullif(F.upper(F.regexp_extract(text, rf"(?im)^\s*\**\s*{label}\s*\**\s*:\s*\**\s*(\w+)", 1)), F.lit(""))


def labelled_value(text: Column, label: str, allowed: list[str]) -> Column:
    """The same if it is one of ``allowed``; else null."""
    found = labelled(text, label)
    return F.when(found.isin(*allowed), found)


def reason_line(text: Column) -> Column:
    """What follows ``REASON:`` on its line; empty without one."""
    return F.trim(F.regexp_extract(text, r"(?im)^\s*\**\s*REASON\s*\**\s*:\s*\**\s*(.+)", 1))


def readable(value: Column, what: str, text: Column) -> Column:
    """The value, or an error that shows where the unreadable text begins."""
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"{what} can't be read: "), F.coalesce(F.substring(text, 1, 120), F.lit("null"))))).otherwise(value)
