"""Documents from files: dispatch by extension, Markdown with includes, HTML, plain text; sections with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.ids import document_id, section_id
from spanloom.functions.text import normalise_text

# The extensions of each format.
FORMATS = {"markdown": ("md", "markdown"), "html": ("html", "htm"), "text": ("txt",), "pdf": ("pdf",)}
DROPPED_TAGS = ("script", "style", "noscript")
INCLUDE = re.compile(r"^\s*\{\*\s+(\S+)(?:\s+[^*]*)?\*\}\s*$")
_BLOCKS = "array<struct<heading_path:array<string>,level:int,text:string,page:int>>"


def source_format(path: Column) -> Column:
    """The format by extension; anything else is an error that lists what is known."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = ", ".join(f".{e}" for own in FORMATS.values() for e in own)
    out = F.raise_error(F.concat(F.lit("unsupported file "), path, F.lit(f"; supported: {known}")))
    for name, own in FORMATS.items():
        out = F.when(suffix.isin(*own), name).otherwise(out)
    return out


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, raw, digest, source_format) of every supported file under ``root``, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    suffixes = [e for own in FORMATS.values() for e in own]
    rows = files.select(relative.alias("relative_path"), F.col("content").alias("raw")).where(F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes))
    return rows.select("relative_path", "raw", F.sha1("raw").alias("digest"), source_format(F.col("relative_path")).alias("source_format"))


def _push(stack: list[str], depth: int, heading: str) -> list[str]:
    stack = stack[: depth - 1] + [""] * max(0, depth - 1 - len(stack))
    return [*stack, heading]


def markdown_blocks(text: str) -> list[tuple]:
    """(heading_path, level, text, page): Markdown cut at headings outside fences; front matter, admonition marks and tags go."""
    text = re.sub(r"\A---\n.*?\n---\n", "", text, flags=re.DOTALL)
    out, stack, level, lines, fence = [], [], 0, [], None
    for line in text.split("\n"):
        mark = re.match(r"[ \t]*(```+|~~~+)", line)
        if mark:
            fence = None if fence else mark.group(1)
        heading = None if fence or mark else re.match(r"(#{1,6})\s+(.*?)(?:\s*\{[^}]*\})?\s*#*\s*$", line)
        if heading:
            out.append(([h for h in stack if h], level, "\n".join(lines), None))
            level = len(heading.group(1))
            stack, lines = _push(stack, level, re.sub(r"<[^>]+>", "", heading.group(2)).strip()), []
        elif fence or mark:
            lines.append(line)
        elif not re.match(r"\s*///", line):
            lines.append(re.sub(r"</?[A-Za-z][^>]*>", "", line))
    out.append(([h for h in stack if h], level, "\n".join(lines), None))
    return out


class _Outline(HTMLParser):
    """Text nodes by heading; script, style and noscript are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.level, self.lines, self.title = [], [], 0, [], ""
        self.heading: tuple[int, list[str]] | None = None
        self.hidden, self.in_title = 0, False

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.heading = int(tag[1]), []

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif self.heading and tag == f"h{self.heading[0]}":
            depth, words = self.heading
            self.out.append(([h for h in self.stack if h], self.level, "\n".join(self.lines), None))
            self.stack, self.level, self.lines, self.heading = _push(self.stack, depth, " ".join(words)), depth, [], None

    def handle_data(self, data):
        own = data.strip()
        if not own or self.hidden:
            return
        if self.in_title:
            self.title += own
        elif self.heading:
            self.heading[1].append(own)
        else:
            self.lines.append(own)


def html_blocks(text: str) -> tuple[str, list[tuple]]:
    """(title, blocks): cut at h1 to h6."""
    outline = _Outline()
    outline.feed(text)
    outline.close()
    return outline.title, [*outline.out, ([h for h in outline.stack if h], outline.level, "\n".join(outline.lines), None)]


def parsed(files: DataFrame) -> DataFrame:
    """(relative_path, source_format, title, blocks) of text files. files: relative_path, text, source_format.

    PDF needs a library that isn't at hand and is refused; a title is the first level-1 heading, the HTML title, or
    the file's stem.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, kind in zip(batch["relative_path"], batch["text"], batch["source_format"], strict=True):
                stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
                title, blocks = "", [([], 0, text or "", None)]
                if kind == "markdown":
                    blocks = markdown_blocks((text or "").replace("\r\n", "\n").replace("\r", "\n"))
                    title = next((b[0][0] for b in blocks if b[1] == 1 and b[0]), "")
                elif kind == "html":
                    title, blocks = html_blocks(text or "")
                elif kind == "pdf":
                    raise ValueError(f"no PDF library to read {path}")
                rows.append((path, kind, title or stem, [dict(zip(("heading_path", "level", "text", "page"), b, strict=True)) for b in blocks]))
            yield pd.DataFrame(rows, columns=["relative_path", "source_format", "title", "blocks"])

    return files.select("relative_path", "text", "source_format").mapInPandas(parse, f"relative_path string, source_format string, title string, blocks {_BLOCKS}")


def expand_includes(files: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown files with ``{* path *}`` lines replaced by fenced blocks of the named files; and the includes that no file answers.

    files: relative_path, text; includes: path, content, relative to the include root.  Leading ``..`` parts are
    dropped, so an include can't leave the root; a line without an answer goes.  Only include lines are joined.
    """
    lines = files.select("relative_path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    named = F.regexp_extract("line", INCLUDE.pattern, 1)
    target = F.regexp_replace(named, r"^(?:\.\.?/)+", "")
    rows = lines.where(named != "").select("relative_path", "i", target.alias("path"))
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    block = F.concat(F.lit("```"), suffix, F.lit("\n"), F.regexp_replace("_content", r"\n+$", ""), F.lit("\n```"))
    joined = rows.join(includes.select("path", F.col("content").alias("_content")), "path", "left").withColumn("block", block)
    found = joined.groupBy("relative_path").agg(F.map_from_entries(F.collect_list(F.struct("i", "block"))).alias("_blocks"))
    put = F.transform(F.split("text", "\n"), lambda line, i: F.when(F.map_contains_key("_blocks", i), F.element_at("_blocks", i)).otherwise(line))
    text = F.when(F.col("_blocks").isNull(), F.col("text")).otherwise(F.array_join(F.filter(put, lambda x: x.isNotNull()), "\n"))
    unresolved = joined.where("_content IS NULL").select("relative_path", "path").distinct()
    return files.join(found, "relative_path", "left").select("relative_path", F.coalesce(text, F.lit("")).alias("text")), unresolved


def include_root(corpus: str, marker: str = "docs_src") -> str | None:
    """The nearest folder above a local corpus that holds ``marker``, from which includes are resolved; None without one."""
    return next((str(p) for p in Path(corpus).resolve().parents if (p / marker).is_dir()), None)


def assemble(parsed_files: DataFrame) -> DataFrame:
    """Documents with sections: doc_id, relative_path, source_format, title, text, content_hash and sections.

    Each block's text is normalised, empty ones go, and the rest is joined by blank lines; a heading path that repeats
    is told apart by ``occurrence=N`` from its second time, a page by ``page=N``.
    """
    kind = "array<struct<start:int,stop:int>>"
    clean = F.filter(F.transform("blocks", lambda b: b.withField("text", normalise_text(b["text"]))), lambda b: b["text"] != "")
    rows = parsed_files.withColumn("blocks", clean)
    spans = F.aggregate(
        "blocks", F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda s, b: F.struct((s["at"] + F.length(b["text"]) + 2).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(b["text"])).alias("stop")))).alias("out")),
        lambda s: s["out"],
    )
    rows = rows.withColumn("spans", spans)
    path = F.col("relative_path")
    same = lambda i, b: F.size(F.filter(F.slice("blocks", F.lit(1), i), lambda o: o["heading_path"] == b["heading_path"]))
    mark = lambda i, b: F.when(b["page"].isNotNull(), F.concat(F.lit("page="), b["page"].cast("string"))).when(same(i, b) > 0, F.concat(F.lit("occurrence="), same(i, b).cast("string"))).otherwise("")
    section = lambda b, i: F.struct(section_id(path, b["heading_path"], mark(i, b)).alias("section_id"), path.alias("relative_path"), b["heading_path"].alias("heading_path"), b["level"].alias("level"), b["text"].alias("text"), F.element_at("spans", i + 1)["start"].alias("start_char"), F.element_at("spans", i + 1)["stop"].alias("end_char"), b["page"].alias("page"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    out = rows.select(document_id(path).alias("doc_id"), path, "source_format", "title", text.alias("text"), F.transform("blocks", section).alias("sections"))
    return out.withColumn("content_hash", F.sha1("text"))


def text_documents(files: DataFrame) -> DataFrame:
    """Plain texts as documents of one section, without leaving the JVM. files: relative_path, text."""
    block = F.struct(F.array().cast("array<string>").alias("heading_path"), F.lit(0).alias("level"), F.col("text"), F.lit(None).cast("int").alias("page"))
    stem = F.regexp_replace(F.regexp_extract("relative_path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return assemble(files.select("relative_path", F.lit("text").alias("source_format"), stem.alias("title"), F.array(block).alias("blocks")))


def stale(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, change): edited, deleted or new by digest. Both have relative_path and digest."""
    both = manifest.select("relative_path", F.col("digest").alias("_old")).join(current.select("relative_path", F.col("digest").alias("_new")), "relative_path", "full_outer")
    change = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "new").otherwise("edited")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("relative_path", change.alias("change"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row written for each key."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upload_status(name: Column, text: Column) -> Column:
    """HTTP status of an upload: 415 for a suffix other than md and txt, 422 for a text without words, which gives no chunk, else 200; only the base name counts."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(~F.lower(base).rlike(r"\.(md|txt)$"), 415).when(~F.coalesce(text, F.lit("")).rlike(r"\S"), 422).otherwise(200)
