"""Licence detection: sparse TF-IDF cosine of headers and licence files to templates, and inheritance down the directory tree.

The units compared are single lines, header blocks (paragraphs, runs of comment lines, block comments) and whole licence
files.  A unit is split into terms and compared with every template by the cosine of their TF-IDF vectors, joined term by
term.  Templates are one-line wordings, SPDX tags, header blocks and licence texts; the long texts are compared with whole
licence files alone.  Document frequencies count the templates alone, so a unit's cosine does not depend on the other
files; a term of no template has the weight of one that is in none, and words of any prose weigh least.  A file takes
the template of its best unit at ``LEAST_COSINE`` or more; a file without one inherits from the licence file in its own
directory, or in the nearest directory above that has one.

Units that cannot reach the threshold are left out first.  By Cauchy and Schwarz, the terms shared with a template must
hold at least ``LEAST_COSINE`` squared of the template's squared length, and as much of the unit's.  ``cue_pattern`` names
enough terms of each template that the others hold less; and as a term counts at most ``MOST_COUNT`` times, a unit's
terms that are in no template may be at most ``MOST_COUNT**2 * (1 / LEAST_COSINE**2 - 1)`` times those that are, of
which words of prose, at the least weight of 1, hardly count.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.spans import row_key
from spanloom.shared import written

LEAST_COSINE = 0.5
LEAST_SHARED = 2  #: different terms, words of prose aside, that a unit must share with a template, so that one word ("mit" in German) is none
MOST_COUNT = 2.0  #: bound of a term's count 1 + ln(times)
LONG = 300  #: words from which a template is compared with whole licence files alone
_TERM = "[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
# Words of any prose, weighted as if every template had them and the last to be named in the cue pattern.
_PROSE = set("a about all also am an and any are as at be been being but by can could de did do does each else etc for from had has have he her here his how i if in into is it its la le may me more most must my no nor not of off on one only or other our out over own s shall she should so some such t than that the their them then there these they this those to too under up us was we were what when where which who will with without would you your".split())

# SPDX identifiers and the wordings by which a header or a licence file names each.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1-only": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-only": "This program is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain, see the Unlicense.",
    "Proprietary": ("Copyright. All rights reserved.", "All rights reserved."),
}
# The notices that licences ask for at the head of a file.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
} | {
    f"{tag}-{number}-{kind}": f"This {it} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; {'either ' if kind == 'or-later' else ''}version {number.removesuffix('.0')} of the License{', or (at your option) any later version' if kind == 'or-later' else ''}. This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {it}. If not, see <https://www.gnu.org/licenses/>."
    for tag, name, it, numbers in (("GPL", "General Public License", "program", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", "library", ("2.1", "3.0")), ("AGPL", "Affero General Public License", "program", ("3.0",)))
    for number in numbers
    for kind in ("only", "or-later")
}
TITLES = {"Apache-2.0": "Apache License Version 2.0, January 2004", "MIT": "The MIT License (MIT)", "ISC": "ISC License", "AGPL-3.0-only": "GNU Affero General Public License", "GPL-3.0-only": "GNU General Public License Version 3, 29 June 2007", "GPL-2.0-only": "GNU General Public License Version 2, June 1991", "MPL-2.0": "Mozilla Public License Version 2.0"}
TEXTS = Path(__file__).parent / "licence_texts"  #: whole licences, a file named by its SPDX identifier each
#: SPDX identifiers that stand for another by an older name.
OLDER = {f"{tag}{plus}": f"{tag}-{'or-later' if plus else 'only'}" for tag in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for plus in ("", "+")}
RESERVED = "Proprietary"  #: taken only where no other template is reached, as most licences reserve rights too


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def all_templates() -> list[tuple[str, str]]:
    """(licence, text) of the one-line wordings, titles, headers, whole texts and SPDX tags."""
    texts = {path.stem: path.read_text() for path in sorted(TEXTS.glob("*.txt"))}
    rows = [(name, text) for group in (TEMPLATES, TITLES, HEADERS, texts) for name, own in group.items() for text in ([own] if isinstance(own, str) else own)]
    tags = {name: name for name, _ in rows if name != RESERVED} | OLDER
    return rows + [(name, f"{key}: {tag}") for tag, name in tags.items() for key in ("SPDX-License-Identifier", "License")]


def template_table(spark: SparkSession, templates: dict[str, str | tuple[str, ...]] | None = None) -> DataFrame:
    """(licence, text): one row a template; a licence may have several."""
    rows = all_templates() if templates is None else [(name, text) for name, texts in templates.items() for text in ([texts] if isinstance(texts, str) else texts)]
    return _constants(spark, rows, "licence string, text string")


def _constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a constant of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    fields = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    struct = ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(fields), f"array<struct<{struct}>>")))


def _vectors(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """(weight of each term, weight of any other term, each template as a vector of length one)."""
    counts = [Counter(re.findall(_TERM, text.lower())) for _, text in templates]
    df = Counter(term for c in counts for term in c)
    idf = {term: math.log((1 + len(counts)) / (1 + (len(counts) if term in _PROSE else n))) + 1 for term, n in df.items()}
    vectors = [{term: min(1 + math.log(n), MOST_COUNT) * idf[term] for term, n in c.items()} for c in counts]
    sizes = [math.sqrt(sum(v * v for v in own.values())) for own in vectors]
    return idf, math.log(1 + len(counts)) + 1, [{term: v / size for term, v in own.items()} for own, size in zip(vectors, sizes, strict=True)]


def cue_pattern(vectors: list[dict[str, float]]) -> str:
    """A pattern of terms, in lower case, that every text at ``LEAST_COSINE`` or more to one of the vectors matches."""
    named = set()
    for own in vectors:
        room = LEAST_COSINE**2 - 1e-5  # cosines are rounded to six decimals
        for term in sorted(own, key=lambda t: (t not in _PROSE, own[t], t)):
            room -= own[term] ** 2
            if room <= 0:
                named.add(term)
    begins = defaultdict(list)
    for term in sorted(named):
        begins[term[0]].append(re.escape(term[1:]))
    return rf"(?<![a-z0-9])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in begins.items())})(?![a-z0-9])" if named else "(?!)"


_SIGN = r"[ \t]*+(?:#|//|\*|/\*|--|;|%|<!--|@?rem\b|dnl\b)[^\n]*+"
_BLOCKS = (rf"(?im)^{_SIGN}(?:\n{_SIGN})++", r"(?s)/\*.*?\*/", r"(?s)<!--.*?-->", r"(?m)^[ \t\r\f]*+\S[^\n]*+(?:\n[ \t\r\f]*+\S[^\n]*+)++")  # possessive, as lines can be long


def _units(text: Column) -> Column:
    """Lines in order, then blocks of two lines and more."""
    blocks = F.concat(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for pattern in _BLOCKS))
    return F.concat(F.split(text, "\n"), F.array_distinct(F.filter(blocks, lambda b: F.instr(b, "\n") > 0)))


def header_matches(files: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, unit, licence, cosine): the best template of each unit, ties by name; units below the threshold are left out.

    files: ``key``, ``text`` and, where it is known, ``whole``: whether the text is a licence file, to be compared as a
    whole too.  Units are numbered: -1 the whole text, then lines, then blocks.  Templates are a fixed list: their vectors
    are computed on the driver and broadcast.  The candidate units are a table, so the texts are read once.
    """
    spark = files.sparkSession
    if "whole" not in files.columns:
        files = files.withColumn("whole", F.lit(False))
    named = [(r["licence"], r["text"]) for r in templates.where("licence IS NOT NULL AND text IS NOT NULL").select("licence", "text").collect()]
    idf, other, vectors = _vectors(named)
    long = [len(text.split()) >= LONG for _, text in named]
    short_ones = [own for own, is_long in zip(vectors, long, strict=True) if not is_long]
    cue = cue_pattern(short_ones)
    listed = lambda terms: F.array(*map(F.lit, sorted(terms))).cast("array<string>")
    telling = lambda group: listed({t for own in group for t in own} - _PROSE)
    cued = F.when(F.lower("text").rlike(cue), _units(F.col("text")))
    held = files.select("key", F.inline(F.concat(
        F.when(F.col("whole") & F.col("text").isNotNull(), F.array(F.struct(F.lit(-1).alias("unit"), F.col("text").alias("words")))).otherwise(F.array().cast("array<struct<unit:int,words:string>>")),
        F.filter(F.transform(F.coalesce(cued, F.array().cast("array<string>")), lambda w, k: F.struct(k.alias("unit"), w.alias("words"))), lambda u: F.lower(u["words"]).rlike(cue)),
    )))
    terms = held.select("key", "unit", _terms(F.col("words")).alias("terms")).withColumn("own", F.array_distinct("terms"))
    strange = F.size(F.array_except("own", listed({*idf, *_PROSE})))
    shared = F.size(F.array_intersect("own", F.when(F.col("unit") < 0, telling(vectors)).otherwise(telling(short_ones))))
    prose = F.size("own") / F.lit(other**2)  # more than the words of prose weigh
    lines = terms.where(F.when(shared >= LEAST_SHARED, strange <= MOST_COUNT**2 * (1 / LEAST_COSINE**2 - 1) * (shared + prose))).select("key", "unit", "terms")
    lines = written(lines, "licence-units").dropDuplicates(["key", "unit"])  # rows of one key are copies
    times = lines.select("key", "unit", F.explode("terms").alias("term")).groupBy("key", "unit", "term").agg(F.count("*").alias("times"))
    weights = _constants(spark, list(idf.items()), "term string, idf double")
    entries = _constants(spark, [(k, named[k][0], long[k], term, v, term not in _PROSE) for k, own in enumerate(vectors) for term, v in own.items()], "template int, licence string, long boolean, term string, v double, telling boolean")
    lined = times.join(F.broadcast(weights), "term", "left").select("key", "unit", "term", (F.least(1 + F.log("times"), F.lit(MOST_COUNT)) * F.coalesce("idf", F.when(F.col("term").isin(*sorted(_PROSE)), 1.0).otherwise(other))).alias("w"))
    norms = lined.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = lined.join(F.broadcast(entries), "term").where("unit < 0 OR NOT long").groupBy("key", "unit", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.count_if("telling").alias("shared")).where(F.col("shared") >= LEAST_SHARED)
    cosines = dots.join(norms, ["key", "unit"]).select("key", "unit", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= LEAST_COSINE)
    best = cosines.groupBy("key", "unit").agg(F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("cosine")).alias("less"), "licence")).alias("best"))
    return best.select("key", "unit", "best.licence", (-F.col("best.less")).alias("cosine"))


def scan(files: DataFrame, templates: DataFrame | None = None, licence_file: str = r"(?i)(^|/)(LICEN[SC]E|COPYING|NOTICE)(\.[A-Za-z]+)?$") -> DataFrame:
    """Each file's licence: key, path, own_licence, own_cosine, inherited_licence, inherited_from and licence (own, else inherited, else NOASSERTION).

    files: ``key``, ``path`` with ``/`` between directories, and ``text``; further columns are ignored.  A key may be null
    or repeated: every row is judged by its own path and text.  A null text matches nothing, a null path inherits nothing.  Of several licence
    files in one directory the best match counts, ties by path.  An empty table gives no rows.
    """
    spark = files.sparkSession
    templates = template_table(spark) if templates is None else templates
    files = files.select("key", "path", "text", row_key(*map(F.col, ("key", "path", "text"))).alias("_row"))
    found = header_matches(files.select(F.col("_row").alias("key"), "text", F.coalesce(F.col("path").rlike(licence_file), F.lit(False)).alias("whole")), templates)
    own = found.groupBy("key").agg(F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("cosine")).alias("less"), "unit", "licence")).alias("best")).select(F.col("key").alias("_row"), F.col("best.licence").alias("own_licence"), (-F.col("best.less")).alias("own_cosine"))
    placed = files.select("key", "path", "_row", F.regexp_replace("path", "[^/]*$", "").alias("dir")).join(own, "_row", "left")
    holding = placed.where(F.col("own_licence").isNotNull() & F.col("path").rlike(licence_file)).groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("less"), "path", "own_licence")).alias("best"))
    holding = holding.select(F.col("dir").alias("above"), F.col("best.own_licence").alias("inherited_licence"), F.col("best.path").alias("inherited_from"))
    parts = F.split(F.regexp_replace("dir", "/$", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    ancestors = placed.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = ancestors.join(holding, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "inherited_licence", "inherited_from")).alias("best"))
    inherited = nearest.select("dir", "best.inherited_licence", "best.inherited_from")
    out = placed.join(inherited, "dir", "left")
    return out.select("key", "path", "own_licence", "own_cosine", "inherited_licence", "inherited_from", F.coalesce("own_licence", "inherited_licence", F.lit("NOASSERTION")).alias("licence"))
