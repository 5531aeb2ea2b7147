"""Repeated windows, near-duplicates, leaked items, licences, secrets, personal data, quality: against brute force."""

import hashlib
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import components, decontam, jaccard, license_scan, pii, quality, secret_scan, superkmer

DOCS = "doc_id long, text string, d string, n long"
rng = random.Random(5)
VOCABULARY = ["the", "of", "and", "Thé", "x1", "kilo", "lima", "mike", "nov", "oscar", "papa", "q"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)


def sentence(n, words=VOCABULARY):
    return " ".join(rng.choice(words) for _ in range(n))


def test_repeated_windows(spark):
    passage, other = sentence(60), sentence(45)
    texts = [passage + " " + sentence(30), sentence(20) + "\n" + passage, passage[10:], "", None, sentence(34), other + "\t" + other, " lead  " + passage.replace(" ", "  ", 5), "  ", sentence(500), "é " * 80]
    rows = [*enumerate(texts), (3, passage), (0, texts[0]), (None, sentence(50)), (None, None)]
    for window in (6, 35):
        words = [(t or "").encode().split() for _, t in rows]
        counts = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
        want = Counter()
        for (i, _), w in zip(rows, words, strict=True):
            gone = {j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
            kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
            want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
        got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")) for r in superkmer.remove_repeats(documents(spark, rows), window).collect())
        assert got == want
    assert superkmer.remove_repeats(documents(spark, []), 35).count() == 0


def test_equal_hashes_are_compared_by_words(monkeypatch):
    monkeypatch.setattr(superkmer, "_run_hashes", lambda values, starts, stops: np.zeros(len(starts), np.uint64))
    again, first = superkmer._repeating([b"a b c", b"b c d", b"x y z"], np.zeros(3, np.uint8), 2)
    assert again.tolist() == [False, True, True, False, False, False] and first.tolist() == [0, 2, 4, 6]


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def component_ids(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[a + 1 :]:
            if s and o and 100 * len(s & o) >= 75 * len(s | o):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(base, n, edits):
    words = base.split()
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("settings", [{}, {"PAIRED_GROUP": 3, "FREQUENT_FROM": 2, "TASK_TOKENS": 300}, {"PAIRED_GROUP": 2, "FREQUENT_FROM": 2, "TASK_TOKENS": 150}, {"PAIRED_GROUP": 2, "FREQUENT_FROM": 1000}])
def test_near_duplicates(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = ["", None, " \n ", "one", "One", "a b c d e", "A b c d e f", sentence(5), *near_copies(sentence(80), 25, 4), *near_copies(sentence(30), 12, 1), *(sentence(rng.randint(1, 60)) for _ in range(25)), "of of of of of of", "of of of of of of of of"]
    texts += [texts[9], texts[20]]
    passage = sentence(40)
    texts += [passage + " " + sentence(rng.randint(20, 60)) for _ in range(10)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == component_ids(rows)
    kept = {r["doc_id"] for r in jaccard.one_of_each(documents(spark, rows)).collect()}
    assert kept == {c for _, c in got.values()}


def test_phrases_in_many_texts_link_nothing(spark, monkeypatch):
    """Shingles of frequent words meet by chance, and passages repeat, more of them than the list of frequent tokens holds: they mustn't make candidates."""
    monkeypatch.setattr(jaccard, "FREQUENT_TOKENS", 1)
    monkeypatch.setattr(jaccard, "PAIRED_GROUP", 4)
    verified, candidates = jaccard._verified_links, []
    monkeypatch.setattr(jaccard, "_verified_links", lambda rows, sets, t: candidates.append(sets.count()) or verified(rows, sets, t))
    gen = random.Random(8)
    phrases = [" ".join(gen.choice(["of", "the", "and", "to", "in"]) for _ in range(9)) for _ in range(6)]
    passages = [" ".join(f"p{k}x{j}" for j in range(7)) for k in range(3)]  # of rare words, but in many texts
    texts = [" ".join([*(f"w{k}x{j}" for j in range(45)), *gen.sample(phrases, 3), passages[k % 3]]) for k in range(60)]
    texts += [texts[0] + " end", texts[1].replace("w1x7 ", "")]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == component_ids(rows) and [got[k][1] for k in (60, 61)] == [0, 1]
    assert candidates == [4]


def test_links_of_a_large_group_follow_its_sets(spark, monkeypatch):
    """Near copies share many keys in large groups: each set is linked about once, not once for each key."""
    found, linked = jaccard.components, []
    monkeypatch.setattr(jaccard, "components", lambda links: linked.append(links.count()) or found(links))
    gen = random.Random(11)
    base = [f"w{j}" for j in range(60)]
    texts = []
    for k in range(700):
        words = list(base)
        words[gen.randrange(60)] = f"x{k}"
        texts.append(" ".join(words))
    rows = [*enumerate(texts), (700, " ".join(f"y{j}" for j in range(60)))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == component_ids(rows) and sum(c == 0 for _, c in got.values()) > 600
    assert linked[0] <= 4 * len(rows)


def test_few_texts_are_shuffled_and_shuffles_given_back(spark, monkeypatch):
    """Joins by key get the rows whose key may match and few others; shuffle files go when what they were written for is done."""
    split, met = jaccard.split_by_keys, []

    def counted(rows, key, keys):
        parts = split(rows, key, keys)
        met.append((keys.count(), *(part.count() for part in parts)))
        return parts

    monkeypatch.setattr(jaccard, "split_by_keys", counted)
    env = spark._jvm.org.apache.spark.SparkEnv.get()

    def shuffles():
        files = env.blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    gen = random.Random(3)
    texts = [" ".join(f"w{gen.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    rows = [*enumerate(texts), (400, texts[0] + " end"), (401, texts[1]), (1, texts[1])]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, _at string, _row_key long")
    before = shuffles()
    left = jaccard.one_of_each(docs)
    until = time.time() + 20
    while (kept := len(shuffles() - before)) > 20 and time.time() < until:
        time.sleep(0.5)
    assert kept <= 20
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(enumerate(texts)) and left.columns == docs.columns
    assert len(met) == 2
    for keys, near, far in met:
        assert keys <= near <= keys + 20 and near + far == len(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, None), (None, None)]
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(documents(spark, rows)).collect())
    assert got == Counter({(None, 1): 1, (1, 1): 3, (None, None): 1})
    assert Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(documents(spark, rows)).collect())[1, "a b c d e f"] == 1
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0
    two = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "quite another text of its own here"), (None, "quite another text of its own here"), (5, ""), (None, "x y z q r s"), (None, "x y z q r s")]
    left = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(documents(spark, two)).collect())
    assert left == Counter({(1, "a b c d e f g"): 1, (5, "quite another text of its own here"): 1, (5, ""): 1, (None, "x y z q r s"): 1})
    w = sentence(60).split()
    bridge = [(3, " ".join(w)), (None, " ".join([*w[:50], "m1", *w[51:]])), (9, " ".join([*w[:48], "m2", "m1", *w[51:]]))]
    bridge[2] = (9, " ".join([*w[:10], "m3", *w[11:50], "m1", *w[51:]]))
    linked = {a: [b for b in range(3) if 100 * len(shingles(bridge[a][1]) & shingles(bridge[b][1])) >= 75 * len(shingles(bridge[a][1]) | shingles(bridge[b][1]))] for a in range(3)}
    assert linked == {0: [0, 1], 1: [0, 1, 2], 2: [1, 2]}
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(documents(spark, bridge)).collect()} == {(3, 3), (None, 3), (9, 3)}
    with pytest.raises(ValueError):
        jaccard.near_duplicates(documents(spark, rows), Fraction(1, 2))


def test_no_similar_pair_is_missed():
    """Every similar pair of random sets shares enough index keys, whatever the list of frequent tokens."""
    t, gen = Fraction(3, 4), np.random.default_rng(4)
    for trial in range(60):
        n = int(gen.integers(3, 60))
        base = gen.choice(1 << 40, 90, replace=False).astype(np.uint64)
        sets = [np.sort(base[:n])]
        for _ in range(12):
            own = set(base[:n].tolist())
            own -= set(gen.choice(base[:n], int(gen.integers(0, n // 3 + 1)), replace=False).tolist())
            own |= set(gen.choice(base[n:], int(gen.integers(0, n // 3 + 1)), replace=False).tolist())
            sets.append(np.sort(np.array(sorted(own), np.uint64)))
        tokens, offsets = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        frequent = np.sort(gen.choice(base, int(gen.integers(0, 90)), replace=False)) if trial % 4 else np.zeros(0, np.uint64)
        rank = gen.permutation(len(frequent))
        owner, keys, mixed = jaccard.index_keys(tokens, offsets, frequent, rank, t)
        ids = jaccard.set_ids(tokens, offsets)
        a, b, shared, need = jaccard.candidate_pairs(keys, ids[owner], np.diff(offsets)[owner], mixed[owner], t)
        kept = {tuple(sorted(p)) for p in zip(a[shared >= need].tolist(), b[shared >= need].tolist(), strict=True)}
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                o = len(np.intersect1d(sets[x], sets[y]))
                if ids[x] != ids[y] and 4 * o >= 3 * (len(sets[x]) + len(sets[y]) - o):
                    assert tuple(sorted((int(ids[x]), int(ids[y])))) in kept


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (200, 150), (150, 175)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 150: 150, 175: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_myers_distance():
    for _ in range(150):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (70, 60))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        pattern = decontam.Pattern(p)
        assert list(pattern.distances(t)) == row[1:]
        distance, a, b = pattern.best(t, 1000)
        assert distance == min(row[1:]) == edit_distance(p, t[a:b])


def test_leaked_items(spark):
    item = "Some passage of a benchmark with quite a few words in it, number 17 of many."
    edited = item.replace("benchmark", "bencmark").replace("quite", "quitee")
    far = item.replace("passage", "xxxxxxx").replace("benchmark", "yyyyyyyyy")
    items = spark.createDataFrame([(1, item, "q"), (2, "too short", "q"), (5, "ab.", "q"), (3, None, "q"), (None, item, "q"), (4, "", "q")], "item_id long, text string, doc_id string")
    docs = documents(spark, [(1, "pre " + item.upper() + " post"), (2, "a\n" + edited.replace(" ", "\n ")), (3, far), (4, None), (5, ""), (6, item[:40]), (2, item + " " + edited), (None, item), (7, "it is Too\n short, though"), (8, "it is too shorter; tab."), (9, "an AB. here")])
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find_items(docs, items).collect())
    assert got == Counter({(1, 1, 0): 1, (2, 1, 2): 1, (2, 1, 0): 1, (None, 1, 0): 1, (7, 2, 0): 1, (9, 5, 0): 1})
    assert {r["doc_id"] for r in decontam.without_items(docs, items).collect()} == {3, 4, 5, 6, 8}
    assert decontam.find_items(docs.limit(0), items).count() == 0 and decontam.find_items(docs, items.limit(0)).count() == 0


def test_licences(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a/LICENSE", "x\nLicensed under the Apache License, Version 2.0."), ("a/b/c/f.py", "no words"), ("a/f.py", "# Licensed under CC BY-NC 4.0."), ("z/f.py", None), ("f.py", ""), (None, "nothing"), ("a/b/g.py", "This tells of a licence and of nothing else at all, so it is like none.")]
    files = spark.createDataFrame([(k, p, t, "clash") for k, (p, t) in enumerate(rows)], "key long, path string, text string, licence string")
    got = {r["key"]: (r["own_licence"], r["inherited_from"], r["licence"]) for r in license_scan.scan(files).collect()}
    assert got == {0: ("MIT", "LICENSE", "MIT"), 1: ("Apache-2.0", "a/LICENSE", "Apache-2.0"), 2: (None, "a/LICENSE", "Apache-2.0"), 3: ("CC-BY-NC-4.0", "a/LICENSE", "CC-BY-NC-4.0"), 4: (None, "LICENSE", "MIT"), 5: (None, "LICENSE", "MIT"), 6: (None, None, "NOASSERTION"), 7: (None, "a/LICENSE", "Apache-2.0")}
    assert license_scan.scan(files.limit(0)).count() == 0


PLANTED = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}


def test_planted_licence_lines(spark):
    """Each planted line is found whatever the other files are; rights reserved beside a licence do not replace it."""
    rows = [(k, f"d{k}/LICENSE", f"some words\n{line}\nmore words") for k, line in enumerate(PLANTED)]
    rows += [(k, f"e{k}/f.txt", "All rights reserved.") for k in range(100, 400)] + [(900, "g/f.txt", "All rights reserved.\nReleased under the MIT License."), (901, "d1/f.txt", "nothing")]
    got = {r["key"]: (r["own_licence"], r["licence"]) for r in license_scan.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert [got[k][0] for k in range(5)] == list(PLANTED.values())
    assert {got[k][0] for k in range(100, 400)} == {"Proprietary"}
    assert got[900][0] == "MIT" and got[901] == (None, "Proprietary")


def test_licence_cue_is_implied_by_the_threshold(spark):
    """Without the cue pattern no further line is found."""
    rng = random.Random(5)
    texts = [t for _, t in license_scan.all_templates() if len(t.split()) < 40]
    words = sorted({w for t in texts for w in t.split()}) + ["foo", "bar", "baz"]
    lines = [" ".join(rng.sample(t.split(), rng.randint(1, len(t.split()))) + rng.choices(words, k=rng.randint(0, 4))) for t in texts for _ in range(20)]
    files = spark.createDataFrame(list(enumerate(lines)), "key long, text string")
    found = lambda: {(r["key"], r["licence"], r["cosine"]) for r in license_scan.header_matches(files, license_scan.template_table(spark)).collect()}
    few, cue = found(), license_scan.cue_pattern
    try:
        license_scan.cue_pattern = lambda vectors: ""
        assert found() == few and few
    finally:
        license_scan.cue_pattern = cue


MIT_BODY = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
GPL_HEADER = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


def test_licence_headers_and_texts(spark):
    """SPDX tags, wrapped headers, and licence texts without a title line."""
    text = lambda name: (license_scan.TEXTS / f"{name}.txt").read_text()
    comment = lambda sign, words: "".join(f"{sign} {line}".rstrip() + "\n" for line in words.split("\n"))
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'
    names = sorted(p.stem for p in license_scan.TEXTS.glob("*.txt"))
    rows = [
        ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: Zlib", None),
        (comment("#", GPL_HEADER) + "import os\n", "GPL-3.0-or-later"), ("/*\n" + comment(" *", "Copyright A. Person. All rights reserved.\n\n" + MIT_BODY) + " */\nint x;", "MIT"), (comment("//", apache) + "\nint x;", "Apache-2.0"), ("Some words before.\n\n" + MIT_BODY + "\n\nand after", "MIT"),
        ("word " * 30_000 + "License: MIT\n\nThe person was free to sell a copy of the notice.\nThey use it without charge.", None), ("word " * 30_000 + "\nLicense: ISC", "ISC"),
    ]
    whole = [("d%d/LICENSE" % k, "Copyright (c) 2020 A. Person. All rights reserved.\n\n" + "\n".join(text(n).split("\n")[3 if len(text(n)) > 3000 else 0 :]), n) for k, n in enumerate(names)]
    files = [(k, f"f{k}.py", t) for k, (t, _) in enumerate(rows)] + [(100 + k, p, t) for k, (p, t, _) in enumerate(whole)]
    got = {r["key"]: r["own_licence"] for r in license_scan.scan(spark.createDataFrame(files, "key long, path string, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == [n for _, n in rows]
    assert [got[100 + k] for k in range(len(whole))] == names


def test_secrets(spark):
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'é😀 set token = "{key}" here'), (2, "pay 4845168114407329 now"), (3, None), (4, ""), (5, f"x api_key: {key} and password='{key[:32]}'"), (5, f"x api_key: {key} and password='{key[:32]}'"), (6, "a" * 5000)]
    docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    found = secret_scan.scan(docs.select(F.col("doc_id").alias("key"), F.lit("src").alias("path"), "text"), model).collect()
    assert {(r["key"], r["start"], r["stop"]) for r in found if r["is_secret"]} == {(1, 16, 56), (5, 11, 51), (5, 66, 98)}
    assert {r["key"] for r in found if not r["is_secret"]} == {2}
    clean = sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in secret_scan.redact(docs, model).collect())
    assert [c[:2] for c in clean if c[0] in (1, 2, 5)] == [(1, 'é😀 set token = "[SECRET]" here'), (2, "pay 4845168114407329 now"), (5, "x api_key: [SECRET] and password='[SECRET]'")] + [(5, "x api_key: [SECRET] and password='[SECRET]'")]
    assert len(clean) == len(rows) and clean[0][2] == len(clean[0][1])
    again = secret_scan.train(secret_scan.labelled_findings(spark).where("pmod(xxhash64(value), 5) != 0"))
    held = secret_scan.labelled_findings(spark).where("pmod(xxhash64(value), 5) = 0")
    scored = again.transform(secret_scan.features(held)[0]).select("label", "prediction").collect()
    hits = sum(r["label"] == r["prediction"] == 1 for r in scored)
    assert hits >= 0.95 * sum(r["label"] for r in scored) and hits >= 0.95 * sum(r["prediction"] for r in scored)  # recall and precision


def test_secrets_of_any_length_and_alphabet(spark):
    """Short values, values with signs or without digits, and passwords in addresses are masked; plain words are not."""
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    held = [('password = "%s" x', "Tr0ub4dor&3x"), ("password: %s", "hunter2secret"), ('secret="%s"', "p@ssw0rd!2024#long"), ("postgres://u:%s@h/db", "S3cr3tPass"), ("api_key=%s", "AbCdEfGhIjKlMnOpQrSt"), ("api_key=%s and", "AbCdEf12GhIj"), ('92@mail6.example.com token = "%s" de', "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587")]
    gen = random.Random(8)
    alnum = lambda n: "".join(gen.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    held += [("GITHUB=%s", "ghp_" + alnum(36)), ('slack "%s" hook', f"xoxb-{gen.randrange(10**11, 10**12)}-{gen.randrange(10**11, 10**12)}-{alnum(24)}"), ("Authorization: Bearer %s", f"eyJhbGciOiJIUzI1NiJ9.eyJ{alnum(50)}.{alnum(43)}"), ('password = "%s"', "CorrectHorseBatteryStaple"), ("password: %s", "hunter2hunter2"), ("use %s now", "glpat-" + alnum(20)), ("key: %s", "sk_live_" + alnum(24))]
    plain = ["the secret: it was told", "GITHUB=main_branch_name_2", "commit 1f0e3dad99908345f7439f8ffabdffc4a1b2c3d4", "see article_index_value_v2_main", "token: required", 'api_key = "${API_KEY}"', 'password = "required"', "token: null", "password=${PASSWORD}", "author: someone"]
    rows = list(enumerate([t % v for t, v in held] + plain))
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(documents(spark, rows), model).collect()}
    assert got == dict(enumerate([t % "[SECRET]" for t, _ in held] + plain))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans(spark):
    texts = ["a@b.c a@b@c.d x@a.b_c@d.e ..@x.y", "1.2.3.4.5 256.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 and 4111  1111 1111 1111", "4111111111111111 4111111111111111 5", "é😀 +1 (017) 555-7713 ret +12 +1234567890123456 ++49 30 123456.", "", None, "12 " * 3000, "9" * 20000, "a" * 20000, "x@y.z " * 500, "4111 1111 1111 1111-", "1" * 17 + " " + "2" * 4]
    texts += ["".join(rng.choice("0011249.@+ -()ab_é") for _ in range(300)) for _ in range(150)]
    texts += ["".join(rng.choice("41 -") for _ in range(60)) for _ in range(150)]
    rows = documents(spark, list(enumerate(texts)))
    for r in pii.candidates(rows).collect():
        got = [(m["kind"], m["start"], m["stop"]) for m in r["found"] if m["kind"] in pii.BASE]
        assert got == base_spans(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
    found = {r["doc_id"]: r["found"] for r in pii.detect(rows).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        kept = [(m["kind"], m["start"], m["stop"]) for m in found[k]]
        assert [x for x in kept if x[0] in pii.BASE] == base_spans(text or "")
    assert pii.detect(rows.limit(0)).count() == 0


def test_reliabilities_are_found():
    gen = np.random.default_rng(1)
    truth = gen.random(4000) < 0.4
    accuracy = (0.9, 0.85, 0.8, 0.6, 0.75)
    votes = np.column_stack([np.where(gen.random(4000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) * (gen.random(4000) < 0.8) for a in accuracy])
    counts = Counter(tuple(v) for v in votes.tolist())
    found = pii.estimate([("phone", v, n) for v, n in counts.items()])
    assert all(abs(found.accuracy[j] - a) < 0.06 for j, a in zip(pii.LABELERS, accuracy, strict=True)) and abs(found.share["phone"] - 0.4) < 0.05


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").where("pmod(crc32(cast(doc_id AS string)), 5) = 0").collect()
    good, bad = [[r for r in rows if r["quality"] == q] for q in (1, 0)]
    assert np.mean([r["predicted"] == 1 for r in good]) > 0.97 and np.mean([r["predicted"] == 0 for r in bad]) > 0.85


def test_quality_of_odd_tables(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "x" * 100_000), (None, "words"), (1, "words")])
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        rows = quality.score(docs, quality.train(docs, own)).collect()
        assert len(rows) == 5 and all(0 <= r["quality_score"] <= 1 and r["predicted"] == int(r["quality_score"] >= 0.3) for r in rows)
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0


@pytest.mark.parametrize("per_block", [4000, 3])
def test_leaked_items_against_all_windows(spark, monkeypatch, per_block):
    """Every item within its budget of some stretch of a document is found, and no other, whatever the blocks."""
    monkeypatch.setattr(decontam, "ITEMS_PER_BLOCK", per_block)
    own = random.Random(9)
    words = ["ab", "abc", "cab", "bca", "b", "acb"]
    items = [" ".join(own.choice(words) for _ in range(n)) for n in (3, 5, 9, 12, 14, 20, 25)]

    def edited(text, edits):
        text = list(text)
        for _ in range(edits):
            k = own.randrange(len(text))
            text[k : k + 1] = own.choice(([], ["a", "b"], ["c"], [text[k], "b"]))
        return "".join(text)

    docs = [" ".join([" ".join(own.choice(words) for _ in range(own.randint(0, 30))), edited(own.choice(items), own.randint(0, 7)), own.choice(["", "xyz"])]) for _ in range(14)]
    want = set()
    for d, text in enumerate(docs):
        text = decontam.normalised(text)
        for k, item in enumerate(items):
            n, most = len(item), decontam.budget(len(item))
            if n < decontam.FUZZY_FROM:
                places = [m.span() for m in re.finditer(rf"(?={re.escape(item)})", text)]
                ends = [(a, a + n) for a, _ in places]
                if any(not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()) for a, b in ends):
                    want.add((d, k, 0))
                continue
            best = min((edit_distance(item, text[a:b]) for a in range(len(text)) for b in range(a + n - most, min(len(text), a + n + most) + 1)), default=n)
            if best <= most:
                want.add((d, k, best))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find_items(documents(spark, enumerate(docs)), table).collect())
    assert set(got) == want and max(got.values()) == 1


def test_sizes_and_scores_by_hand(spark):
    """Features recomputed from plain compressed sizes; the score is their logistic; whole labelled rows up to the bound are read."""
    import zstandard

    good, bad = b"the cat sat on the mat and the dog " * 60, b"zx qy zx qy buy buy now cheap cheap " * 60
    sizes, text = quality.Sizes(good, bad), "the cat and the dog sat on the mat. " * 200
    raw, got = text.encode(), quality.Sizes(good, bad).features(text)
    plain = []
    for d in (good, bad):
        compress = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress
        plain.append(sum(len(compress(raw[k : k + quality.BLOCK])) - 9 for k in range(0, len(raw), quality.BLOCK)))
    assert got[0] == pytest.approx((plain[1] - plain[0]) / len(raw), abs=0.002) and got[0] > 0 and got[1] == pytest.approx(min(plain) / len(raw), abs=0.002)
    model = quality.CompressionClassifier(good, bad, tuple(0.1 * k for k in range(len(quality._design(np.zeros((1, 3)))[0]))))
    logit = float((quality._design(np.array([sizes.features(text)])) @ np.array(model.curve))[0])
    assert model.score_batch([text], sizes)[0] == pytest.approx(1 / (1 + np.exp(-logit)))


def test_whole_labelled_rows_up_to_the_bound(spark, monkeypatch):
    docs = documents(spark, [(k, f"{'good' if k % 2 else 'poor'} words {k} " * 500) for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "BYTES_PER_CLASS", 30_000)
    few = quality.train(docs, labels)
    monkeypatch.setattr(quality, "BYTES_PER_CLASS", 1 << 24)
    assert len(few.good) < len(quality.train(docs, labels).good)


def test_licences_of_repeated_and_null_keys(spark):
    rows = [(1, "a/f.py", "Released under the MIT License."), (1, "b/f.py", "Licensed under the Apache License, Version 2.0."), (1, "a/f.py", "Released under the MIT License."), (None, "c/f.py", "Released under the MIT License."), (None, "d/f.py", "words"), (None, None, None)]
    got = Counter((r["key"], r["path"], r["licence"]) for r in license_scan.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect())
    assert got == Counter({(1, "a/f.py", "MIT"): 2, (1, "b/f.py", "Apache-2.0"): 1, (None, "c/f.py", "MIT"): 1, (None, "d/f.py", "NOASSERTION"): 1, (None, None, "NOASSERTION"): 1})


def test_cosines_by_hand(spark):
    """The best cosine of every line against all templates, recomputed term by term."""
    named = license_scan.all_templates()
    idf, other, vectors = license_scan._vectors(named)
    lines = ["Licensed under the Apache License, Version 2.0.", "under the MIT License you may use it", "GNU General Public License version 3 or later", "SPDX-License-Identifier: ISC", "nothing alike"]
    files = spark.createDataFrame(list(enumerate(lines)), "key long, text string")
    got = {r["key"]: (r["licence"], r["cosine"]) for r in license_scan.header_matches(files, license_scan.template_table(spark)).where("unit = 0").collect()}
    for k, line in enumerate(lines):
        counts = Counter(re.findall(license_scan._TERM, line.lower()))
        own = {t: min(1 + np.log(n), license_scan.MOST_COUNT) * idf.get(t, 1.0 if t in license_scan._PROSE else other) for t, n in counts.items()}
        size = np.sqrt(sum(w * w for w in own.values()))
        best = []
        for (name, text), v in zip(named, vectors, strict=True):
            cosine = round(sum(w * v.get(t, 0) for t, w in own.items()) / size, 6)
            telling = sum(t in v and t not in license_scan._PROSE for t in own)
            if cosine >= license_scan.LEAST_COSINE and telling >= license_scan.LEAST_SHARED and len(text.split()) < license_scan.LONG:
                best.append((name == license_scan.RESERVED, -cosine, name))
        assert got.get(k) == ((min(best)[2], pytest.approx(-min(best)[1], abs=2e-6)) if best else None), line


def test_added_spans(spark):
    """Recall and precision of the spans that the votes add, over constructed sentences of each kind."""
    own = random.Random(21)
    first, last = ["Maria", "Thomas", "Jennifer", "Stefan", "Pierre", "Carmen"], ["Garcia", "Schmidt", "Johnson", "Moreau", "Becker", "Okonkwo", "Larsen"]
    digits = lambda n: "".join(own.choice("0123456789") for _ in range(n))
    rows, want, never = [], set(), set()
    for k in range(240):
        kind = ("name", "local_phone", "place", "prose")[k % 4]
        if kind == "name":
            value = f"{own.choice(first)} {own.choice(last)}"
            text = own.choice(["Please contact %s today.", "Signed, %s", "Dear %s, thank you", "The patient is %s."]) % value
        elif kind == "local_phone":
            value = f"({digits(3)}) {digits(3)}-{digits(4)}"
            text = own.choice(["Call %s now", "phone: %s", "my tel. %s please"]) % value
        elif kind == "place":
            value = f"{own.choice(['Victoria', 'George', 'Martin'])} {own.choice(['Street', 'Bridge', 'Station', 'University'])}"
            text = f"It lies near {value} in town, section {k}."
        else:
            value, text = "", "He saw mark after mark and no person at all, version 1.2."
        rows.append((k, text))
        if kind in ("name", "local_phone"):
            want.add((k, kind, text.index(value), text.index(value) + len(value)))
        elif kind == "place":
            never.add(k)
    got = {(r["doc_id"], m["kind"], m["start"], m["stop"]) for r in pii.detect(documents(spark, rows)).collect() for m in r["found"]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got), (len(got), len(want), len(got & want))
    assert not any(k in never for k, *_ in got)
