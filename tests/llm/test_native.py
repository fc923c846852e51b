"""Native operators against plain Python."""

import re
from collections import Counter

from gridloom.llm import license_scan, quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


EDGES = [None, "", " \n\t", "a", "a b c a b c", "a b c\r\na b c\x0bx", "é 中 \U0001f642 é 中 \U0001f642 é", "x\n\nx\nx \nx", "a a a a a", "word " * 3000 + "end.", "$$ ** | <>", "b a b a b a b"]


def rows_of(spark, texts):
    return spark.createDataFrame([(None if i == 2 else i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")


def test_quality_counts(spark):
    texts = EDGES + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = quality_rules.assess(rows_of(spark, texts)).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        r = by_id[None if i == 2 else i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text), text
        assert not (r.kept and r.base_failed)


def test_quality_lines(spark):
    good = " ".join(f"Sentence {i} has quite a few words{i} and ends well{i} enough." for i in range(12))
    junk = "Home | About | Contact | Help | News"
    texts = [good, f"{good}\n{junk}\nAll rights reserved.", "\n".join(["One good line stands here."] + [f"{junk} {i}" for i in range(40)]), good + "\n" + "w%%% x### y*** " * 80]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).filter("kept or not kept").collect()}
    assert [got[i].kept for i in range(4)] == [True, True, False, False]
    assert got[1].cleaned == good and got[1].n_bad_lines == 2


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.assess(docs).filter("n_words >= 50").join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    kept = {r.quality: r.n for r in quality_rules.assess(docs).filter("kept").join(labels, "doc_id").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    all_rows = {r.quality: r[1] for r in judged}
    assert kept.get(0, 0) <= 0.05 * all_rows[0] and kept[1] >= 0.99 * all_rows[1]


def plain_licenses(text):
    low = (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    norm = "".join(f" {w} " for w in words)
    hits = []
    for s in license_scan.signatures():
        for m in re.finditer(s.regex, norm):
            hits.append((norm[: m.start()].count(" ") // 2, norm[: m.end()].count(" ") // 2, s))
    inside = lambda h, o: o[0] <= h[0] and o[1] >= h[1] and o[2] is not h[2] and ((o[:2] == h[:2] and o[2].order < h[2].order) or (o[1] - o[0] > h[1] - h[0] and o[2].priority <= h[2].priority))
    left = [h for h in hits if not any(inside(h, o) for o in hits)]
    base = {label for _, label in places}
    score = max([h[2].confidence for h in left], default=0.5 if base else 0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[2].label for h in left})), score


def test_licenses(spark):
    extra = [
        "MIT License",
        "mit-license MIT\tLICENSE x apache license",
        "Apache License general public license GNU General Public License version 3",
        "SPDX-License-Identifier: MIT",
        "Released under the terms of the GNU LGPL 2.1",
        "CC BY-NC 4.0 cc0",
        "all rights  reserved, Licensed under the Mozilla Public License 2.0!",
        "licencé İMIT license K",
        "--- ...",
        "permit license mitlicense",
        "available under zlib libpng; 3 clause bsd licence",
    ]
    texts = EDGES + extra + [" ".join(extra) * 3] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = license_scan.scan(rows_of(spark, texts)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts) and len(license_scan.signatures()) > 200
    for i, text in enumerate(texts):
        r = by_id[None if i == 2 else i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_licenses(text), text


def test_license_names_without_keyword(spark):
    """Names that do not hold their family's keyword as words of its own."""
    texts = [
        "licensed under the GNU GPLv3 license",
        "gplv2 only",
        "LGPLv3",
        "Licensed under the AGPLv3.",
        "GNU General Public Licence",
        "the GNU Library General Public License",
        "ASL 2.0 license",
        "Expat license",
        "released under the PSF license",
        "BSL 1.0 license",
        "Internet Systems Consortium license",
    ]
    got = {r.doc_id: r for r in license_scan.scan(rows_of(spark, [*texts[:2], None, *texts[2:]])).collect()}
    labels = ["gpl", "gpl", "lgpl", "agpl", "gpl", "gpl,lgpl", "apache", "mit", "python", "boost", "isc"]
    for i, (text, label) in enumerate(zip(texts, labels)):
        r = got[i if i < 2 else i + 1]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_licenses(text), text
        assert r.labels == label and r.score >= 0.6


def test_license_gates():
    rules = license_scan.signatures()
    assert {license_scan.held_text(x) for x in ("gplv[123]", "~gnu lgpl", "[234] clause bsd", "cc by [1234] [05]")} == {" gplv", " lgpl ", "  clause  bsd ", " cc  by  "}
    words = license_scan.gate_words(rules)
    for s in rules:
        least = re.sub(r"\(\?:[^)]*\)\?", "", s.regex)
        least = re.sub(r"\[(.)[^]]*\]", r"\1", least)
        assert re.fullmatch(s.regex, least) and s.name in least and any(w in least for w in words)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality_rules.assess(none).count() == license_scan.scan(none).count() == 0


def test_licenses_in_long_texts(spark):
    """Many detections in one text take seconds: the cost is nearly linear."""
    import time

    n = 16_000
    texts = ["mit license " * n, "licensed under the mit license " * n, " ".join(["released under the apache license gpl"] * n)]
    began = time.time()
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert time.time() - began < 60
    assert (got[0].n_base, got[0].first_word, got[0].last_word, len(got[0].detections)) == (n, 0, 2 * n - 2, n)
    assert got[1].n_base == n and len(got[1].detections) == n and got[1].score == 0.95
    assert got[2].labels == "apache,gpl" and len(got[2].detections) == 2 * n


def test_license_identifiers(spark):
    """Versions, "or later", exceptions, SPDX expressions and license texts' own sentences."""
    texts = {
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": ("apache,mit", ""),
        "SPDX-License-Identifier: GPL-2.0-or-later": ("gpl", "GPL-2.0-or-later"),
        "SPDX-License-Identifier: BSD-3-Clause AND CC0-1.0": ("bsd,cc0", ""),
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": ("", ""),
        "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": ("gpl", "GPL-2.0-or-later"),
        "under the GPL v2 with the Classpath Exception": ("gpl", "GPL-2.0-only WITH Classpath-exception-2.0"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software')": ("mit", "MIT"),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": ("bsd", "BSD-2-Clause"),
        "Neither the name of the Foo Institute nor the names of its contributors may be used to endorse or promote products derived from this software": ("bsd", "BSD-3-Clause"),
        "https://creativecommons.org/licenses/by-sa/4.0/": ("cc-by-sa", "CC-BY-SA-4.0"),
        "This is free and unencumbered software released into the public domain.": ("unlicense", "Unlicense"),
    }
    got = {r.doc_id: r for r in license_scan.scan(rows_of(spark, [*list(texts)[:2], None, *list(texts)[2:]])).collect()}
    for i, (text, want) in enumerate(texts.items()):
        r = got[i if i < 2 else i + 1]
        assert (r.labels, r.identifiers) == want, text
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_licenses(text), text


def test_quality_rule_edges(spark):
    """The boilerplate length's edge, menu lines, sentence ends, and limits that are met exactly."""
    line = "We use cookies on this page and on others. "
    cases = {line.strip() + "x" * (160 - len(line.strip()) - 1) + ".": False, line.strip() + "x" * (161 - len(line.strip()) - 1) + ".": True, "Home: about us": False, "It ends here:": True, "Dr. Who": True, "He said to all of them there: “Go!”": True, "no end": False, "": True}
    got = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", quality_rules.line_ok(quality_rules.F.col("x")).alias("ok")).collect()
    assert {list(cases)[r.i]: r.ok for r in got} == cases
    text = "\n".join(["Ten good words stand in this line, and it ends." ] * 1 + ["bad line without an end of fifty characters, or so"])
    half = quality_rules.assess(spark.createDataFrame([(1, text)], "doc_id int, text string"), min_words=1, max_loss_pct=100).first()
    assert half.n_bad_lines == 1 and half.cleaned == text.split("\n")[0]
    pct = 100 * half.lost_chars // sum(len(x) for x in text.split("\n"))
    kept = lambda p: quality_rules.assess(spark.createDataFrame([(1, text)], "doc_id int, text string"), min_words=1, max_loss_pct=p).filter("kept").count()
    assert kept(pct + 1) == 1 and kept(pct) == 0


def test_quality_repeats_in_very_long_texts(spark):
    """Over 2**20 words, with few and with very many repeats."""
    many = " ".join(f"{i % 700_000}" for i in range(1_100_000))
    few = " ".join(map(str, range(1_060_000))) + " 5 6 7 8"
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame([(1, many), (2, few)], "doc_id int, text string")).select("doc_id", "n_words", "n_repeat_words").collect()}
    assert (got[1].n_words, got[1].n_repeat_words) == (1_100_000, 800_000) and got[2].n_repeat_words == 8
