import re
import textwrap
from collections import Counter

import pytest

from panelkit.llm import licenses


def windows(text, nth):
    """Of the windows of a text from each word on, the best one against a template, by counting every window."""
    words = licenses.words_of(text)
    own = Counter(licenses.pairs_of(licenses.TEMPLATES[nth][1]))
    size = sum(own.values())
    telling = [i for i, p in enumerate(zip(words, words[1:])) if " ".join(p) in own]
    for start in telling:
        best = (0.0,)
        for stop in range(start + 1, min(len(words), start + 2 * size + 1)):
            seen = Counter(f"{a} {b}" for a, b in zip(words[start:stop], words[start + 1:stop + 1]))
            best = max(best, (2 * sum((own & seen).values()) / (size + stop - start), -(stop - start + 1)))
        if best[0] >= licenses.THRESHOLD:
            yield best[0], -best[1], -start, -nth


def brute(text):
    """(license, dice, start, words, places, names) from all windows of a text."""
    found = sorted((w for nth in range(len(licenses.TEMPLATES)) for w in windows(text or "", nth)),
                   key=lambda w: (-w[2], -w[3]))
    kept = []
    for w in found:
        if kept and -w[2] < kept[-1][1] - kept[-1][2]:
            kept[-1] = max(kept[-1], w)
        else:
            kept.append(w)
    names = ",".join(sorted({licenses.TEMPLATES[-w[3]][0] for w in kept}))
    if not kept:
        return None, None, None, None, 0, names
    top = max(kept)
    return licenses.TEMPLATES[-top[3]][0], top[0], -top[2], top[1], len(kept), names


BSD = next(t for name, t in licenses.TEMPLATES if name == "BSD-3-Clause" and len(t) > 500)
TEXTS = [t for _, t in licenses.TEMPLATES] + [
    "RELEASED   under-the MIT... license", "prose\nLicensed under the Apache License, Version 2.0.\nmore", "License",
    "license license license license license", "Licensed under the MIT License. Licensed under the MIT License.",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", "sublicensed under the mit",
    "This work is licensed under the GNU General Public License, version", "_Released_ under the MIT License éé",
    "This work is licensed under the GNU Affero General Public License", "under the the mit under the", "copyright\n" * 500,
    "the software the software the software is provided as is " * 30, "Licensed under the ISC License.\n" * 40,
    "Foo is released under the MIT License; see the LICENSE file.", "Copyright (c) 2020 Acme Inc. All rights reserved.",
    textwrap.fill(BSD, 60, subsequent_indent=" * "), BSD.replace("holder", "owner or keeper") + " more"]


def test_against_brute_force(spark, odd_docs, texts):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(TEXTS + texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mk_line string, license_score double")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.license, r.dice, r.license_start, r.license_words, r.license_places, r.licenses) == brute(r.text), r.text
    assert licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(odd_docs.limit(0)).count() == 0


def test_wrapped_and_embedded_notices_are_found(spark):
    lines = ["Redistribution and use in source and binary forms, with or", "// without modification, are permitted provided",
             "// that the following conditions are met:"]
    rows = [("\n".join(lines), "BSD-2-Clause"), (TEXTS[-4], "MIT"), (TEXTS[-3], "proprietary"), (TEXTS[-2], "BSD-3-Clause"),
            ("The software is licensed to nobody, under the table.", None)]
    for r in licenses.scan(spark.createDataFrame(rows, "text string, expected string")).collect():
        assert r.license == r.expected, r.text


def test_sql_gives_the_same_rows(spark, texts):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t) for i, t in enumerate(TEXTS + texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    wanted = sorted(con.execute(licenses.sql()).fetchall())
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).drop("text", "mk_matches").collect()
    assert sorted(tuple(r) for r in got) == wanted


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_prunings_lose_nothing(threshold):
    try:
        telling = set(licenses.telling_words(licenses.TEMPLATES, threshold))
    except ValueError:
        telling = None
    for _, notice in licenses.TEMPLATES:
        pairs = licenses.pairs_of(notice)
        low, high = licenses.pair_bounds(len(pairs), threshold)
        for n in (low - 1, high + 1):
            assert 2 * min(n, len(pairs)) / (n + len(pairs)) < threshold
        if telling is not None:
            rest = sum(not set(p.split()) & telling for p in pairs)
            assert 2 * rest / (len(pairs) + low) < threshold


def test_lowest_words_agree_with_the_query_pattern():
    assert re.sub(r"[\W_]+", " ", "CC BY-NC 4.0".lower()).split() == licenses.words_of("CC BY-NC 4.0")


def test_clashing_names_come_back(spark):
    rows = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0.", "own", 0.5, 7)],
                                 "doc_id long, text string, license string, dice double, mk_matches int")
    got = licenses.scan(rows).first()
    assert (got.license, got.dice, got.mk_matches) == ("own", 0.5, 7) and got.license_ and got.dice_ >= licenses.THRESHOLD
