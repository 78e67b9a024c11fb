"""License notices and texts in documents, with SQL functions only.

A text is lower-cased and reduced to one sequence of words of letters and digits, so that line breaks, punctuation
and comment signs don't matter. A template's bag of word pairs is compared with windows of that sequence by the Dice
coefficient, 2 * common / (pairs of one + pairs of the other). A window that begins or ends with a pair the template
hasn't only gains by losing it, so windows from one common pair to another are all that is needed. Prunings that lose
nothing: a text needs one of the words without which too few pairs are left; a template needs as many common pairs
as its size bound asks for, and as many within the longest window that can still reach the threshold.
Everything happens within a row; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import common

THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"

# Notices as the licenses or their publishers word them, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms "
                         "of the GNU General Public License as published by the Free Software Foundation, either "
                         "version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
    # MIT and ISC whole from the permission on, the clauses of BSD without its disclaimer, the long notice of Apache.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
            "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
            "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
            "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain "
                     "the above copyright notice, this list of conditions and the following disclaimer. 2. "
                     "Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided "
                     "with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain "
                     "the above copyright notice, this list of conditions and the following disclaimer. 2. "
                     "Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided "
                     "with the distribution. 3. Neither the name of the copyright holder nor the names of its "
                     "contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
]
# Template words that ordinary prose is full of.
PLAIN = set("a all and any are as at by can for in into is it law may met not of or that the this to under use with "
            "without you your 0 1 2 3 4".split())


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def pairs_of(text: str) -> list[str]:
    words = words_of(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def pair_bounds(pairs: int, threshold: float) -> tuple[int, int]:
    """Fewest and most pairs of a window whose coefficient with ``pairs`` template pairs can reach the threshold."""
    return math.ceil(pairs * threshold / (2 - threshold) - 1e-9), math.floor(pairs * (2 - threshold) / threshold + 1e-9)


def telling_words(templates, threshold: float) -> list[str]:
    """Words of which a text must have one to reach any template: of each template its longest words outside
    PLAIN, until the pairs without them are too few."""
    telling: set[str] = set()
    for name, text in templates:
        pairs = [set(p.split()) for p in pairs_of(text)]
        need = threshold * (len(pairs) + pair_bounds(len(pairs), threshold)[0]) / 2
        for word in sorted(set(words_of(text)) - PLAIN, key=lambda w: (-len(w), w)):
            if len(pairs) < need:
                break
            telling.add(word)
            pairs = [p for p in pairs if word not in p]
        if len(pairs) >= need:
            raise ValueError(f"too few telling words in a template of {name}")
    return sorted(telling)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(hits: Column, t: Column, threshold: float) -> Column:
    """For each pair (at, pair) that a template has too, its best window from there on, if it reaches the threshold."""

    def times(pair: Column) -> Column:
        return F.get(F.filter(t["several"], lambda p: p["pair"] == pair), 0)["n"]

    def lasting(own: Column) -> Column:
        # A repeated pair counts in windows from after the place that has used up the template's: (i, at, gone).
        def one(h: Column, i: Column) -> Column:
            before = F.filter(F.slice(own, F.greatest(F.lit(1), i + 1 - t["high"]), F.least(i, t["high"])),
                              lambda b: b["pair"] == h["pair"])
            gone = F.get(before, F.size(before) - F.coalesce(times(h["pair"]), F.lit(1)))["at"]
            return F.struct(i.alias("i"), h["at"].alias("at"), F.coalesce(gone, F.lit(-1)).alias("gone"))
        return F.transform(own, one)

    def best(start: Column, held: Column) -> Column:
        def step(state: Column, h: Column) -> Column:
            count = state["common"] + (h["gone"] < start["at"]).cast("int")
            words = h["at"] - start["at"] + 2
            dice = 2.0 * count / (t["size"] + words - 1)
            return F.struct(count.alias("common"), F.greatest(state["dice"], dice).alias("dice"),
                            F.when(dice > state["dice"], words).otherwise(state["words"]).alias("words"))
        none = F.struct(F.lit(0).alias("common"), F.lit(0.0).alias("dice"), F.lit(0).alias("words"))
        return F.aggregate(F.slice(held, start["i"] + 1, t["high"]), none, step, lambda state: F.struct(
            start["at"].alias("start"), t["nth"].alias("nth"), state["dice"].alias("dice"),
            state["words"].alias("words"), t["name"].alias("license")))

    def dense(held: Column) -> Column:
        return F.filter(held, lambda h: F.get(held, h["i"] + t["low"] - 1)["at"] - h["at"] < t["high"])

    own = F.filter(hits, lambda h: F.array_contains(t["pairs"], h["pair"]))
    found = _let(own, lambda own: F.when(F.size(own) >= t["low"], _let(lasting(own), lambda held: F.filter(
        F.transform(dense(held), lambda start: best(start, held)), lambda m: m["dice"] >= threshold))))
    return F.coalesce(found, F.array().cast(MATCHES))


MATCHES = "array<struct<start:int,nth:int,dice:double,words:int,license:string>>"


def _better(a: Column, b: Column) -> Column:
    """Whether match a goes before match b: higher coefficient, more words, earlier, earlier template."""
    return (a["dice"] > b["dice"]) | (a["dice"] == b["dice"]) & (
        (a["words"] > b["words"]) | (a["words"] == b["words"]) & (
            (a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["nth"] < b["nth"])))


def _apart(matches: Column) -> Column:
    """From left to right, the better of a match and the next one that shares a word with it."""
    def step(state: Column, m: Column) -> Column:
        now = state["now"]
        clear = now.isNull() | (m["start"] >= now["start"] + now["words"])
        return F.struct(
            F.when(clear & now.isNotNull(), F.concat(state["kept"], F.array(now))).otherwise(state["kept"]).alias("kept"),
            F.when(clear | _better(m, now), m).otherwise(now).alias("now"))
    none = F.struct(F.array().cast(MATCHES).alias("kept"), F.lit(None).cast(MATCHES[6:-1]).alias("now"))
    return F.aggregate(F.array_sort(matches), none, step, lambda state: F.when(
        state["now"].isNull(), state["kept"]).otherwise(F.concat(state["kept"], F.array(state["now"]))))


def text_matches(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Array of (start, nth, dice, words, license): the separate places of a text that reach a template.

    start counts words from 0, words is the length of the place, nth the template. Of a template's windows from one
    word on, the one of highest coefficient counts, the shortest of equal ones; of places with common words, in order
    of start and template, the better of each two neighbours stays (``_better``).
    """
    told = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(telling_words(templates, threshold))})(?![\p{{L}}\p{{N}}])"
    entries, every = [], set()
    for nth, (name, notice) in enumerate(templates):
        bag = Counter(pairs_of(notice))
        low, high = pair_bounds(sum(bag.values()), threshold)
        several = [F.struct(F.lit(p).alias("pair"), F.lit(n).alias("n")) for p, n in sorted(bag.items()) if n > 1]
        entries.append(F.struct(
            F.lit(nth).alias("nth"), F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"),
            F.lit(sum(bag.values())).alias("size"), F.lit(sorted(bag)).alias("pairs"),
            F.array(*several).cast("array<struct<pair:string,n:int>>").alias("several")))
        every |= set(bag)

    def common_pairs(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                           lambda a, b: F.concat_ws(" ", a, b))
        return F.array_compact(F.transform(pairs, lambda p, i: F.when(p.isin(sorted(every)), F.struct(
            i.alias("at"), p.alias("pair")))))

    def matches(hits: Column) -> Column:
        return F.flatten(F.transform(F.array(*entries), lambda t: _windows(hits, t, threshold)))

    words = lambda lower: F.split(F.trim(F.regexp_replace(lower, NOT_WORD, " ")), " ")
    found = _let(F.lower(text), lambda lower: F.when(lower.rlike(told), _let(
        words(lower), lambda ws: _let(common_pairs(ws), lambda hits: _apart(matches(hits))))))
    return F.coalesce(found, F.array().cast(MATCHES))


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with mk_matches (see ``text_matches``), license, dice, license_start, license_words, license_places
    and licenses.

    license, dice, license_start and license_words are those of the best match: highest coefficient, then most words,
    then first; null without one. license_places counts matches, licenses lists their names, sorted, without
    repeats. Null and empty texts have none. Other columns pass through; where they have the name of an added one,
    that gets underscores.
    """
    named = [f"mk_{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(named[docs.columns.index(text_col)]), F.lit(""))
    found = docs.toDF(*named).withColumn("mk_matches", text_matches(text, templates, threshold))
    best = F.aggregate("mk_matches", F.get("mk_matches", 0), lambda a, m: F.when(_better(m, a), m).otherwise(a))
    added = {"mk_matches": F.col("mk_matches"), "license": best["license"], "dice": best["dice"],
             "license_start": best["start"], "license_words": best["words"], "license_places": F.size("mk_matches"),
             "licenses": F.array_join(F.array_sort(F.array_distinct(F.transform(
                 "mk_matches", lambda m: m["license"]))), ",")}
    return found.select(*named, *added.values()).toDF(
        *docs.columns, *[common.unused(docs.columns, c) for c in added])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("text", "mk_matches")


def sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(n)}, [{', '.join(map(quote, pairs_of(t)))}])"
                       for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH RECURSIVE templates(nth, license, pairs) AS (VALUES {values}),
bags AS (SELECT nth, pair, count(*) AS n FROM (SELECT nth, unnest(pairs) AS pair FROM templates) GROUP BY ALL),
worded AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM documents WHERE text IS NOT NULL),
paired AS (
  SELECT doc_id, i - 1 AS place, w[i] || ' ' || w[i + 1] AS pair
  FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM worded)),
hits AS (
  SELECT doc_id, nth, place, pair, n, row_number() OVER (PARTITION BY doc_id, nth, pair ORDER BY place) AS r
  FROM paired JOIN bags USING (pair)
  QUALIFY count(*) OVER (PARTITION BY doc_id, nth) >=
          {THRESHOLD} / (2 - {THRESHOLD}) * (SELECT len(pairs) FROM templates t WHERE t.nth = bags.nth) - 1e-9),
held AS (
  SELECT h.doc_id, h.nth, h.place, coalesce(p.place, -1) AS gone
  FROM hits h LEFT JOIN hits p
    ON p.doc_id = h.doc_id AND p.nth = h.nth AND p.pair = h.pair AND p.r = h.r - h.n),
counted AS (
  SELECT a.doc_id, a.nth, t.license, len(t.pairs) AS size, a.place AS start, b.place - a.place + 2 AS words,
         count(*) FILTER (b.gone < a.place) OVER (PARTITION BY a.doc_id, a.nth, a.place ORDER BY b.place) AS common
  FROM held a JOIN templates t USING (nth) JOIN held b
    ON b.doc_id = a.doc_id AND b.nth = a.nth
   AND b.place BETWEEN a.place AND a.place + len(t.pairs) * (2 - {THRESHOLD}) / {THRESHOLD}),
reached AS (
  SELECT * FROM (SELECT doc_id, nth, license, start, words, 2.0 * common / (size + words - 1) AS dice FROM counted)
  WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, nth, start ORDER BY dice DESC, words) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, nth) AS k FROM reached),
sweep AS (
  SELECT doc_id, k, nth, license, start, words, dice, true AS fresh FROM numbered WHERE k = 1
  UNION ALL
  SELECT doc_id, s.k + 1, if(taken, m.nth, s.nth), if(taken, m.license, s.license), if(taken, m.start, s.start),
         if(taken, m.words, s.words), if(taken, m.dice, s.dice), clear
  FROM (SELECT s, m, m.doc_id, m.start >= s.start + s.words AS clear,
               clear OR (m.dice, m.words, -m.start, -m.nth) > (s.dice, s.words, -s.start, -s.nth) AS taken
        FROM sweep s JOIN numbered m ON m.doc_id = s.doc_id AND m.k = s.k + 1)),
kept AS (
  SELECT * FROM sweep QUALIFY coalesce(lead(fresh) OVER (PARTITION BY doc_id ORDER BY k), true)),
tops AS (
  SELECT doc_id, count(*) AS places, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
         first(kept ORDER BY dice DESC, words DESC, start, nth) AS top
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, top.license AS license, CAST(top.dice AS DOUBLE) AS dice, CAST(top.start AS INTEGER) AS license_start,
       CAST(top.words AS INTEGER) AS license_words, CAST(coalesce(places, 0) AS INTEGER) AS license_places,
       coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN tops USING (doc_id)
"""
