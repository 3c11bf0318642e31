"""Licence scans by Dice coefficient over word bigrams; DataFrame functions only.

Text is normalised (lower case, runs of other characters than letters and digits are one
blank), and every window of words, wherever it stands, is compared with every licence template.
Line breaks play no part.  The coefficient is that of the bags of word bigrams: with ``n`` bigrams
in the window, ``b`` in the template and ``c`` shared, repeats counted, it is ``2 c / (n + b)``.

What bounds the work, none of which loses a match with a coefficient of at least ``least``:

* size: ``n`` is at most ``b (2 - least) / least``, so a window is no longer than one and a half templates;
* ends: the best window begins and ends with a bigram of the template, as any other gets
  better by leaving its end out;
* shares: ``c`` is at least ``need = b least / (2 - least)``, so only places with that many of the template's
  bigrams within the largest size begin a window;
* cues: a few words stand in all but fewer than ``need`` of each template's bigrams, so a text
  without any of them has no match, which is seen before it is normalised.

A template is reported once for each row, with its best window: the highest coefficient,
then the first and shortest window.

Texts are cut into overlapping blocks of words, so no row grows with the square of a text, and
windows are built only where enough bigrams are.  The only shuffle is the best window of each row and
licence, summed before it.

Edge cases: null and empty texts match nothing; a text that is a licence alone is one window;
rows that repeat an id have matches of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: What rounding may take from a bound.
SLACK = 1e-9
#: Words whose windows a row of the plan holds.
BLOCK = 512

#: Notices by which public licences are named in files: fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def needed(b: int, least: float) -> int:
    """The bigrams that a window with the coefficient ``least`` shares at least."""
    return max(1, math.ceil(b * least / (2 - least) - SLACK))


def largest(b: int, least: float) -> int:
    """The bigrams that a window with the coefficient ``least`` has at most."""
    return math.floor(b * (2 - least) / least + SLACK)


def cue_words(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words of which any matching window has one: of each template fewer than ``needed`` bigrams
    have none of them.  Long words are taken first, as fewer other texts hold them."""
    open_pairs = {k: [p.split() for p in bigrams_of(t)] for k, t in templates.items()}
    short = {k: len(p) - needed(len(p), least) + 1 for k, p in open_pairs.items()}
    found: list[str] = []
    while any(n > 0 for n in short.values()):
        worth: Counter = Counter()
        for k, pairs in open_pairs.items():
            for w, n in Counter(w for p in pairs for w in set(p)).items():
                worth[w] += min(n, max(0, short[k])) * min(len(w), 9) ** 3
        best = max(sorted(worth), key=worth.__getitem__)
        found.append(best)
        for k, pairs in open_pairs.items():
            left = [p for p in pairs if best not in p]
            short[k] -= len(pairs) - len(left)
            open_pairs[k] = left
    return sorted(found, key=len, reverse=True)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-z\x{80}-\x{10ffff}]+", " "))


def _hits(grams: list[str]) -> Column:
    """The ``pairs`` that are among a template's bigrams, with the bigram's number."""
    number = F.array(*map(F.lit, grams))
    mine = F.filter("pairs", lambda p: p["s"].isin(grams))
    return F.transform(mine, lambda p: F.struct(p["i"].alias("i"), (F.array_position(number, p["s"]).cast("int") - 1).alias("g")))


def _starts(hits: Column, b: int, least: float) -> Column:
    """Places in ``hits`` from which enough of them lie within the largest size."""
    need, most = needed(b, least), largest(b, least)
    places = F.sequence(F.lit(1), F.size(hits) - need + 1)
    near = F.filter(places, lambda i: F.get(hits, i + need - 2)["i"] - F.get(hits, i - 1)["i"] < most)
    inside = F.filter(near, lambda i: F.get(hits, i - 1)["i"] < BLOCK)
    return F.when(F.size(hits) >= need, inside).otherwise(F.array().cast("array<int>"))


def _best(hits: Column, caps: Column, b: Column, most: Column) -> Column:
    """The best window that begins with the first of ``hits``: ``dice, n`` (its bigrams)."""
    first = F.get(hits, 0)["i"]
    state = F.struct(F.lit(0).alias("c"), F.array().cast("array<int>").alias("seen"), F.lit(0.0).alias("dice"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        n = x["i"] - first + 1
        again = F.size(F.filter(acc["seen"], lambda g: g == x["g"]))
        c = acc["c"] + (again < F.get(caps, x["g"])).cast("int")
        dice = (2 * c).cast("double") / (n + b)
        better = dice > acc["dice"]
        return F.struct(
            c.alias("c"), F.concat(acc["seen"], F.array(x["g"])).alias("seen"),
            F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, n).otherwise(acc["n"]).alias("n"),
        )

    inside = F.filter(hits, lambda x: x["i"] - first < most)
    return F.aggregate(inside, state, step, lambda acc: F.struct(acc["dice"].alias("dice"), acc["n"].alias("n")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id, license, dice, first_word, n_words``; words are those of the normalised text, from 0."""
    templates = templates or TEMPLATES
    bags = {k: Counter(bigrams_of(t)) for k, t in templates.items()}
    names, sizes = list(bags), [bag.total() for bag in bags.values()]
    reach = max(largest(b, least) for b in sizes)
    has_cue = reduce(or_, (F.contains(F.col("low"), F.lit(w)) for w in cue_words(templates, least)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.lower(F.col("text").cast("string")).alias("low"))
    rows = rows.where(has_cue).select("doc_id", "row", F.filter(F.split(normal(F.col("low")), " "), lambda w: w != "").alias("words"))
    rows = rows.where(F.size("words") >= 2)
    # A block holds the words of the windows that begin in it.
    at = F.sequence(F.lit(0), F.floor((F.size("words") - 2) / F.lit(BLOCK)).cast("int"))
    blocks = F.transform(at, lambda k: F.struct(k.alias("k"), F.slice("words", k * BLOCK + 1, F.lit(BLOCK + reach)).alias("words")))
    rows = rows.select("doc_id", "row", F.explode(blocks).alias("block")).select("doc_id", "row", "block.k", "block.words")
    pairs = F.transform("words", lambda w, i: F.struct(i.alias("i"), F.concat_ws(" ", w, F.get("words", i + 1)).alias("s")))
    wanted = sorted(set().union(*bags.values()))
    rows = rows.select("doc_id", "row", "k", F.filter(pairs, lambda p: p["s"].isin(wanted)).alias("pairs"))
    rows = rows.where(F.size("pairs") >= min(needed(b, least) for b in sizes))
    # Each template's bigrams by number, where its windows begin, and how often each bigram counts.
    found = [F.struct(F.lit(t).alias("t"), _hits(sorted(bags[name])).alias("hits")) for t, name in enumerate(names)]
    rows = rows.select("doc_id", "row", "k", F.explode(F.array(*found)).alias("f")).select("doc_id", "row", "k", "f.t", "f.hits")
    start = reduce(lambda old, t: F.when(F.col("t") == t, _starts(F.col("hits"), sizes[t], least)).otherwise(old), range(len(names)), F.array().cast("array<int>"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("t"))
    rows = rows.select("doc_id", "row", "k", "t", "hits", F.explode(start).alias("from"))
    ahead = F.slice("hits", F.col("from"), F.lit(reach))
    caps = F.get(F.array(*(F.array(*(F.lit(bag[g]) for g in sorted(bag))) for bag in bags.values())), F.col("t"))
    rows = rows.select(
        "doc_id", "row", "t", (F.col("k").cast("long") * BLOCK + F.get("hits", F.col("from") - 1)["i"]).alias("first_word"),
        _best(ahead, caps, of(sizes), of([largest(b, least) for b in sizes])).alias("w"),
    ).where(F.col("w.dice") >= least)
    best = F.max(F.struct(F.col("w.dice").alias("dice"), (-F.col("first_word")).alias("a"), (-F.col("w.n")).alias("b")))
    rows = rows.groupBy("row", "doc_id", "t").agg(best.alias("best"))
    return rows.select("doc_id", of(names).alias("license"), "best.dice", (-F.col("best.a")).alias("first_word"), (1 - F.col("best.b")).cast("long").alias("n_words"))


def brute(text: str | None, templates: dict[str, str] | None = None, least: float = LEAST) -> dict[str, tuple]:
    """License to (dice, first_word, n_words) by comparing every window with every template."""
    pairs = bigrams_of(text or "")
    out: dict[str, tuple] = {}
    for name, t in (templates or TEMPLATES).items():
        bag = Counter(bigrams_of(t))
        for i in range(len(pairs) if bag.keys() & set(pairs) else 0):
            held, c = Counter(), 0
            for j in range(i, min(len(pairs), i + 2 * bag.total())):
                held[pairs[j]] += 1
                c += held[pairs[j]] <= bag[pairs[j]]
                if (dice := 2 * c / (j - i + 1 + bag.total())) >= least and (name not in out or (dice, -i, -(j - i + 2)) > out[name]):
                    out[name] = (dice, -i, -(j - i + 2))
    return {k: (d, -i, -n) for k, (d, i, n) in out.items()}


def sql(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """The same scan in DuckDB's SQL: every window between two bigrams of a template."""
    bags = {k: Counter(bigrams_of(t)) for k, t in (templates or TEMPLATES).items()}
    values = ", ".join(f"('{k}', {g!r}, {n}, {bag.total()})" for k, bag in bags.items() for g, n in sorted(bag.items()))
    return rf"""
WITH templates(license, gram, cap, b) AS (VALUES {values}),
w AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM documents
), grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)
), hits AS (
  SELECT doc_id, license, i, gram, cap, b FROM grams JOIN templates USING (gram)
), windows AS (
  SELECT s.doc_id, s.license, s.b, s.i AS a, e.i AS z
  FROM hits s JOIN hits e ON e.doc_id = s.doc_id AND e.license = s.license AND e.i BETWEEN s.i AND s.i + 2 * s.b
), shared AS (
  SELECT x.doc_id, x.license, x.b, a, z, least(count(*), any_value(h.cap)) AS n
  FROM windows x JOIN hits h ON h.doc_id = x.doc_id AND h.license = x.license AND h.i BETWEEN a AND z
  GROUP BY x.doc_id, x.license, x.b, a, z, h.gram
), scored AS (
  SELECT doc_id, license, a, z, (2 * sum(n))::DOUBLE / (z - a + 1 + b) AS dice FROM shared GROUP BY doc_id, license, b, a, z
)
SELECT doc_id, license, dice, (a - 1)::BIGINT AS first_word, (z - a + 2)::BIGINT AS n_words FROM scored WHERE dice >= {least}::DOUBLE
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, a, z) = 1
"""
