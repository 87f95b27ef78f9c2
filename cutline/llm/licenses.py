"""Licence scans by Dice coefficient over word bigrams (operator 3).

Every line, every paragraph and the whole text of a document are normalised (lower case,
letters and digits only) and compared to licence templates by the Dice coefficient over
their word bigrams, counted with repeats.  Two multisets of m and n bigrams can reach at
most 2 min(m, n) / (m + n), so only templates whose size allows the threshold are looked
at, and of these only the ones that share enough bigrams, by an inverted index.

Templates are a table (name, text) that callers may replace; the list below holds notices
in common use.  The templates are a fixed, small argument, so the scan is one pass over the
documents without a shuffle.

A segment is reported once, for its best template (ties: the first name); a paragraph or
text is not reported again where a smaller segment in it already matched the same licence.

Edge cases: null and empty texts have no segment; a template of fewer than two words is
refused; a null id is kept; repeated rows give repeated results; an empty table gives an
empty table; only id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cutline.llm.common import read, slices, strings, texts

# Notices by which texts commonly state their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_WORDS = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Matcher:
    """Templates by size and by bigram."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.names, self.sizes = [], []
        self.index: dict = defaultdict(list)
        for name, text in templates:
            words = normalised(text)
            if len(words) < 2:
                raise ValueError(f"template {name!r} has fewer than two words")
            k = len(self.names)
            self.names.append(name)
            self.sizes.append(len(words) - 1)
            for gram, n in Counter(zip(words, words[1:])).items():
                self.index[gram].append((k, n))
        # Dice >= t needs n t / (2 - t) <= m <= n (2 - t) / t
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = [(n * low, n * high) for n in self.sizes]
        self.least = min(a for a, _ in self.bounds)
        self.most = max(b for _, b in self.bounds)
        self.starts = {w for gram in self.index for w in gram}

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """(name, Dice) of the best template at or above the threshold."""
        m = len(words) - 1
        if not self.least - 1e-9 <= m <= self.most + 1e-9 or self.starts.isdisjoint(words):
            return None
        shared: dict = {}
        for gram, n in Counter(zip(words, words[1:])).items():
            for k, own in self.index.get(gram, ()):
                a, b = self.bounds[k]
                if a - 1e-9 <= m <= b + 1e-9:
                    shared[k] = shared.get(k, 0) + min(n, own)
        hits = [(-2 * s / (m + self.sizes[k]), self.names[k]) for k, s in shared.items()]
        hits = [h for h in hits if -h[0] >= self.threshold]
        return (min(hits)[1], -min(hits)[0]) if hits else None

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(name, start, end, Dice) of the matching segments of a text."""
        found: list[tuple[str, int, int, float]] = []

        def look(start, end, words):
            hit = self.best(words)
            if hit and not any(n == hit[0] and s >= start and e <= end for n, s, e, _ in found):
                found.append((hit[0], start, end, hit[1]))

        at = 0
        lines = []
        for line in text.split("\n"):
            # a line of a few characters or of very many cannot have a fitting size
            words = normalised(line) if len(line) > 2 * self.least else []
            lines.append((at, at + len(line), words, not line.strip()))
            look(at, at + len(line), words)
            at += len(line) + 1
        block: list = []
        for row in [*lines, (at, at, [], True)]:
            if row[3]:
                if len(block) > 1:
                    look(block[0][0], block[-1][1], self._joined(text, block))
                block = []
            else:
                block.append(row)
        rows = [r for r in lines if not r[3]]
        if len(rows) > 1:
            look(rows[0][0], rows[-1][1], self._joined(text, rows))
        return found

    def _joined(self, text: str, rows: list) -> list[str]:
        if sum(len(r[2]) for r in rows) - 1 > self.most:
            return []
        return [w for a, b, _, _ in rows for w in normalised(text[a:b])]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start_at, end_at, dice): matching segments, positions in code points, end exclusive."""
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        matcher = Matcher(templates, threshold)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                rows = [(i, *hit) for i, t in zip(ids, strings(part, "text")) for hit in matcher.scan(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                     pa.array([r[4] for r in rows], pa.float64())],
                    names=["doc_id", "license", "start_at", "end_at", "dice"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, license string, start_at long, end_at long, dice double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan}
_VALUES = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))

ORACLE = {"op3_license_scan": rf"""
    WITH templates(k, name, body) AS (VALUES {_VALUES}),
    split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM split),
    lines AS MATERIALIZED (
        SELECT *, coalesce(sum(length(line) + 1) OVER (
                   PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
               NOT regexp_matches(line, '\S') AS blank,
               regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS ws
        FROM raw),
    runs AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM lines),
    segments AS (
        SELECT doc_id, 1 AS size, s, s + length(line) AS e, ws FROM lines
        UNION ALL
        SELECT doc_id, 2, min(s), max(s + length(line)), flatten(list(ws ORDER BY ln)) FROM runs WHERE NOT blank
        GROUP BY doc_id, run HAVING count(*) > 1
        UNION ALL
        SELECT doc_id, 3, min(s), max(s + length(line)), flatten(list(ws ORDER BY ln)) FROM runs WHERE NOT blank
        GROUP BY doc_id HAVING count(*) > 1),
    fit AS MATERIALIZED (SELECT row_number() OVER () AS seg, * FROM segments WHERE len(ws) BETWEEN 2 AND 400),
    grams AS (SELECT seg, a || ' ' || b AS gram, count(*) AS n
              FROM (SELECT seg, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM fit) GROUP BY ALL),
    own AS (SELECT k, name, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS ws FROM templates),
    own_grams AS (SELECT k, name, size, a || ' ' || b AS gram, count(*) AS n
                  FROM (SELECT k, name, len(ws) - 1 AS size, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM own) GROUP BY ALL),
    scored AS (
        SELECT g.seg, o.name, 2 * sum(least(g.n, o.n))::DOUBLE / (len(any_value(f.ws)) - 1 + o.size) AS dice
        FROM grams g JOIN own_grams o USING (gram) JOIN fit f ON f.seg = g.seg GROUP BY g.seg, o.k, o.name, o.size),
    best AS MATERIALIZED (
        SELECT f.doc_id, f.size, f.s, f.e, name, dice
        FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY dice DESC, name) AS rn FROM scored WHERE dice >= 0.8) b
        JOIN fit f USING (seg) WHERE rn = 1)
    SELECT doc_id, name AS license, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, dice
    FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM best x WHERE x.doc_id = b.doc_id AND x.name = b.name AND x.size < b.size AND x.s >= b.s AND x.e <= b.e)"""}
