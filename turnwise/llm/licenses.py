"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of letters and digits in lower case, shingles are five words. For a template of n
shingles, windows of 2n shingles start at every n-th, so that each passage as long as the template lies
within one. A window that holds 0.8 of a template has a similarity of 0.36 to it at least; with BANDS
bands of one minimum each they then fail to collide with a chance of 5e-10. Windows that collide are
verified by the share of the template's shingles that they hold.

A band's key is its least hash, which belongs to one shingle. So windows need no keys of their own: a
text's shingles are looked up among the shingles that give the templates' keys, and a window around such
a place collides if none of its shingles has a lesser hash in that band. Shingles of a template that
give none of its keys retrieve nothing.

Templates are a table (license, text): full licences in ``license_texts`` and the notices below, or the
caller's. Their shingles and keys are computed by the same expressions and go into the plan as three
literals, so a plan does not grow with them; MOST bounds the table. All else is one projection of
built-in functions, nothing is shuffled.

Defined cases: null and empty texts, texts or templates of under five words, and templates without a name,
match nothing; repeated
rows each give their matches; empty tables give no rows. Hashes have 64 bits.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import text_of

SHINGLE, BANDS, CONTAINED = 5, 48, 0.8
#: Templates of one scan; they are collected to become literals.
MOST = 2000

TEXTS = Path(__file__).parent / "license_texts"
#: Statements and notices by which texts and files refer to a licence.
NOTICES = {
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "AGPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def template_rows() -> list[tuple[str, str]]:
    return [(f.stem, f.read_text()) for f in sorted(TEXTS.glob("*.txt"))] + list(NOTICES.items())


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "license string, text string")


def grams_of(text: Column) -> Column:
    """ARRAY<BIGINT> of a text's shingles in order; null for under five words."""

    def hashed(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        return F.when(F.size(w) >= SHINGLE, F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))))

    return _let(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), "array<bigint>", hashed)


def _let(value: Column, kind: str, body) -> Column:
    """body(value), of SQL type kind, with value computed once."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def compiled(templates: DataFrame) -> tuple[Column, Column, list[int]]:
    """Two literals, the templates (name, shingles in order, distinct shingles) and their band keys (the
    shingle that gives it, band, least hash, template, shingles), and the shingles that give keys."""
    if templates.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} templates: scan for them in parts")
    t = templates.select("license", grams_of(text_of()).alias("g")).where("g is not null")
    t = t.select("license", F.size("g").alias("unit"), F.array_distinct("g").alias("own"))
    least = lambda b: F.array_min(F.transform("own", lambda s: F.struct(F.xxhash64(s, b).alias("h"), s.alias("s"))))
    rows = t.select("*", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BANDS - 1).cast("bigint")), least).alias("keys")).orderBy("license", "unit").collect()
    own = [{"name": r["license"], "unit": r["unit"], "own": r["own"]} for r in rows]
    keys = [{"s": k["s"], "b": b, "h": k["h"], "t": i, "unit": r["unit"]} for i, r in enumerate(rows) for b, k in enumerate(r["keys"])]
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    return (
        literal(own, "array<struct<name:string,unit:int,own:array<bigint>>>"),
        literal(keys, "array<struct<s:bigint,b:bigint,h:bigint,t:int,unit:int>>"),
        sorted({k["s"] for k in keys}),
    )


def scanned(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, license, containment (of the best window), n_windows, for each match."""
    table, keys, givers = compiled(template_table(docs.sparkSession) if templates is None else templates)
    grams = docs.select("doc_id", grams_of(text_of()).alias("g"))
    g = F.col("g")
    # conditions stand within expressions: as filters they would be pushed down, and each array computed again
    known = F.expr(f"transform(g, (x, i) -> IF(x IN ({', '.join(map(str, givers)) or 'NULL'}), struct(x AS x, i AS i), NULL))")
    places = F.filter(known, lambda p: p.isNotNull())

    def window(c: Column) -> Column:
        return F.slice(g, c["k"] * c["unit"] + 1, 2 * c["unit"])

    def around(p: Column) -> Column:
        """Template, window and band for each band key that this place may give."""
        own = F.filter(keys, lambda t: t["s"] == p["x"])
        at = lambda t, back: F.struct(t["t"], t["unit"], t["b"], t["h"], (F.floor(p["i"] / t["unit"]) - back).cast("int").alias("k"))
        return F.filter(F.flatten(F.transform(own, lambda t: F.array(at(t, 0), at(t, 1)))), lambda c: c["k"] >= 0)

    def collides(c: Column) -> Column:
        return F.array_min(F.transform(window(c), lambda s: F.xxhash64(s, c["b"]))) == c["h"]

    met = F.filter(F.flatten(F.transform(places, around)), collides)
    windows = F.array_distinct(F.transform(met, lambda c: F.struct(c["t"], c["unit"], c["k"])))

    def share(c: Column) -> Column:
        own = F.get(table, c["t"])["own"]
        return F.struct(c["t"], (F.size(F.array_intersect(window(c), own)) / F.size(own).cast("double")).alias("held"))

    verified = F.filter(F.transform(windows, share), lambda v: v["held"] >= CONTAINED)

    def best(v: Column) -> Column:
        def of(t: Column) -> Column:
            held = F.transform(F.filter(v, lambda x: x["t"] == t), lambda x: x["held"])
            return F.struct(F.get(table, t)["name"].alias("license"), F.array_max(held).alias("containment"), F.size(held).cast("long").alias("n_windows"))

        return F.transform(F.array_distinct(F.transform(v, lambda x: x["t"])), of)

    matches = _let(verified, "array<struct<license:string,containment:double,n_windows:bigint>>", best)
    hits = grams.select("doc_id", F.explode_outer(F.when(g.isNotNull(), matches)).alias("x")).where("x.license is not null")
    return hits.select("doc_id", "x.license", "x.containment", "x.n_windows")


def _op10_sql() -> str:
    """All windows against all templates, without bands."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in template_rows())
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return rf"""
WITH t(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {words} AS w FROM t),
ts AS (SELECT license, len(w) - {SHINGLE - 1} AS unit, array_to_string(w[i+1:i+{SHINGLE}], ' ') AS shingle
       FROM (SELECT license, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM tw WHERE len(w) >= {SHINGLE})),
s AS (SELECT DISTINCT license, unit, shingle, count(DISTINCT shingle) OVER (PARTITION BY license) AS n FROM ts),
d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
g AS (SELECT doc_id, r, i AS pos, array_to_string(w[i+1:i+{SHINGLE}], ' ') AS shingle
      FROM (SELECT doc_id, r, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM d WHERE len(w) >= {SHINGLE})),
h AS (SELECT doc_id, r, license, n, shingle, pos // unit AS k FROM g JOIN s USING (shingle)),
v AS (SELECT * FROM h UNION ALL SELECT doc_id, r, license, n, shingle, k - 1 FROM h WHERE k > 0),
c AS (SELECT doc_id, r, license, k, count(DISTINCT shingle) / any_value(n)::DOUBLE AS held FROM v GROUP BY ALL)
SELECT doc_id, license, max(held) AS containment, count(*)::BIGINT AS n_windows
FROM c WHERE held >= {CONTAINED} GROUP BY doc_id, r, license"""


OP10_SQL = _op10_sql()
