"""License scans with DataFrame functions only: Dice coefficient over word bigrams against licence templates.

A document is one sequence of lower-case words of letters and digits, so a notice may be wrapped over lines, stand behind
comment marks, or inside other text. A span of it is compared with a template by 2 s / (a + b): distinct bigrams shared, of
the span, and of the template. Only spans that begin with a run of the template's bigrams and end with one need be looked
at: bigrams of other text at an end only lower the coefficient, and a whole run only raises it. Such a span is a single run
or has at most n / ratio bigrams, repeats included, for a template of n; ratio = least / (2 - least).

Size bounds prune the templates before any span is looked at: a coefficient of ``least`` takes at least ratio * n shared
bigrams, so a template of which the document has fewer can't match, nor can a span with fewer. Each template
is placed at its best span (the first of equals); one that overlaps the span of a better template is left out, so that a
version's notice doesn't stand for another version. All of it happens inside a document's row: nothing is shuffled, and templates are constants of the query.

The distinct bigrams of a span that begins at ``low`` are the places whose bigram last stood before ``low``. So one walk from each run's begin, over
at most as many hits as a span can hold, gives every span's coefficient: work grows with runs times the template's length.

Cases: null and empty texts and single words have no licence; a licence that occurs several times counts once; ties go to
the name that sorts first; repeated rows are scanned once each; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST = 0.8

# Texts and notices of public licences.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_ZLIB = "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_MIT_REST = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_REST = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_REST = ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB_REST = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_APACHE_REST = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."

TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("BSD", _BSD),
    ("BSD", _BSD + _BSD_REST),
    ("BSD", "Released under the BSD License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(v=2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(v=3)),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_REST}"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_REST}"),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", f"{_ZLIB} {_ZLIB_REST}"),
    ("proprietary", "All rights reserved."),
    *[(f"CC-{kind}-{v}.0", f"Licensed under CC {kind} {v}.0.") for kind in ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA") for v in (3, 4)],
]


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _once(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """``docs`` with a column that is computed once for each row: filters on later columns aren't rewritten to compute it again."""
    return docs.select("*", F.explode(F.array(value)).alias(name))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per document: id, ``n_matches`` (licences found), ``license`` and ``dice`` (best match), ``licenses`` (all, comma-joined)."""
    known = sorted({(name, tuple(template_bigrams(text))) for name, text in templates})
    every = sorted({b for _, bigrams in known for b in bigrams})
    heads = sorted({b.split(" ")[0] for b in every})
    ratio = least / (2 - least)
    literal = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), F.lit(len(b) * ratio - 1e-9).alias("few"), F.lit(len(b) / ratio + 1e-9).alias("long"), F.array(*map(F.lit, b)).alias("bigrams")) for name, b in known])

    def bigram(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))

    def let(value: Column, body) -> Column:
        """``body`` of a value that is computed once, where a lambda would compute it for each of its uses."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def before(w: Column, places: Column) -> Column:
        """Where the bigram of each place stood the last time before, or 0: neighbours in the order of bigrams and places."""
        laid = lambda of: F.transform(of, lambda x, k: F.struct(x["i"].alias("i"), F.when((k > 0) & (F.get(of, k - 1)["b"] == x["b"]), F.get(of, k - 1)["i"]).otherwise(0).alias("p")))
        return F.transform(F.array_sort(let(F.array_sort(F.transform(places, lambda i: F.struct(bigram(w, i).alias("b"), i.alias("i")))), laid)), lambda x: x["p"])

    def runs(of: Column) -> Column:
        """First and last hit of each run of neighbouring bigrams, as places in ``of``."""
        begins = F.filter(F.sequence(F.lit(1), F.size(of)), lambda k: (k == 1) | (F.get(of, k - 2)["i"] + 1 < F.get(of, k - 1)["i"]))
        ends = F.filter(F.sequence(F.lit(1), F.size(of)), lambda k: F.get(of, k - 1)["end"])
        return F.arrays_zip(begins.alias("a"), ends.alias("b"))

    def best(prev: Column, of: Column, t: Column) -> Column:
        """The best span of one template: (minus the coefficient, first and last bigram, name). One walk from each run's begin over the hits that a span can hold."""

        def from_run(r: Column) -> Column:
            low = F.element_at(of, r["a"])["i"]
            reach = F.greatest(low + t["long"] - 1, F.element_at(of, r["b"])["i"])
            none = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("whole"), (low - 1).alias("last"), F.struct(F.lit(0.0).alias("minus"), low.alias("low"), low.alias("high"), t["name"].alias("name")).alias("best"))

            def step(s: Column, h: Column) -> Column:
                gap = F.when(h["i"] > s["last"] + 1, F.size(F.filter(F.slice(prev, s["last"] + 1, h["i"] - s["last"] - 1), lambda p: p < low))).otherwise(0)
                new = (F.get(prev, h["i"] - 1) < low).cast("int")
                shared, whole = s["shared"] + new, s["whole"] + gap + new
                found = F.struct((-2.0 * shared / (whole + t["n"])).alias("minus"), low.alias("low"), h["i"].alias("high"), t["name"].alias("name"))
                gone = F.struct(shared.alias("shared"), whole.alias("whole"), h["i"].alias("last"), F.when(h["end"], F.least(s["best"], found)).otherwise(s["best"]).alias("best"))
                return F.when(h["i"] <= reach, gone).otherwise(s)

            return F.aggregate(F.slice(of, r["a"], F.greatest(F.ceil(t["long"]).cast("int"), r["b"] - r["a"] + 1)), none, step, lambda s: s["best"])

        return let(runs(of), lambda found: F.array_min(F.transform(found, from_run)))

    def hits_of(hits: Column, t: Column) -> Column:
        """A template's own hits; ``end``: the next one isn't its neighbour."""
        own = F.filter(hits, lambda h: F.array_contains(t["bigrams"], h["b"]))
        return let(own, lambda of: F.transform(of, lambda h, k: F.struct(h["i"].alias("i"), (F.coalesce(F.get(of, k + 1)["i"], F.lit(-1)) != h["i"] + 1).alias("end"))))

    marked = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("_text"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    out = _once(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "w", F.split(marked, " ")).drop("_text")
    places = F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    here = F.filter(places, lambda i: F.element_at("w", i).isin(heads) & bigram(F.col("w"), i).isin(every))
    out = _once(out, "hits", F.transform(here, lambda i: F.struct(i.alias("i"), bigram(F.col("w"), i).alias("b"))))
    out = _once(out, "has", F.array_distinct(F.transform("hits", lambda h: h["b"])))
    fit = F.when(F.size("has") > 0, F.filter(literal, lambda t: F.size(F.array_intersect(t["bigrams"], F.col("has"))) >= t["few"])).otherwise(F.slice(literal, 1, 0))
    out = _once(out, "fit", fit)
    out = _once(out, "prev", F.when(F.size("fit") > 0, before(F.col("w"), places)).otherwise(F.array().cast("array<int>")))
    placed = F.transform("fit", lambda t: let(hits_of(F.col("hits"), t), lambda of: best(F.col("prev"), of, t)))
    out = _once(_once(out, "best", placed).select("_id", "best"), "placed", F.filter("best", lambda m: -m["minus"] >= least))
    found = F.filter("placed", lambda m: ~F.exists("placed", lambda o: (o["minus"] < m["minus"]) & (o["low"] <= m["high"]) & (o["high"] >= m["low"])))
    out = _once(out, "found", F.transform(found, lambda m: F.struct(m["minus"].alias("minus"), m["name"].alias("name"))))
    out = out.withColumn("names", F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))))
    top = F.array_min("found")
    return out.select(F.col("_id").alias(id_col), F.size("names").cast("long").alias("n_matches"), top["name"].alias("license"), (-top["minus"]).alias("dice"), F.array_join("names", ",").alias("licenses"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    rows = ",\n".join(f"({k}, '{name}', '{b}')" for k, (name, bigrams) in enumerate(sorted({(n, tuple(template_bigrams(t))) for n, t in TEMPLATES})) for b in bigrams)
    ratio = LEAST / (2 - LEAST)
    return f"""
WITH t(k, name, bigram) AS (VALUES {rows}),
tn AS (SELECT k, name, count(*) AS n FROM t GROUP BY k, name),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM documents),
b AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] AS bigram FROM (SELECT r, ws, unnest(range(1, len(ws))) AS i FROM d)),
h AS (SELECT r, k, i, bigram FROM b JOIN t USING (bigram)),
may AS (SELECT r, k, any_value(n) AS n FROM h JOIN tn USING (k) GROUP BY r, k HAVING count(DISTINCT bigram) >= any_value(n) * {ratio} - 1e-9),
g AS (SELECT r, k, n, i, bigram, i - row_number() OVER (PARTITION BY r, k ORDER BY i) AS run FROM h JOIN may USING (r, k)),
u AS (SELECT r, k, n, run, min(i) AS lo, max(i) AS hi FROM g GROUP BY r, k, n, run),
s AS (SELECT x.r, x.k, x.n, x.lo, y.hi FROM u x JOIN u y ON x.r = y.r AND x.k = y.k AND y.lo >= x.lo AND (x.lo = y.lo OR y.hi - x.lo + 1 <= x.n / {ratio} + 1e-9)),
c AS (SELECT s.r, s.k, s.n, s.lo, s.hi, count(DISTINCT g.bigram) AS shared FROM s JOIN g ON g.r = s.r AND g.k = s.k AND g.i BETWEEN s.lo AND s.hi GROUP BY ALL HAVING count(DISTINCT g.bigram) >= s.n * {ratio} - 1e-9),
w AS (SELECT c.r, c.k, c.lo, c.hi, 2.0 * any_value(shared) / (count(DISTINCT b.bigram) + any_value(n)) AS dice FROM c JOIN b ON b.r = c.r AND b.i BETWEEN c.lo AND c.hi GROUP BY c.r, c.k, c.lo, c.hi),
one AS (SELECT * FROM w WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, lo, hi) = 1),
best AS (SELECT r, name, max(dice) AS dice FROM one x JOIN tn USING (k) WHERE NOT EXISTS (SELECT 1 FROM one y WHERE y.r = x.r AND y.dice > x.dice AND y.lo <= x.hi AND y.hi >= x.lo) GROUP BY r, name),
o AS (SELECT r, count(*) AS n_matches, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses FROM best GROUP BY r)
SELECT doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, license, CAST(o.dice AS DOUBLE) AS dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN o USING (r)
"""


OP10_SQL = _sql()
