"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A document is scanned as a whole, line by line, and by runs of words of any place and length up to twice a template's,
for notices stand alone, in running text, and wrapped over lines at the head of a longer text. A unit can reach a
coefficient of ``t`` with a template of ``b`` distinct bigrams only if it holds ``b * t / (2 - t)`` of them, so one pass
over a document's bigrams leaves the few templates it may hold, and most documents none. A run that begins or ends on
a bigram foreign to the template, or beside one of its own, is never better than the run without the first or with the
second; so the runs from one block of own bigrams to another are all that need a score, and that is exact.
Everything is one Spark projection; the templates are a constant of it, and nothing is shuffled.

Defined results: a null or empty text has no licence (null, score 0, no hits); of equal scores the first template by
name counts, then the first unit; of runs that overlap one counts, that of a template at least twice as large, else
the better; a run counts only where neither the whole text nor a line it touches is a hit of its template; repeated
rows get a result each; an empty table gives none.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

THRESHOLD = 0.8
SLACK = 1e-9  # for bounds in floating point; the coefficient itself decides

#: Public licence texts and the notices in common use.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = Path(__file__).with_name("licence_texts")
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": _APACHE,
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _GPL3,
    "isc": _ISC,
    "mit": "Released under the MIT License.",
    "mit-text": _MIT,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
} | {f"{f.stem}-text": f.read_text() for f in sorted(TEXTS.glob("*.txt"))}

APART = r"[^\p{L}\p{N}\n]+"


def _all_bigrams(text: str) -> list[str]:
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    return list(dict.fromkeys(_all_bigrams(text)))


def _pairs(w: Column) -> Column:
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))


def _earlier(pairs: Column) -> Column:
    """For each bigram the place where it stood last before, or -1: by one sort of bigrams with their places, and one back."""
    placed = F.sort_array(F.transform(pairs, lambda x, i: F.struct(x.alias("x"), i.alias("place"))))

    def before(sorted_: Column) -> Column:
        def last(x: Column, k: Column) -> Column:
            other = F.get(sorted_, k - 1)
            return F.struct(x["place"].alias("place"), F.when((k > 0) & (other["x"] == x["x"]), other["place"]).otherwise(-1).alias("before"))

        return F.transform(sorted_, last)

    return F.transform(F.sort_array(let(placed, before)), lambda x: x["before"])


def licence_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, score, unit, n_hits) of every row: the best template, its coefficient, where (0 the whole text, else
    the line, of a run its first), and how many units reach the threshold. Without a hit the licence and unit are null
    and the score 0."""
    known = [(name, b, len(_all_bigrams(text))) for name, text in sorted(templates.items()) if (b := bigrams(text))]
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(b)).alias("size"), F.lit(2 * longest).alias("longest"), F.split(F.lit("\n".join(b)), "\n").alias("bigrams")) for n, b, longest in known])
    any_of = sorted({x for _, b, _ in known for x in b})
    least = min(len(b) for _, b, _ in known) * threshold / (2 - threshold) - SLACK

    def enough(shared: Column, t: Column) -> Column:
        return shared * (2 - threshold) + SLACK >= threshold * t["size"]

    def minus(own: Column, t: Column) -> Column:
        return -2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + t["size"])

    def scored(unit: Column, may: Column) -> Column:
        def of(own: Column) -> Column:
            fit = F.filter(may, lambda t: enough(F.size(own), t) & (F.size(own) * threshold - SLACK <= (2 - threshold) * t["size"]))
            return F.array_min(F.transform(fit, lambda t: F.struct(minus(own, t).alias("minus"), t["name"].alias("name"), unit["at"].alias("at"))))

        return let(F.array_distinct(_pairs(unit["w"])), of)

    def runs_of(t: Column, pairs: Column, earlier: Column) -> Column:
        """The best run of each start, where that is a hit; one pass over the places behind a start counts all its runs."""

        def of(own: Column) -> Column:
            at = lambda i: F.coalesce(F.get(own, i), F.lit(False))
            places = F.transform(own, lambda x, i: F.struct(i.alias("place"), F.get(earlier, i).alias("before"), x.alias("own"), (x & ~at(i + 1)).alias("last")))
            ranked = F.filter(F.transform(own, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())

            def starts_of(own_at: Column) -> Column:
                ranks = F.transform(own_at, lambda i, k: F.struct(i.alias("place"), k.alias("rank")))
                starts = F.filter(ranks, lambda s: ~at(s["place"] - 1))
                # of a start's window only the last own bigram that lies in it: how many own ones the longest run can have
                held = lambda s: F.size(F.filter(F.slice(own_at, s["rank"] + 1, t["longest"]), lambda i: i - s["place"] < t["longest"]))
                return F.transform(F.filter(F.transform(starts, lambda s: F.struct(s["place"].alias("place"), held(s).alias("held"))), lambda s: enough(s["held"], t)), lambda s: s["place"])

            def best(all_places: Column):
                def run(s: Column) -> Column:
                    def step(state: Column, x: Column) -> Column:
                        new = x["before"] < s
                        distinct = state["distinct"] + new.cast("int")
                        shared = state["shared"] + (new & x["own"]).cast("int")
                        value = -2.0 * shared / (distinct + t["size"])
                        better = x["last"] & (value < state["minus"])
                        return F.struct(distinct.alias("distinct"), shared.alias("shared"), F.when(better, value).otherwise(state["minus"]).alias("minus"), F.when(better, x["place"]).otherwise(state["end"]).alias("end"))

                    begin = F.struct(F.lit(0).alias("distinct"), F.lit(0).alias("shared"), F.lit(0.0).alias("minus"), F.lit(-1).alias("end"))
                    return F.aggregate(F.slice(all_places, s + 1, t["longest"]), begin, step, lambda r: F.struct(r["minus"].alias("minus"), (-t["size"]).alias("less"), t["name"].alias("name"), s.alias("first"), r["end"].alias("last")))

                return lambda starts: F.filter(F.transform(starts, run), lambda r: r["minus"] <= -threshold)

            return let(places, lambda all_places: let(let(ranked, starts_of), best(all_places)))

        return let(F.transform(pairs, lambda x: F.array_contains(t["bigrams"], x)), of)

    def apart(runs: Column) -> Column:
        """Of overlapping runs one, from the left."""

        def step(state: Column, x: Column) -> Column:
            last = state["last"]
            larger = x["less"] <= 2 * last["less"]
            smaller = last["less"] <= 2 * x["less"]
            better = larger | (~smaller & (F.struct(x["minus"], x["less"], x["name"]) < F.struct(last["minus"], last["less"], last["name"])))
            meets = x["first"] <= last["last"] + 1
            kept = F.when(last.isNull() | meets, state["kept"]).otherwise(F.concat(state["kept"], F.array(last)))
            return F.struct(kept.alias("kept"), F.when(last.isNull() | ~meets | better, x).otherwise(last).alias("last"))

        kind = "struct<minus:double,less:int,name:string,first:int,last:int>"
        start = F.struct(F.array().cast(f"array<{kind}>").alias("kept"), F.lit(None).cast(kind).alias("last"))
        by_place = F.array_sort(runs, lambda x, y: F.when(x["first"] != y["first"], x["first"] - y["first"]).otherwise(y["last"] - x["last"]))
        return F.aggregate(by_place, start, step, lambda s: F.when(s["last"].isNull(), s["kept"]).otherwise(F.concat(s["kept"], F.array(s["last"]))))

    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), APART, " ")
    cell = lambda part, at: F.struct(F.array_remove(F.split(part, "[ \n]+"), "").alias("w"), at.cast("int").alias("at"))

    def hits_of(w: Column, pairs: Column, may: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), lambda x, i: cell(x, i + 1))
        units = F.filter(F.concat(F.array(F.struct(w.alias("w"), F.lit(0).alias("at"))), lines), lambda u: F.size(u["w"]) - 1 >= least)
        hits = F.filter(F.transform(units, lambda u: scored(u, may)), lambda x: x["minus"] <= -threshold)
        line = F.flatten(F.transform(lines, lambda x: F.array_repeat(x["at"], F.size(x["w"]))))
        runs = apart(let(_earlier(pairs), lambda earlier: F.flatten(F.transform(may, lambda t: runs_of(t, pairs, earlier)))))

        def with_runs(hits: Column) -> Column:
            def own(line: Column) -> Column:
                known = lambda r: F.exists(hits, lambda h: (h["name"] == r["name"]) & ((h["at"] == 0) | h["at"].between(F.get(line, r["first"]), F.get(line, r["last"] + 1))))
                return F.transform(F.filter(runs, lambda r: ~known(r)), lambda r: F.struct(r["minus"].alias("minus"), r["name"].alias("name"), F.get(line, r["first"]).alias("at")))

            return F.concat(hits, let(line, own))

        return let(hits, with_runs)

    def from_pairs(w: Column, pairs: Column) -> Column:
        def from_places(places: Column) -> Column:
            held = F.array_distinct(F.transform(places, lambda i: F.get(pairs, i)))
            may = let(held, lambda m: F.filter(table, lambda t: enough(F.size(m), t) & enough(F.size(F.array_intersect(t["bigrams"], m)), t)))
            return let(may, lambda m: F.when(F.size(m) > 0, hits_of(w, pairs, m)))

        marked = F.transform(pairs, lambda x, i: F.when(x.isin(any_of), i))
        return let(F.array_compact(marked), from_places)

    words = F.array_remove(F.split(text, "[ \n]+"), "")
    hits = let(words, lambda w: let(_pairs(w), lambda p: from_pairs(w, p)))
    empty = F.array().cast("array<struct<minus:double,name:string,at:int>>")
    found = docs.select(F.col(id_col), F.coalesce(hits, empty).alias("hits")).withColumn("best", F.array_min("hits"))
    return found.select(id_col, F.col("best.name").alias("license"), F.coalesce(-F.col("best.minus"), F.lit(0.0)).alias("score"), F.col("best.at").alias("unit"), F.size("hits").cast("long").alias("n_hits"))
