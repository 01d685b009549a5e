"""License scans: normalised lines and texts against templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.llm.urlfilter import LOWER, UPPER

#: Least Dice coefficient, in percent.
PERCENT = 80

#: Parts of templates: Creative Commons suites, the GNU notice, and what full texts share.
_CC = [("BY", ""), ("BY-SA", "ShareAlike"), ("BY-NC", "NonCommercial"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives")]
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Public licence notices and short full texts, by SPDX identifier.
TEMPLATES = [
    # full texts, without the copyright line; first, since ties go to the earlier template and notices below are parts of them
    ("MIT", _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    # notices
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *[(f"CC-{code}-4.0", f"This work is licensed under a Creative Commons Attribution-{name} 4.0 International License.") for code, name in _CC[2:]],
    *[(f"CC-{code}-4.0", f"Licensed under CC {code} 4.0.") for code, _ in _CC],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *[(code, f"{verb} under the {name} License.") for code, name in (("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("MPL-2.0", "Mozilla Public"), ("Zlib", "zlib"), ("EPL-2.0", "Eclipse Public")) for verb in ("Released", "Licensed")],
    *[(code, _GNU.format(name=name, version=version)) for code, name, version in (("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))],
    *[(code, f"This work is licensed under the GNU {name} Public License, version {version}.") for code, name, version in (("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))],
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def words_of(text: Column) -> Column:
    """A-Z lower-cased, all but a-z and 0-9 taken as white space."""
    flat = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))
    return F.when(flat != "", F.split(flat, " ")).otherwise(F.array().cast("array<string>"))


def bigrams_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def templates(spark: SparkSession, known: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Templates (template, licence, bigrams); a fixed list, whatever the input's size."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(known)], "template int, licence string, text string")
    return rows.select("template", "licence", bigrams_of(words_of(F.col("text"))).alias("bigrams"))


def _candidates(docs: DataFrame, known: list, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, row, text) of texts that hold enough of one template's bigrams, wherever they stand, for some unit to match it; found by hashes of bigrams."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), text.alias("text"), F.explode(F.array(words_of(text))).alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    listed = [(sorted(set(r.hashes)), -(-percent * len(set(r.hashes)) // (200 - percent))) for r in known]
    # each array is one constant after folding; literals by the thousand would be slow to plan
    numbers = [f"CAST(split('{','.join(map(str, hs))}', ',') AS array<bigint>)" for hs, _ in [(sorted({h for hs, _ in listed for h in hs}), 0), *listed]]
    whole = F.expr(numbers[0])
    dealt = F.expr("array(" + ", ".join(f"named_struct('need', {need}, 'hashes', {hs})" for (_, need), hs in zip(listed, numbers[1:])) + ")")
    # explode keeps words and hits from being worked out again wherever they are used
    hits = each.select("id", "row", "text", F.explode(F.array(F.array_intersect(whole, pairs))).alias("hits")).where(F.size("hits") >= min(need for _, need in listed))
    return hits.where(F.exists(dealt, lambda t: F.size(F.array_intersect(t["hashes"], F.col("hits"))) >= t["need"])).select("id", "row", "text")


def _runs(texts: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(id, row, line, last, template, shared, total) of runs of lines, short of the whole text, that reach ``percent``.

    A run starts and ends on lines that share a bigram with the template (without them it would only come closer), and
    its bigrams, counted with repeats, fit the template's sizes.
    """
    # a word knows its line, its place there and the line's size, so that each bigram tells where its lines start and end
    lines = F.transform(F.split("text", "\n"), words_of)
    words = F.flatten(F.transform(lines, lambda ws, i: F.transform(ws, lambda w, q: F.struct(i.alias("line"), q.alias("q"), F.size(ws).alias("m"), w.alias("word")))))
    each = texts.dropDuplicates(["row"]).select("id", "row", F.explode(F.array(words)).alias("words")).where(F.size("words") > 1)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.struct(a["line"].alias("i"), a["q"].alias("q"), b["line"].alias("j"), (b["m"] - b["q"]).alias("left"), F.concat(a["word"], F.lit(" "), b["word"]).alias("g")))
    each = written(each.select("id", "row", pairs.alias("pairs")), "licence-bigrams")

    b = F.size("bigrams")
    bounds = known.select("template", F.explode("bigrams").alias("g"), F.ceil(percent * b / (200 - percent)).cast("int").alias("low"), F.floor((200 - percent) * b / percent).cast("int").alias("high"))
    at = each.select("row", F.posexplode("pairs").alias("k", "p")).select("row", "k", "p.i", "p.j", (F.col("k") - F.col("p.q")).alias("start"), (F.col("k") + F.col("p.left")).alias("end"), "p.g")
    hits = at.join(F.broadcast(bounds), "g").withColumn("r", F.row_number().over(Window.partitionBy("row", "template").orderBy("k")))
    hits = written(hits.drop("g", "k"), "licence-hits")
    # starts meet ends by stretches of the template's largest size, so that a text's hits don't all meet
    starts = hits.groupBy("row", "template", "low", "high", F.col("i").alias("line"), "start").agg(F.min("r").alias("r1"))
    starts = starts.withColumn("stretch", F.explode(F.array(F.floor(F.col("start") / F.col("high")), F.floor(F.col("start") / F.col("high")) + 1)))
    ends = hits.groupBy("row", "template", F.col("j").alias("last"), "end", F.floor(F.col("end") / F.col("high")).alias("stretch")).agg(F.max("r").alias("r2"))
    met = starts.join(ends, ["row", "template", "stretch"]).where("last > line AND end - start BETWEEN low AND high AND r2 - r1 + 1 >= low")
    met = met.select("row", "template", "line", "last", "start", "end").join(each, "row").where("start > 0 OR end < size(pairs)")
    met = met.select("id", "row", "template", "line", "last", F.explode(F.array(F.array_distinct(F.slice("pairs.g", F.col("start") + 1, F.col("end") - F.col("start"))))).alias("own"))
    met = met.join(F.broadcast(known.select("template", F.col("bigrams").alias("theirs"))), "template").withColumn("shared", F.size(F.array_intersect("own", "theirs"))).withColumn("total", F.size("own") + F.size("theirs"))
    return met.where(200 * F.col("shared") >= percent * F.col("total")).select("id", "row", "line", "last", "template", "shared", "total")


def _closest(units: DataFrame) -> DataFrame:
    """Lines and whole texts, and those runs that no unit of the same template overlaps that is closer, or as close and shorter, or else earlier."""
    dice = F.col("shared") / F.col("total")
    own = F.struct(dice.alias("dice"), (F.col("line") - F.col("last")).alias("length"), (-F.col("line")).alias("first"))
    whole = F.max(F.when(F.col("line") < 0, dice)).over(Window.partitionBy("row", "template"))
    units = units.distinct().withColumns({"own": own, "whole": whole})
    every = units.withColumn("at", F.explode(F.sequence("line", "last"))).withColumn("most", F.max("own").over(Window.partitionBy("row", "template", "at")))
    kept = every.groupBy(*units.columns).agg(F.min((F.col("own") == F.col("most")).cast("int")).alias("kept"))
    return kept.where("line = last OR kept = 1 AND (whole IS NULL OR own.dice > whole)").drop("own", "whole", "kept")


def licence_matches(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, line, last, template, licence, shared, total): units whose Dice 2 * shared / total with a template is ``percent`` or more.

    Units are a text's lines (numbered from 0), if it has several the whole text (line and last -1), and runs of lines,
    of which only the closest of those that overlap count. A template is a candidate only for units of sizes at which
    the coefficient can be reached: sizes a and b need 200 * min(a, b) >= percent * (a + b); each template carries those
    sizes, so units and templates meet by equal size. Null and empty texts match nothing. Ids may be null or repeat;
    extra columns are ignored.
    """
    # for a template of b bigrams, unit sizes from percent * b / (200 - percent) to (200 - percent) * b / percent
    known = known.where(F.size("bigrams") > 0)
    b = F.size("bigrams")
    sizes = F.sequence(F.ceil(percent * b / (200 - percent)).cast("int"), F.floor((200 - percent) * b / percent).cast("int"))
    dealt = known.select("template", F.explode(sizes).alias("n"))
    hashed = known.select(F.transform("bigrams", lambda g: F.xxhash64(F.split(g, " ")[0], F.split(g, " ")[1])).alias("hashes")).collect()
    least = dealt.agg(F.min("n"), F.max("n")).first()
    if not hashed:
        return docs.limit(0).select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("line", "int"), ("last", "int"), ("template", "int"), ("licence", "string"), ("shared", "int"), ("total", "int"))])
    texts = written(_candidates(docs, hashed, id_col, text_col, percent), "licence-texts")
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
    units = F.when(F.size(lines) > 1, F.concat(numbered, F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("unit"))))).otherwise(numbered)
    each = texts.select("id", "row", F.explode(units).alias("u")).select("id", "row", "u.line", F.explode(F.array(words_of(F.col("u.unit")))).alias("words"))
    each = each.where(F.size("words") > least[0]).select("id", "row", "line", F.explode(F.array(bigrams_of(F.col("words")))).alias("own")).withColumn("n", F.size("own")).where(F.col("n") <= least[1])
    met = each.join(F.broadcast(dealt), "n").join(F.broadcast(known.select("template", F.col("bigrams").alias("theirs"))), "template").withColumn("shared", F.size(F.array_intersect("own", "theirs")))
    met = met.withColumn("total", F.col("n") + F.size("theirs")).where(200 * F.col("shared") >= percent * F.col("total"))
    met = met.select("id", "row", "line", F.col("line").alias("last"), "template", "shared", "total").unionByName(_runs(texts, known, percent))
    return _closest(met).join(F.broadcast(known.select("template", "licence")), "template").select(F.col("id").alias(id_col), "line", "last", "template", "licence", "shared", "total")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_matches, line, template, licence, dice) of every row: its best match, ties to the smaller line, then template.

    Rows without a match have n_matches 0 and nulls. Rows that repeat an id share one result.
    """
    dice = F.round(2.0 * F.col("shared") / F.col("total"), 6)
    best = licence_matches(docs, known, id_col, text_col, percent).distinct().groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n"), F.max(F.struct(dice.alias("dice"), (-F.col("line")).alias("l"), (-F.col("template")).alias("t"), "licence")).alias("m"))
    out = docs.select(F.col(id_col)).join(best, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return out.select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), (-F.col("m.l")).alias("line"), (-F.col("m.t")).alias("template"), "m.licence", "m.dice")
