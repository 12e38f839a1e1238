"""Licence notices in texts: Dice coefficient of word bigrams against templates, with DataFrame functions only.

Templates are whole licence texts, the headers and notices that licences tell their users to put into files, and
one-line notices. A text is compared as one run of normalised words, across the ends of lines and sentences: with a
template of n words, each span of n words that ends with one of its bigrams.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Names that notices give to licences, and what a notice begins with. A template is a beginning and a name.
NAMES = {
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPL-3.0"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache-2.0 license", "Apache-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "BSD-3-Clause"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0", "the Creative Commons Zero 1.0 Universal dedication", "CC0-1.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPL-3.0"),
    "ISC": ("the ISC License", "ISC"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPL-3.0"),
    "MIT": ("the MIT License", "MIT License", "MIT"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "Unlicense": ("the Unlicense", "Unlicense"),
}
BEGINNINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This file is licensed under", "This program is distributed under the terms of", "SPDX-License-Identifier:")


#: Texts of licences, and the headers and notices that they prescribe, as published. Years and holders are left out.
TEXTS = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}


def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_rows() -> list[tuple[str, int, list[str]]]:
    """(licence, number of words, distinct word bigrams) of each template."""
    notices = [(licence, f"{beginning} {name}") for licence, names in NAMES.items() for beginning in BEGINNINGS for name in names]
    out = []
    for licence, text in [*notices, *((licence, t) for licence, own in TEXTS.items() for t in own)]:
        w = words_of(text)
        out.append((licence, len(w), list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))))
    return out


def size_bounds(n: int, threshold: float) -> range:
    """Numbers of bigrams that a set may have whose Dice coefficient with a set of n can reach the threshold."""
    low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return range(max(1, math.ceil(low - 1e-9)), math.floor(high + 1e-9) + 1)


def templates(spark: SparkSession, threshold: float) -> DataFrame:
    """len, licence, template (bigrams), and the least and most bigrams of a span that can match. Its size is that of the lists above."""
    rows = [(n, licence, bigrams, size_bounds(len(bigrams), threshold)[0], size_bounds(len(bigrams), threshold)[-1]) for licence, n, bigrams in template_rows()]
    return spark.createDataFrame(rows, "len int, licence string, template array<string>, least int, most int")


def license_matches(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), start, end (words), licence, size (bigrams of the template), dice: each span with each template that it matches.

    A span has as many words as the template, fewer where the text begins, and ends with a bigram of the template.
    A template of b bigrams can only reach the threshold t with spans of t/(2-t) b to (2-t)/t b bigrams, of which as
    many as the lower bound are among its own; spans with fewer bigrams of any template aren't looked at. Nothing else
    is left out.
    """
    spark = docs.sparkSession
    known = sorted({b for _, _, bigrams in template_rows() for b in bigrams})
    needs: dict[int, int] = {}
    for _, n, bigrams in template_rows():
        needs[n] = min(needs.get(n, n), size_bounds(len(bigrams), threshold)[0])
    # a filter is moved below the projections that it reads, which computes them again for every reference; it isn't
    # moved below a generator, so each array comes out of one
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+", " "))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.explode_outer(F.array(F.split(plain, " "))).alias("w"))
    flagged = f"filter(if(size(w) > 1, sequence(0, size(w) - 2), array()), i -> concat(w[i], ' ', w[i + 1]) IN ({', '.join(repr(b) for b in known)}))"
    rows = rows.select("doc_id", "digest", "w", F.explode_outer(F.array(F.expr(flagged))).alias("qs"))
    # a span of l words that ends with the bigram at qs[k] has at least `need` such bigrams
    ends = "filter(sequence(0, size(qs) - 1), k -> k + 1 >= t.need AND qs[greatest(k + 1 - t.need, 0)] >= qs[k] + 2 - t.l)"
    sizes = ", ".join(f"named_struct('l', {n}, 'need', {need})" for n, need in sorted(needs.items()))
    spans = f"flatten(transform(array({sizes}), t -> transform({ends}, k -> shiftleft(cast(t.l AS bigint), 40) + qs[k])))"
    rows = rows.select("doc_id", "digest", "w", F.explode_outer(F.expr(f"if(size(qs) > 1, {spans}, array())")).alias("at")).where("at IS NOT NULL")
    rows = rows.select("doc_id", "digest", "w", F.expr("cast(shiftright(at, 40) AS int)").alias("len"), F.expr("cast(at & 1099511627775L AS int) + 2").alias("end"))
    rows = rows.select("doc_id", "digest", "len", F.greatest(F.col("end") - F.col("len"), F.lit(0)).alias("start"), "end", "w")
    rows = rows.select("doc_id", "digest", "len", "start", "end", F.explode_outer(F.array(F.expr("transform(sequence(start, end - 2), i -> concat(w[i], ' ', w[i + 1]))"))).alias("all"))
    rows = rows.select("doc_id", "digest", "len", "start", "end", F.element_at("all", -1).alias("last"), F.explode_outer(F.array(F.array_distinct("all"))).alias("bigrams"))
    both = rows.join(F.broadcast(templates(spark, threshold)), "len").where(F.size("bigrams").between(F.col("least"), F.col("most")) & F.expr("array_contains(template, last)"))
    dice = 2 * F.size(F.array_intersect("bigrams", "template")) / (F.size("bigrams") + F.size("template"))
    return both.select("doc_id", "digest", "start", "end", "licence", F.size("template").alias("size"), dice.alias("dice")).where(F.col("dice") >= threshold).distinct()


def notices(found: DataFrame) -> DataFrame:
    """doc_id, licence, dice of each notice: a run of matches that overlap, which counts for its best (highest Dice, largest template, first name)."""
    text = W.partitionBy("doc_id", "digest").orderBy("start", "end", "licence", "size")
    before = F.max("end").over(text.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("first", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("run", F.sum("first").over(text.rowsBetween(W.unboundedPreceding, 0)))
    best = F.min_by("licence", F.struct(-F.col("dice"), -F.col("size"), F.col("licence")))
    return rows.groupBy("doc_id", "digest", "run").agg(best.alias("licence"), F.max("dice").alias("dice"))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named in each whole text.

    Returns one row per distinct doc_id: doc_id, licence (of the best notice; by name among equals; empty if none),
    dice (0 if none), n_notices (runs of overlapping matches), licences (all that notices count for, by name, joined
    by commas). Null and empty texts match nothing; rows with a null id make one row; a text repeated with its id
    counts once; notices of different texts with one id add up; an empty table gives an empty table; further columns
    are ignored.
    """
    best = notices(license_matches(docs, threshold, id_col, text_col))
    by_doc = best.groupBy(F.col("doc_id").alias("_id")).agg(
        F.min_by("licence", F.struct(-F.col("dice"), F.col("licence"))).alias("licence"), F.max("dice").alias("dice"), F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences")
    )
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    out = ids.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce("licence", F.lit("")).alias("licence"), F.round(F.coalesce("dice", F.lit(0.0)), 9).alias("dice"), F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("licences", F.lit("")).alias("licences"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL: for each template, every span that ends with one of its bigrams and has enough of them."""
    values = ", ".join(f"({k}, '{licence}', {n}, {size_bounds(len(bigrams), threshold)[0]}, [{', '.join(repr(b) for b in bigrams)}])" for k, (licence, n, bigrams) in enumerate(template_rows()))
    return f"""
        WITH templates(t, licence, n, need, template) AS MATERIALIZED (VALUES {values}),
        worded AS MATERIALIZED (
            SELECT row_number() OVER () AS d, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
            FROM (SELECT DISTINCT doc_id, text FROM documents)),
        placed AS (SELECT d, unnest(range(0, len(w) - 1)) AS q, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM worded WHERE len(w) > 1),
        hits AS (SELECT d, t, n, need, q FROM placed JOIN (SELECT t, n, need, unnest(template) AS bigram FROM templates) USING (bigram)),
        dense AS (SELECT d, t, q, greatest(q + 2 - n, 0) AS start, count(*) OVER (PARTITION BY d, t ORDER BY q RANGE BETWEEN n - 2 PRECEDING AND CURRENT ROW) AS k, need FROM hits),
        spans AS (
            SELECT d, doc_id, start, q + 2 AS stop, licence, template, list_distinct(list_transform(range(start + 1, q + 2), lambda i: w[i] || ' ' || w[i + 1])) AS bigrams
            FROM dense JOIN worded USING (d) JOIN templates USING (t) WHERE k >= dense.need),
        matches AS (SELECT DISTINCT d, doc_id, start, stop, licence, len(template) AS size, 2 * len(list_intersect(bigrams, template)) / (len(bigrams) + len(template)) AS dice FROM spans),
        good AS (SELECT *, max(stop) OVER (PARTITION BY d ORDER BY start, stop, licence, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM matches WHERE dice >= {threshold}),
        runs AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY start, stop, licence, size ROWS UNBOUNDED PRECEDING) AS run FROM good),
        best AS (SELECT doc_id, licence, dice FROM runs QUALIFY row_number() OVER (PARTITION BY d, run ORDER BY dice DESC, size DESC, licence) = 1),
        by_doc AS (
            SELECT doc_id, first(licence ORDER BY dice DESC, licence) AS licence, max(dice) AS dice, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
            FROM best GROUP BY doc_id)
        SELECT d.doc_id, coalesce(licence, '') AS licence, round(coalesce(dice, 0), 9) AS dice, coalesce(n_notices, 0) AS n_notices, coalesce(licences, '') AS licences
        FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN by_doc b ON d.doc_id = b.doc_id"""
