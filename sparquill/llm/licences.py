"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest directory above. DataFrame functions only.

Templates are the passages of licences: standard headers, titles, SPDX forms, and the paragraphs of full texts (of the long ones, those that open them).
Each window of a text, a sentence or up to `max(WINDOWS)` adjacent lines, is compared with all passages; common words are no terms, idf comes from the
passages, and a term that none has weighs most. A window of cosine `LEAST` or more has the passage's licence if the words that tell versions and variants apart allow it. Windows
that can't reach `LEAST` are left out by two bounds that are exact: the terms of a passage that weigh most, the rest of which weighs less than LEAST squared,
can't all be missing; and a window's cosine is at most the share of its length that lies in terms which passages have.

A document's own licence is that of its best window. It is a licence file if its name says so or if at least half its words lie in such windows, and then
declares the licence of its directory. A document without a licence of its own takes that of the nearest directory above it.

Templates are a few rows of fixed text, weighed in advance, so their broadcast is bounded. A text is cut to lines and terms once, and what may be a notice is
written once; words are counted in documents with such windows only. Inheritance is resolved on distinct directories, which are written, so that Spark can spread a directory
of many documents when it joins them.

Defined results: a null text has no notice; a null path lies in the root directory, whose name is empty; of several licence files in a directory the
most similar counts, then the first licence by name; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, located

LEAST, WINDOWS = 0.6, (1, 2, 3, 4, 6, 8, 12)
#: Sentences end in a line; terms are words with inner dots and dashes; a licence file's name.
SENTENCES, WORDS, NAMED = r"(?<=[.!?])[ \t]+", r"[a-z0-9]+(?:[.-][a-z0-9]+)*", r"(?i)^(un)?licen[cs]e|^copying|^notice"

AS_IS = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
SOURCE_FORM = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BINARY_FORM = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
# Passages of licences.
TEMPLATES = {
    "AGPL-3.0": [
        "This program " + FREE.format("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "Licensed under the GNU Affero General Public License, version 3.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [REDISTRIBUTION, SOURCE_FORM, BINARY_FORM, AS_IS, "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0-1.0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.", "SPDX-License-Identifier: CC0-1.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "GPL-2.0": [
        "This program " + FREE.format("General Public License", "2").replace("software:", "software;"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0",
    ],
    "GPL-3.0": [
        "This program " + FREE.format("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.", "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL-2.1": [
        "This library " + FREE.format("Lesser General Public License", "2.1").replace("software:", "software;"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "LGPL-3.0": [
        "This library " + FREE.format("Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "SPDX-License-Identifier: Zlib",
    ],
}
# What a window must have, and what it must not have, to be a licence's (in lower case).
GNU = "affero|agpl|lesser|lgpl|library general"
APART = {
    "AGPL-3.0": ("affero|agpl", "lgpl|lesser"), "Apache-2.0": ("apache|as is|license. shall mean|terms and conditions for use, reproduction", ""), "BSD-2-Clause": ("", "bsd[ -]3|neither the name"),
    "BSD-3-Clause": ("bsd[- ]style|bsd[ -]3|names of", "bsd[ -]2|bsd-4"), "CC-BY-4.0": ("4[.]0", "share-?alike|by-sa|by-nc|non-?commercial|no-?deriv|by-nd"), "CC-BY-NC-4.0": ("non-?commercial|by-nc", "share-?alike|-sa|no-?deriv|-nd"),
    "CC-BY-NC-SA-4.0": ("by-nc-sa|non-?commercial-share", "no-?deriv|-nd"), "CC-BY-ND-4.0": ("no-?deriv|by-nd", "share-?alike|-sa|non-?commercial|by-nc"), "CC-BY-SA-4.0": ("share-?alike|by-sa", "non-?commercial|by-nc|no-?deriv|-nd"),
    "EPL-2.0": ("eclipse|epl", "epl-1|v 1[.]0"), "GPL-2.0": ("version 2([^.0-9]|$)|gpl-?v?2|version 2[.]0", GNU), "GPL-3.0": ("version 3|gpl-?v?3|copyleft license for software", GNU), "LGPL-2.1": ("2[.]1", "affero|agpl"), "LGPL-3.0": ("version 3|lgpl-?v?3", "affero|agpl"),
    "MIT": ("(^|[^a-z])mit([^a-z]|$)|permission|as is", ""), "MPL-2.0": ("2[.]0|was not distributed", "1[.][01]"),
}
#: A document with passages of both has the first.
INSTEAD = {"BSD-3-Clause": "BSD-2-Clause"}


#: Words of any text, which are no terms.
COMMON = frozenset("a about all also an and any are as at be but by can case do each every for form from free has have if in into is it its later law may means mit more must name no not of on one only or other out person persons provided reform see shall so such that the their them there these they this those to under use used was were which will with without work works you your 1 2 3 9 19 29".split())


def _weigh() -> tuple[list[tuple[str, int, str, float]], dict[str, float], float, list[str]]:
    """Of the passages: (licence, passage, term, normed weight), the terms' idf, that of a term which no passage has, and the terms of which a window needs one."""
    passages = [(licence, body) for licence, bodies in TEMPLATES.items() for body in bodies]
    tf = [Counter(t for t in re.findall(WORDS, body.lower()) if t not in COMMON) for _, body in passages]
    idf = {t: math.log((1 + len(tf)) / (1 + sum(t in own for own in tf))) + 1 for t in sorted({t for own in tf for t in own})}
    weights, needed = [], set()
    for k, ((licence, _), own) in enumerate(zip(passages, tf, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
        rest = 1.0
        for w, t in sorted(((n * idf[t] / norm, t) for t, n in own.items()), key=lambda x: (-x[0], x[1])):
            weights.append((licence, k, t, w))
            if rest >= (LEAST - 0.001) ** 2:
                needed.add(t)
                rest -= w * w
    return weights, idf, math.log(1 + len(tf)) + 1, sorted(needed)


WEIGHTS, IDF, UNKNOWN, NEEDED = _weigh()


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), 0)


def _lower(text: Column) -> Column:
    """In lower case as in SQL: a capital I with a dot is an i, not an i and a dot that would end a term."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def _gate(text: Column) -> Column:
    """Whether a text in lower case has a term without which no window reaches `LEAST`."""
    return F.arrays_overlap(_terms(text), F.array(*map(F.lit, NEEDED)))


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rows of strings and numbers as a local relation."""
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({schema})")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), for which the value is computed once a row. Spark would compute an expression anew for each element that a lambda function meets."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: The terms of passages by number, those of which a window needs one first.
CODES = {t: k for k, t in enumerate([*NEEDED, *sorted(IDF.keys() - set(NEEDED))])}


def _counted(body: Column) -> Column:
    """struct(known, others): the numbers of the terms that passages have, each as often as it occurs, and how many others there are."""
    codes = F.expr(f"map({', '.join(f"'{t}', {k}" for t, k in CODES.items())})")
    known = lambda terms: F.transform(F.filter(terms, lambda t: t.isin(*CODES)), lambda t: F.element_at(codes, t))
    split = lambda terms: _once(known(terms), lambda own: F.struct(own.alias("known"), (F.size(terms) - F.size(own)).alias("others")))
    return _once(F.filter(_terms(body), lambda t: ~t.isin(*sorted(COMMON))), split)


def _near(known: Column, others: Column) -> Column:
    """Whether a window with these terms may reach `LEAST`. Its cosine is at most the share of its known terms in its length. What they weigh beyond one
    occurrence of each adds most to the sum of squares if it's all the heaviest one's; other terms add least if all differ."""
    values = F.expr(f"array({', '.join(f'{IDF[t]!r}D' for t in CODES)})")
    idf = lambda codes: F.transform(codes, lambda k: F.get(values, k))
    add = lambda each: F.aggregate(each, F.lit(0.0), lambda n, x: n + x)
    share = (LEAST - 0.001) ** 2

    def enough(each: Column, all_: Column) -> Column:
        more = all_ - add(each)
        return (1 - share) * (add(F.transform(each, lambda x: x * x)) + 2 * more * F.array_max(each) + more * more) >= share * UNKNOWN**2 * others

    return (F.size(known) > 0) & _once(F.struct(idf(F.array_distinct(known)).alias("each"), add(idf(known)).alias("all")), lambda x: enough(x["each"], x["all"]))


def _windows(lines: Column) -> Column:
    """array of struct(first, n, body) from lines in lower case: the lines that have a needed term, their sentences, and all runs of adjacent lines with such
    a line, without those that can't reach `LEAST`."""
    window = lambda i, n, body: F.struct(i.alias("first"), F.lit(n).alias("n"), body.alias("body"))
    none = F.array().cast("array<struct<first:int,n:int,body:string>>")

    def single(x: Column, i: Column) -> Column:
        sentences = F.array_distinct(F.concat(F.split(F.get(x["lines"], i), SENTENCES), F.array(F.get(x["lines"], i))))
        return F.transform(F.filter(sentences, lambda s: _once(_counted(s), lambda c: _near(c["known"], c["others"]))), lambda s: window(i, 1, s))

    def joined(x: Column, n: int) -> Column:
        low, high = (lambda i: F.greatest(i - (n - 1), F.lit(0))), (lambda i: F.least(i, F.size(x["lines"]) - n))
        first = F.array_distinct(F.flatten(F.transform(x["hot"], lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>")))))
        near = lambda c: _near(F.flatten(F.transform(c, lambda y: y["known"])), F.aggregate(c, F.lit(0), lambda m, y: m + y["others"]))
        return F.transform(F.filter(first, lambda i: _once(F.slice(x["counts"], i + 1, n), near)), lambda i: window(i, n, F.array_join(F.slice(x["lines"], i + 1, n), " ")))

    def all_of(x: Column) -> Column:
        return F.concat(F.flatten(F.transform(x["hot"], lambda i: single(x, i))), *(joined(x, n) for n in WINDOWS if n > 1))

    hot = lambda counts: F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.array_min(F.get(counts, i)["known"]) < len(NEEDED))
    whole = lambda y: _once(F.struct(y["lines"].alias("lines"), y["counts"].alias("counts"), hot(y["counts"]).alias("hot")), all_of)
    return F.coalesce(_once(F.struct(lines.alias("lines"), F.transform(lines, _counted).alias("counts")), whole), none)


def _allowed(body: Column) -> Column:
    """The licences whose telling words a window allows."""
    tests = [(k, must, never) for k, (must, never) in APART.items()]
    hold = F.array(*(F.when((body.rlike(must) if must else F.lit(True)) & (~body.rlike(never) if never else F.lit(True)), F.lit(k)) for k, must, never in tests))
    return F.concat(F.filter(hold, lambda k: k.isNotNull()), F.array(*(F.lit(k) for k in TEMPLATES if k not in APART)))


def scan(docs: DataFrame, id: Column, path: Column, text: Column) -> DataFrame:
    """(id, path, own_licence, similarity, licence, declared_in) for each row."""
    docs, file, at = located(docs)
    spark, key = docs.sparkSession, ["file", "at"]
    rows = docs.select(id.alias("id"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text"), F.xxhash64(file).alias("file"), at.alias("at"))
    rows = rows.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(""))
    weights = F.broadcast(_values(spark, WEIGHTS, "licence, passage, term, w"))
    idf = F.broadcast(_values(spark, list(IDF.items()), "term, idf"))
    sizes = lambda lines: F.transform(lines, lambda line: F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    heard = lambda x: F.when(F.size(x["windows"]) > 0, F.struct(x["windows"].alias("windows"), sizes(x["lines"]).alias("sizes")))
    noticed = _once(F.split(_lower(F.col("text")), "\n"), lambda lines: _once(F.struct(lines.alias("lines"), _windows(lines).alias("windows")), heard))
    noticed = rows.where(_gate(_lower(F.col("text")))).select(*key, "path", "dir", F.explode(F.filter(F.array(noticed), lambda x: x.isNotNull())).alias("x")).select(*key, "path", "dir", "x.*")
    noticed = keep(noticed, "notices")
    said = noticed.select(*key, F.explode("windows").alias("window")).select(*key, "window.*").withColumn("digest", F.md5("body"))
    bodies = said.select("digest", "body").dropDuplicates(["digest"])
    tf = bodies.select("digest", F.explode(_terms(F.col("body"))).alias("term")).where(~F.col("term").isin(*sorted(COMMON))).groupBy("digest", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(idf, "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(UNKNOWN)))
    norm = tf.groupBy("digest").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dot = tf.join(weights, "term").groupBy("digest", "licence", "passage").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    near = dot.join(norm, "digest").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 4)).where(F.col("similarity") >= LEAST)
    near = near.groupBy("digest", "licence").agg(F.max("similarity").alias("similarity")).join(bodies, "digest").where(F.array_contains(_allowed(F.col("body")), F.col("licence")))
    near = said.drop("body").join(near.select("digest", "licence", "similarity"), "digest")
    lines = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))))
    best = near.groupBy(*key).agg(F.min(F.struct((-F.col("similarity")).alias("less"), "licence")).alias("top"), F.collect_set("licence").alias("every"), lines.alias("lines"))
    own_licence = reduce(lambda out, p: F.when((out == p[1]) & F.array_contains("every", p[0]), p[0]).otherwise(out), INSTEAD.items(), F.col("top.licence"))
    best = best.select(*key, (-F.col("top.less")).alias("similarity"), own_licence.alias("own_licence"), "lines")
    total = lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + x)
    whole = 2 * total(F.transform("lines", lambda k: F.get("sizes", k))) >= total("sizes")
    own = noticed.select(*key, "path", "dir", "sizes").join(best, key).withColumn("is_file", whole | F.regexp_replace("path", "^.*/", "").rlike(NAMED))
    own = keep(own.select(*key, "dir", "own_licence", "similarity", "is_file"), "licences")

    files = own.where("is_file").groupBy("dir").agg(F.min(F.struct(-F.col("similarity"), F.col("own_licence"))).alias("best"))
    files = files.select(F.col("dir").alias("above"), F.col("best.own_licence").alias("declared"))
    parts = F.split("dir", "/")
    above = rows.select("dir").distinct().select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("above")).distinct()
    nearest = above.join(files, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "declared")).alias("n"))
    nearest = keep(nearest.select("dir", F.col("n.above").alias("declared_in"), F.col("n.declared").alias("declared")), "directories")
    found = rows.select(*key, "id", "path", "dir").join(own.drop("dir", "is_file"), key, "left").join(nearest, "dir", "left")
    return found.select("id", "path", "own_licence", "similarity", F.coalesce("own_licence", "declared").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("declared_in")).alias("declared_in"))
