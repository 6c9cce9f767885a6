"""Licence recognition by sentence rules, in DataFrame functions only.

Texts are cut into sentences in two views: by lines, and flowing (wrapped lines joined, comment signs dropped).
Sentences are normalised and looked up in a table of known licence sentences; what remains of a view is its sequence
of sentence identifiers. Ordered rules, each a sequence of identifiers that may have a few others between, are matched
against it; a rule takes the sentences that it matched, so that a later, weaker rule can't match them again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licences and notices, by identifier.
SENTENCES: dict[int, str] = {
    1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    2: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    3: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    4: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    5: "Released under the MIT License.",
    6: "Licensed under the MIT License.",
    7: "This project is licensed under the MIT License.",
    8: "The MIT License (MIT)",
    9: "SPDX-License-Identifier: MIT",
    20: "Licensed under the Apache License, Version 2.0.",
    21: "Licensed under the Apache License, Version 2.0 (the \"License\");",
    22: "you may not use this file except in compliance with the License.",
    23: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    24: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    25: "See the License for the specific language governing permissions and limitations under the License.",
    26: "SPDX-License-Identifier: Apache-2.0",
    27: "Released under the Apache License, Version 2.0.",
    40: "This work is licensed under the GNU General Public License, version 3.",
    41: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    42: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    43: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    44: "See the GNU General Public License for more details.",
    46: "SPDX-License-Identifier: GPL-3.0-only",
    47: "SPDX-License-Identifier: GPL-3.0-or-later",
    48: "SPDX-License-Identifier: GPL-2.0-only",
    49: "SPDX-License-Identifier: GPL-2.0-or-later",
    50: "This work is licensed under the GNU General Public License, version 2.",
    51: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    52: "See the GNU Affero General Public License for more details.",
    53: "SPDX-License-Identifier: AGPL-3.0-only",
    54: "either version 2 of the License, or (at your option) any later version.",
    55: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    56: "This work is licensed under the GNU Lesser General Public License, version 3.",
    57: "SPDX-License-Identifier: LGPL-3.0-only",
    70: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    71: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    72: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    73: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    74: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    75: "SPDX-License-Identifier: BSD-3-Clause",
    76: "SPDX-License-Identifier: BSD-2-Clause",
    77: "Licensed under the BSD 3-Clause License.",
    78: "Licensed under the BSD 2-Clause License.",
    90: "Licensed under CC BY-NC 4.0.",
    91: "Licensed under CC BY 4.0.",
    92: "Licensed under CC BY-SA 4.0.",
    93: "Licensed under CC BY-NC-SA 4.0.",
    94: "Licensed under CC BY-ND 4.0.",
    95: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    96: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    97: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    98: "Released under CC0 1.0 into the public domain.",
    99: "SPDX-License-Identifier: CC0-1.0",
    110: "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    111: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    112: "SPDX-License-Identifier: MPL-2.0",
    113: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    114: "SPDX-License-Identifier: ISC",
    115: "This is free and unencumbered software released into the public domain.",
    116: "SPDX-License-Identifier: Unlicense",
}

#: Licence (SPDX identifier) and its sequence of sentences, in order of strength.
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("MIT", (1, 2, 3, 4)), ("MIT", (1, 2, 3)), ("MIT", (1, 2)),
    ("Apache-2.0", (21, 22, 23, 24, 25)), ("Apache-2.0", (21, 22)),
    ("AGPL-3.0", (51, 42, 43, 52)), ("AGPL-3.0", (51,)),
    ("GPL-3.0", (41, 42, 43, 44)), ("GPL-3.0", (41,)),
    ("GPL-2.0", (55, 54, 42, 43, 44)), ("GPL-2.0", (55, 54)),
    ("BSD-3-Clause", (70, 71, 72, 73, 74)), ("BSD-3-Clause", (70, 71, 72, 73)),
    ("BSD-2-Clause", (70, 71, 72, 74)), ("BSD-2-Clause", (70, 71, 72)),
    ("MPL-2.0", (110, 111)), ("MPL-2.0", (110,)), ("ISC", (113,)),
    ("MIT", (5,)), ("MIT", (6,)), ("MIT", (7,)), ("MIT", (8,)), ("MIT", (9,)),
    ("Apache-2.0", (20,)), ("Apache-2.0", (26,)), ("Apache-2.0", (27,)),
    ("GPL-3.0", (40,)), ("GPL-3.0", (46,)), ("GPL-3.0", (47,)), ("GPL-2.0", (48,)), ("GPL-2.0", (49,)), ("GPL-2.0", (50,)),
    ("AGPL-3.0", (53,)), ("LGPL-3.0", (56,)), ("LGPL-3.0", (57,)),
    ("BSD-3-Clause", (75,)), ("BSD-2-Clause", (76,)), ("BSD-3-Clause", (77,)), ("BSD-2-Clause", (78,)),
    ("CC-BY-NC-4.0", (90,)), ("CC-BY-4.0", (91,)), ("CC-BY-SA-4.0", (92,)), ("CC-BY-NC-SA-4.0", (93,)), ("CC-BY-ND-4.0", (94,)),
    ("CC-BY-4.0", (95,)), ("CC-BY-NC-4.0", (96,)), ("CC-BY-SA-4.0", (97,)), ("CC0-1.0", (98,)), ("CC0-1.0", (99,)),
    ("MPL-2.0", (112,)), ("ISC", (114,)), ("Unlicense", (115,)), ("Unlicense", (116,)),
]

#: Further sentences and rules, which the SQL below leaves aside.
MORE_SENTENCES: dict[int, str] = {
    200: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    201: "either version 2.1 of the License, or (at your option) any later version.",
    202: "either version 3 of the License, or (at your option) any later version.",
    203: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    204: "SPDX-License-Identifier: LGPL-2.1-only", 205: "SPDX-License-Identifier: LGPL-2.1-or-later", 206: "SPDX-License-Identifier: LGPL-3.0-or-later",
    207: "SPDX-License-Identifier: AGPL-3.0-or-later", 208: "SPDX-License-Identifier: EPL-1.0", 209: "SPDX-License-Identifier: EPL-2.0", 210: "SPDX-License-Identifier: Artistic-2.0",
    220: "GNU GENERAL PUBLIC LICENSE", 221: "GNU LESSER GENERAL PUBLIC LICENSE", 222: "GNU AFFERO GENERAL PUBLIC LICENSE",
    223: "Version 3, 29 June 2007", 224: "Version 2, June 1991", 225: "Version 2.1, February 1999", 226: "Version 3, 19 November 2007",
    227: "Apache License", 228: "Version 2.0, January 2004", 229: "Eclipse Public License - v 1.0", 230: "Eclipse Public License - v 2.0",
    231: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    232: "The Artistic License 2.0", 233: "Mozilla Public License Version 2.0",
    240: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    241: "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    242: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    243: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    244: "This software is provided 'as-is', without any express or implied warranty.",
    245: "In no event will the authors be held liable for any damages arising from the use of this software.",
    246: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    247: "The origin of this software must not be misrepresented;", 248: "you must not claim that you wrote the original software.",
    249: "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    250: "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    251: "This notice may not be removed or altered from any source distribution.",
    252: "Boost Software License - Version 1.0 - August 17th, 2003",
    253: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    254: "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    255: "Distributed under the Boost Software License, Version 1.0.",
    256: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    257: "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    258: "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", 259: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    260: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    261: "IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
    262: "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    263: "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
    264: "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    265: "The licenses for most software are designed to take away your freedom to share and change it.",
    266: "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    267: "By contrast, our General Public Licenses are intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    268: "SPDX-License-Identifier: Zlib", 269: "SPDX-License-Identifier: BSL-1.0", 270: "SPDX-License-Identifier: 0BSD", 271: "SPDX-License-Identifier: MIT-0", 272: "SPDX-License-Identifier: WTFPL", 273: "SPDX-License-Identifier: BSD-4-Clause",
    274: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    234: "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
}
MORE_RULES: list[tuple[str, tuple[int, ...]]] = [
    ("LGPL-2.1", (200, 201)), ("LGPL-3.0", (200, 202)), ("LGPL-3.0", (203,)), ("GPL-3.0", (55, 202)),
    ("LGPL-2.1", (204,)), ("LGPL-2.1", (205,)), ("LGPL-3.0", (206,)), ("AGPL-3.0", (207,)), ("EPL-1.0", (208,)), ("EPL-2.0", (209,)), ("Artistic-2.0", (210,)),
    ("GPL-3.0", (220, 223)), ("GPL-2.0", (220, 224)), ("LGPL-2.1", (221, 225)), ("LGPL-3.0", (221, 223)), ("AGPL-3.0", (222, 226)),
    ("Apache-2.0", (227, 228)), ("EPL-1.0", (229,)), ("EPL-2.0", (230,)), ("EPL-2.0", (231,)), ("Artistic-2.0", (232,)), ("MPL-2.0", (233,)),
    ("BSD-3-Clause", (70, 71, 72, 234)), ("BSD-4-Clause", (70, 71, 72, 260, 73)), ("BSD-4-Clause", (70, 71, 72, 260)),
    ("Zlib", (244, 245, 246, 247, 248, 249, 250, 251)), ("Zlib", (244, 245, 246, 250)), ("Zlib", (246, 250)), ("BSL-1.0", (252, 253, 254, 3)), ("BSL-1.0", (253, 254)), ("BSL-1.0", (255,)), ("Unlicense", (115, 256, 257, 3)),
    ("MIT-0", (243, 3, 4)), ("MIT-0", (243,)), ("0BSD", (242, 240, 241)), ("0BSD", (242,)), ("ISC", (113, 240, 241)), ("WTFPL", (258, 259)), ("WTFPL", (258,)), ("Apache-2.0", (227, 228, 262, 263)), ("Apache-2.0", (262, 263)),
    ("GPL-3.0", (220, 223, 264, 266)), ("GPL-3.0", (264, 266)), ("GPL-2.0", (220, 224, 265, 266)),
    ("Zlib", (268,)), ("BSL-1.0", (269,)), ("0BSD", (270,)), ("MIT-0", (271,)), ("WTFPL", (272,)), ("BSD-4-Clause", (273,)),
]

#: Every known sentence holds one of these; texts without any need no cutting.
CUES = ("licen", "permission", "redistribut", "copyright", "warrant", "public domain", "mozilla")
#: Other known sentences that may stand between two of a rule.
GAP = 3
#: A sentence ends behind these signs if white space follows, behind a colon at the end of a line, and at the borders
#: of its view.
STOP = r"([.;!?])[ \t\r\f\x0B]+"
COLON = r":[ \t\r]*\n"
JOIN = r"[ \t\r]*\n[ \t\r/*#>;%-]*"
BLANK = r"\n[ \t\r/*#>;%-]*\n"
JUNK = r"[^a-z0-9+]+"
#: The holder's name in the third clause and the disclaimer of BSD licences, also wrapped; it may hold signs that end sentences.
_W = r"[\s/*#>;%-]+"
_HOLDER = r"(?:(?!\n[ \t\r/*#>;%-]*\n)[\s\S]){1,200}?"
_USE = "may be used to endorse or promote products derived from this software without specific prior written permission"
HOLDERS = [
    (
        rf"neither{_W}the{_W}names?{_W}of{_W}(?!the{_W}copyright{_W}holder{_W}nor){_HOLDER}{_W}nor{_W}the{_W}names{_W}of{_W}(?:its|their|any|other|the){_W}contributors{_W}" + _USE.replace(" ", _W),
        f"neither the name of the copyright holder nor the names of its contributors {_USE}",
    ),
    (rf"display{_W}the{_W}following{_W}acknowledge?ment:", "display the following acknowledgement. "),
    (rf"in{_W}no{_W}event{_W}shall{_W}{_HOLDER}{_W}be{_W}liable{_W}for{_W}any{_W}claim,", "in no event shall the authors or copyright holders be liable for any claim,"),
    (rf"in{_W}no{_W}event{_W}shall{_W}{_HOLDER}{_W}be{_W}liable{_W}for{_W}any{_W}direct,", "in no event shall the copyright owner or contributors be liable for any direct,"),
    (rf"in{_W}no{_W}event{_W}shall{_W}{_HOLDER}{_W}be{_W}liable{_W}for{_W}any{_W}special,", "in no event shall the author be liable for any special,"),
    (rf"(\"|``|'')as{_W}is(\"|''){_W}and{_W}{_HOLDER}{_W}disclaims?{_W}all{_W}warranties", '"as is" and the author disclaims all warranties'),
    (rf"this{_W}software{_W}is{_W}provided{_W}by{_W}{_HOLDER}{_W}[^a-z0-9\s]*as{_W}is\b", 'this software is provided by the copyright holders and contributors "as is'),
]


def normal(sentence: str) -> str:
    return re.sub(JUNK, " ", sentence.lower()).strip(" ")


def pattern(rule: tuple[int, ...]) -> str:
    """A rule over identifiers that are written as <1><2>."""
    return ("(?:<[0-9]+>){0,%d}?" % GAP).join(f"<{i}>" for i in rule)


def every_rule() -> list[tuple[str, tuple[int, ...]]]:
    """All rules, long further ones first: a rule takes the sentences that shorter ones would match."""
    long = [r for r in MORE_RULES if len(r[1]) > 2 or r[1][0] in (243, 242, 246, 253, 262, 264)]
    return sorted(long, key=lambda r: -len(r[1])) + RULES + [r for r in MORE_RULES if r not in long]


def _views(text: Column) -> Column:
    """The two views' sentences, not yet normalised: struct of lines and flow."""
    cut = lambda c: F.split(F.regexp_replace(c, STOP, "$1\n"), "\n")
    for named, common in HOLDERS:
        text = F.regexp_replace(text, named, common)
    text = F.regexp_replace(text, COLON, ".\n")
    flow = F.regexp_replace(F.regexp_replace(text, BLANK, ". "), JOIN, " ")
    return F.array(cut(text), cut(flow))


def licences(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, licenses (sorted, comma-joined), n_licenses, sentences (identifiers of the view
    that holds more; the lines' if equal), n_sentences.

    Null and empty texts have none; rows with equal key and text have equal results, also without a key; other
    columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted((normal(s), i) for i, s in (SENTENCES | MORE_SENTENCES).items()), "sentence string, sid int")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    lower = F.lower("t")
    cue = F.lit(False)
    for c in CUES:
        cue = cue | lower.contains(c)
    held = texts.where(cue).select("k", F.xxhash64("t").alias("h"), F.posexplode(_views(lower)).alias("view", "cut"))
    found = held.select("k", "h", "view", F.posexplode("cut").alias("pos", "raw"))
    found = found.withColumn("sentence", F.btrim(F.regexp_replace("raw", JUNK, " ")))
    # the table of known sentences is fixed above
    found = found.join(F.broadcast(known), "sentence").select("k", "h", "view", "pos", "sid")
    # equal rows meet here: each place counts once
    views = found.groupBy("k", "h", "view").agg(F.sort_array(F.collect_set(F.struct("pos", "sid")))["sid"].alias("ids"))
    rules = F.array(*[F.struct(F.lit(l).alias("l"), F.lit(pattern(r)).alias("p")) for l, r in every_rule()])
    matched = F.aggregate(
        rules,
        F.struct(F.concat(F.lit("<"), F.array_join(F.col("ids").cast("array<string>"), "><"), F.lit(">")).alias("rest"), F.array().cast("array<string>").alias("got")),
        lambda s, r: F.struct(
            F.regexp_replace(s["rest"], r["p"], F.lit("")).alias("rest"),
            F.when(F.regexp_like(s["rest"], r["p"]), F.array_append(s["got"], r["l"])).otherwise(s["got"]).alias("got"),
        ),
    )["got"]
    views = views.select("k", "h", "view", "ids", matched.alias("got"))
    best = F.max(F.struct(F.size("ids").alias("n"), (-F.col("view")).alias("v"), "ids"))
    each = views.groupBy(F.col("k").alias("fk"), F.col("h").alias("fh")).agg(best.alias("best"), F.flatten(F.collect_list("got")).alias("got"))
    each = each.select("fk", "fh", F.array_sort(F.array_distinct("got")).alias("names"), F.col("best.ids").alias("ids"))
    return (
        docs.select(F.col(key), F.xxhash64(text).alias("h"))
        .join(each, F.col(key).eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh")), "left")
        .select(
            key,
            F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
            F.when(F.col("names").isNull(), 0).otherwise(F.size("names")).cast("long").alias("n_licenses"),
            F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("sentences"),
            F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_sentences"),
        )
    )


def duckdb_sql() -> str:
    """The same in DuckDB's SQL over ``documents`` (unique doc_id)."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(normal(s))}, {i})" for i, s in SENTENCES.items())
    cut = lambda c: f"string_split(regexp_replace({c}, {quoted(STOP)}, '\\1\n', 'g'), '\n')"
    flow = f"regexp_replace(regexp_replace(t, {quoted(BLANK)}, '. ', 'g'), {quoted(JOIN)}, ' ', 'g')"
    step = "SELECT doc_id, view, ids, '<' || array_to_string(ids, '><') || '>' AS rest, CAST([] AS VARCHAR[]) AS got FROM g"
    for l, r in RULES:
        p = quoted(pattern(r))
        step = f"SELECT doc_id, view, ids, regexp_replace(rest, {p}, '', 'g') AS rest, CASE WHEN regexp_matches(rest, {p}) THEN list_append(got, '{l}') ELSE got END AS got FROM ({step})"
    return f"""
WITH known(sentence, sid) AS (VALUES {known}
), d AS (SELECT doc_id, regexp_replace(lower(text), {quoted(COLON)}, '.' || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT doc_id, 0 AS view, {cut("t")} AS cut FROM d UNION ALL SELECT doc_id, 1, {cut(flow)} FROM d
), s AS (SELECT doc_id, view, unnest(range(1, len(cut) + 1)) AS pos, unnest(cut) AS raw FROM c
), f AS (SELECT doc_id, view, pos, sid FROM s JOIN known ON known.sentence = trim(regexp_replace(raw, {quoted(JUNK)}, ' ', 'g'))
), g AS (SELECT doc_id, view, list(sid ORDER BY pos) AS ids FROM f GROUP BY 1, 2
), r AS ({step}
), n AS (SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(got)))), ',') AS licenses, CAST(len(list_distinct(flatten(list(got)))) AS BIGINT) AS n FROM r GROUP BY 1
), b AS (SELECT DISTINCT ON (doc_id) doc_id, ids FROM r ORDER BY doc_id, len(ids) DESC, view)
SELECT documents.doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses, coalesce(array_to_string(ids, ','), '') AS sentences, coalesce(CAST(len(ids) AS BIGINT), 0) AS n_sentences
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN b USING (doc_id)
"""
