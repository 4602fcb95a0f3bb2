"""Licence scans by sentence rules, in DataFrame functions alone.

Comment signs and list numbers are taken from the starts of lines.  A text is
then cut into sentences at sentence ends and blank lines, and into lines; both
are normalised to lower-case letters and digits with single blanks.
Known licence sentences have identifiers.  The identifiers of a document's
sentences, in their order, are matched against rules: sequences of identifiers
that name a licence.  A rule bounds how many unknown sentences may stand
between two of its own (none at all where one could change the licence).  Names
of holders are slots: a sentence is known whatever stands there.  Short notices
are rules of one identifier and are looked up among the lines as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentences of public licence texts, as they stand there.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "gpl-2-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-classpath": "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules, and to copy and distribute the resulting executable under terms of your choice, provided that you also meet, for each linked independent module, the terms and conditions of the license of that module.",
    "lgpl-2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-2-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "epl-2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "artistic-2-terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "wtfpl-copies": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "cc0-dedicated": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "line-mit": "Released under the MIT License.",
    "line-mit-licensed": "Licensed under the MIT License.",
    "line-mit-spdx": "SPDX-License-Identifier: MIT",
    "line-apache": "Licensed under the Apache License, Version 2.0.",
    "line-apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "line-gpl-2": "This work is licensed under the GNU General Public License, version 2.",
    "line-gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "line-gpl-3-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "line-gpl-2-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "line-bsd-3": "Licensed under the BSD 3-Clause License.",
    "line-bsd-3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "line-bsd-2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "line-mpl-spdx": "SPDX-License-Identifier: MPL-2.0",
    "line-isc-spdx": "SPDX-License-Identifier: ISC",
    "line-cc-by": "Licensed under CC BY 4.0.",
    "line-cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "line-cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "line-cc0": "Released under CC0 1.0.",
}

# Identifiers of the public licence list that notices may name, and the terms of Creative Commons licences.
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0 WITH LLVM-exception", "Artistic-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-or-later", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "Unlicense", "WTFPL", "Zlib",
)
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = {f"line-spdx-{x.lower().replace(' ', '-')}": x for x in IDENTIFIERS}
_COMMONS = {f"line-commons-{k.lower()}-{version}": (f"CC-{k}-{version}", f"This work is licensed under a Creative Commons {terms} {version} International License.") for k, terms in COMMONS.items() for version in ("4.0",)}
SENTENCES |= {k: f"SPDX-License-Identifier: {x}" for k, x in _SPDX.items()} | {k: text for k, (_, text) in _COMMONS.items()}

#: (rule, licence, identifiers in their order)
RULES = [
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("mit-no-notice", "MIT", ("mit-grant", "mit-as-is")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("bsd-3-author-text", "BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse-author", "bsd-as-is")),
    ("bsd-4-text", "BSD-4-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is")),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("isc-text", "ISC", ("isc-grant", "isc-as-is")),
    ("apache-header", "Apache-2.0", ("apache-head", "apache-as-is", "apache-see")),
    ("apache-header-address", "Apache-2.0", ("apache-head", "apache-copy", "apache-as-is")),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-see")),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl-3-free", "gpl-hope", "gpl-see")),
    ("mpl-header", "MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("unlicense-text", "Unlicense", ("unlicense-free",)),
    ("gpl-2-only-header", "GPL-2.0-only", ("gpl-2-only-free", "gpl-hope", "gpl-see")),
    ("gpl-2-classpath-header", "GPL-2.0-or-later WITH Classpath-exception-2.0", ("gpl-2-free", "gpl-hope", "gpl-see", "gpl-classpath")),
    ("gpl-2-only-classpath-header", "GPL-2.0-only WITH Classpath-exception-2.0", ("gpl-2-only-free", "gpl-hope", "gpl-see", "gpl-classpath")),
    ("lgpl-2-header", "LGPL-2.1-or-later", ("lgpl-2-free", "lgpl-2-hope", "lgpl-see")),
    ("lgpl-3-header", "LGPL-3.0-or-later", ("lgpl-3-free", "gpl-hope", "lgpl-see")),
    ("agpl-3-header", "AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope", "agpl-see")),
    ("epl-2-header", "EPL-2.0", ("epl-2-available",)),
    ("epl-1-header", "EPL-1.0", ("epl-1-available",)),
    ("bsl-notice", "BSL-1.0", ("bsl-distributed",)),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant", "zlib-notice")),
    ("zlib-no-restrictions", "Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("0bsd-text", "0BSD", ("0bsd-grant", "isc-as-is")),
    ("artistic-2-text", "Artistic-2.0", ("artistic-2-terms",)),
    ("wtfpl-text", "WTFPL", ("wtfpl-copies",)),
    ("cc0-text", "CC0-1.0", ("cc0-dedicated",)),
    *((name, licence, (name,)) for name, licence in _SPDX.items()),
    *((name, licence, (name,)) for name, (licence, _) in _COMMONS.items()),
    *(
        (name, licence, (name,))
        for name, licence in {
            "line-mit": "MIT", "line-mit-licensed": "MIT", "line-mit-spdx": "MIT", "line-apache": "Apache-2.0", "line-apache-spdx": "Apache-2.0", "line-gpl-2": "GPL-2.0-only",
            "line-gpl-3": "GPL-3.0-only", "line-gpl-3-spdx": "GPL-3.0-or-later", "line-gpl-2-spdx": "GPL-2.0-only", "line-bsd-3": "BSD-3-Clause", "line-bsd-3-spdx": "BSD-3-Clause",
            "line-bsd-2-spdx": "BSD-2-Clause", "line-mpl-spdx": "MPL-2.0", "line-isc-spdx": "ISC", "line-cc-by": "CC-BY-4.0", "line-cc-by-sa": "CC-BY-SA-4.0", "line-cc-by-nc": "CC-BY-NC-4.0", "line-cc0": "CC0-1.0",
        }.items()
    ),
]

#: How many sentences on the next one of a rule may stand: 1 is right behind. An unknown clause would make the second BSD rule another licence.
LEAP = 6
LEAPS = {"bsd-2-text": 1}

#: Sentences with a slot for a holder's name, and the form that SENTENCES has.
SLOTS = (r"^neither the name of [a-z0-9 ]{1,120}? nor the names of (?:[a-z]+ )?contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used")

#: Every rule has a sentence with one of these, so texts without any need no cutting.
KEYWORDS = ("licen", "permi", "softw", "redis", "liabl", "cc0", "cc by")

#: Comment signs and list numbers at a line's start.
_LEAD = r"(?m)^[ \t#/*;%>!<-]*(?:[(]?[0-9a-z]{1,2}[.)][ \t]+)?"
#: A blank line or a line that ends with a colon; a sentence's end before what may start another, a digit or a comment sign included if a word comes before.
_BREAK, _END, _END_OF_WORD = r":?[ \t]*\r?\n[ \t]*\r?\n|:[ \t]*\r?\n", r"([.!?])[ \t\r\n]+([A-Z(*\"])", r"([a-z]{2}[.!?:])[ \t\r\n]+([0-9#/<])"
#: What comes before a list ends a sentence on one line, too.
_END_OF_HEAD = r"((?:met|conditions|restrictions|acknowledgement):)[ \t\r\n]+([A-Z(*\"])"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> str:
    """What Column expressions below make of a sentence."""
    import re

    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).strip(" ")


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def _cut(text: Column) -> Column:
    """(place, line, sentence, rank) of all sentences and lines, normalised; line tells which of the two it is, rank counts those of over three characters."""
    # Lines end at line feeds alone, and loops give nothing back.
    text = F.regexp_replace(text, _LEAD.replace("(?m)", "(?md)").replace("]*(", "]*+(").replace(")?", ")?+"), "")
    whole = F.regexp_replace(text, _BREAK, "\u0001")
    for end in (_END_OF_WORD, _END_OF_HEAD, _END):
        whole = F.regexp_replace(whole, end, "$1\u0001$2")

    def part(c: Column, sep: str, line: bool) -> Column:
        every = F.transform(F.split(c, sep), lambda x, i: F.struct(i.alias("place"), F.regexp_replace(_normal(x), *SLOTS).alias("sentence")))
        return F.transform(F.filter(every, lambda x: F.length(x["sentence"]) > 3), lambda x, i: F.struct(x["place"].alias("place"), F.lit(line).alias("line"), x["sentence"].alias("sentence"), i.alias("rank")))

    return F.concat(part(whole, "\u0001", False), part(text, "\n", True))


def licences(docs: DataFrame) -> DataFrame:
    """A row for every document and rule that matches it: doc_id, licence, rule, n_sentences and place.

    ``place`` is the number, from 0, of the first line (for notices that are a
    line of their own) or else sentence at which the rule's sequence starts.
    Null and empty texts match nothing; rows with a null doc_id are ignored;
    rows that repeat a doc_id are one document, and count once if they are
    equal.  Whole texts count.  Between two sentences of a rule at most LEAP - 1
    unknown ones may stand, or what LEAPS has for the rule.  Other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(normalised(s), k, k.startswith("line-")) for k, s in SENTENCES.items()], "sentence string, name string, line boolean"))
    rules = F.broadcast(spark.createDataFrame([(name, licence, list(ids), ids[0], len(ids), LEAPS.get(name, LEAP)) for name, licence, ids in RULES], "rule string, licence string, ids array<string>, first string, n_sentences long, leap int"))
    some = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(f"(?i){'|'.join(KEYWORDS)}"))
    found = some.select("doc_id", F.explode(_cut(F.col("text"))).alias("s")).select("doc_id", "s.*").join(known.withColumnRenamed("line", "short"), "sentence").filter("short or not line").select("doc_id", "line", "place", "name", "rank").distinct()
    # As many rows as a document has known sentences at different places.
    sequence = found.groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(F.struct("place", "name", "rank"))).alias("seen"))
    near = lambda own: F.forall(F.zip_with(own, F.slice(own, 2, F.greatest(F.size("ids"), F.lit(1))), lambda a, b: b["rank"] - a["rank"]), lambda d: F.coalesce(d <= F.col("leap"), F.lit(True)))
    fits = lambda own: (F.transform(own, lambda x: x["name"]) == F.col("ids")) & near(own)
    at = F.filter(F.sequence(F.lit(0), F.size("seen") - F.size("ids")), lambda k: fits(F.slice("seen", k + 1, F.size("ids"))))
    names = F.array_distinct(F.transform("seen", lambda x: x["name"]))
    starts = sequence.select("doc_id", "line", "seen", F.explode(names).alias("first")).join(rules, "first").filter(F.size("seen") >= F.size("ids"))
    starts = starts.select("doc_id", "line", "licence", "rule", "n_sentences", F.get("seen", F.get(at, F.lit(0)))["place"].cast("long").alias("place")).filter("place is not null")
    first = F.min(F.struct((~F.col("line")).alias("sentence"), "place"))["place"]
    return starts.groupBy("doc_id", "licence", "rule", "n_sentences").agg(first.alias("place"))


def oracle() -> str:
    """SQL for the rows of ``licences`` on a table ``documents``."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({text(normalised(s))}, {text(k)}, {str(k.startswith('line-')).lower()})" for k, s in SENTENCES.items())
    rules = ", ".join(f"({text(n)}, {text(x)}, [{', '.join(map(text, ids))}], {LEAPS.get(n, LEAP)})" for n, x, ids in RULES)
    return f"""
WITH known(sentence, name, line) AS (VALUES {known}), rules(rule, licence, ids, leap) AS (VALUES {rules}),
d AS (SELECT doc_id, regexp_replace(text, '{_LEAD}', '', 'g') AS text FROM documents WHERE text IS NOT NULL),
p AS (
  SELECT doc_id, false AS line, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_BREAK}', chr(1), 'g'), '{_END_OF_WORD}', '\\1' || chr(1) || '\\2', 'g'), '{_END_OF_HEAD}', '\\1' || chr(1) || '\\2', 'g'), '{_END}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM d
  UNION ALL SELECT doc_id, true, string_split(text, chr(10)) FROM d
),
s AS (SELECT doc_id, line, generate_subscripts(parts, 1) - 1 AS place, regexp_replace(trim(regexp_replace(translate(unnest(parts), '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), '{SLOTS[0]}', '{SLOTS[1]}') AS sentence FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS rank FROM s WHERE length(sentence) > 3),
f AS (SELECT DISTINCT doc_id, r.line, place, rank, name FROM r JOIN known ON known.sentence = r.sentence AND (known.line OR NOT r.line)),
n AS (SELECT doc_id, line, place, name, rank, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS k FROM f),
q AS (SELECT doc_id, line, list(name ORDER BY k) AS names, list(place ORDER BY k) AS places, list(rank ORDER BY k) AS ranks FROM n GROUP BY doc_id, line),
m AS (SELECT n.doc_id, n.line, rule, licence, ids, place FROM n JOIN q ON q.doc_id = n.doc_id AND q.line = n.line JOIN rules ON ids[1] = name WHERE names[k : k + len(ids) - 1] = ids AND coalesce(list_bool_and(list_transform(range(1, len(ids)), lambda j: ranks[k + j] - ranks[k + j - 1] <= leap)), true))
SELECT doc_id, licence, rule, CAST(len(any_value(ids)) AS BIGINT) AS n_sentences, CAST(coalesce(min(place) FILTER (line), min(place)) AS BIGINT) AS place FROM m GROUP BY doc_id, licence, rule"""
