"""Licence scans by sentence-rule recognition.

Text is cut into sentences, each sentence is normalised (ASCII lower case;
everything but letters and digits is one blank) and looked up among known
licence sentences; ordered rules over the identifier sequence then name the
licences. A rule needs its identifiers next to each other; what it matches is
used up, so later and more general rules don't see it again. All of it is
expressions over one row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import let, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Licence sentences and their identifiers.
SENTENCES = (
    ("ApacheLicensed", "Licensed under the Apache License, Version 2.0"),
    ("ApacheLicensedYou", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("ApacheNoUse", "you may not use this file except in compliance with the License"),
    ("ApacheHeader", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("MitReleased", "Released under the MIT License"),
    ("MitReleased", "Licensed under the MIT License"),
    ("MitReleased", "This project is licensed under the MIT License"),
    ("MitTitle", "MIT License"),
    ("MitTitle", "The MIT License"),
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MitGrantOnly", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MitWarranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BsdRedistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdStyle", "Licensed under the BSD 3-Clause License"),
    ("GplThree", "This work is licensed under the GNU General Public License, version 3"),
    ("GplThree", "This program is licensed under the GNU General Public License, version 3"),
    ("GplTwo", "This work is licensed under the GNU General Public License, version 2"),
    ("GplFree", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GplFreeTwo", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LgplFree", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("GplHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GplSee", "See the GNU General Public License for more details"),
    ("MplForm", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CcByNc", "Licensed under CC BY-NC 4.0"),
    ("CcBy", "Licensed under CC BY 4.0"),
    ("CcBySa", "Licensed under CC BY-SA 4.0"),
    ("CcByAttribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CcZero", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 license"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("RightsReserved", "All rights reserved"),
    ("AgplFree", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AgplSee", "See the GNU Affero General Public License for more details"),
    ("LgplFreeThree", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LgplFreeThree", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LgplSee", "See the GNU Lesser General Public License for more details"),
    ("EplTwo", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EplOne", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Boost", "Distributed under the Boost Software License, Version 1.0"),
)
# Identifiers that a line "SPDX-License-Identifier: ..." may name.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
        "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
        "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1",
        "PostgreSQL", "Unlicense", "WTFPL", "Zlib")
SENTENCES += tuple((f"Spdx:{i}", f"SPDX-License-Identifier: {i}") for i in SPDX)

# Rules over identifiers, the most specific first.
RULES = (
    ("Apache-2.0", ("ApacheHeader", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheHeader", "ApacheCopy")),
    ("Apache-2.0", ("ApacheHeader",)),
    ("Apache-2.0", ("ApacheLicensedYou", "ApacheNoUse")),
    ("Apache-2.0", ("ApacheLicensedYou",)),
    ("Apache-2.0", ("ApacheLicensed",)),
    ("MIT", ("MitTitle", "MitGrant", "MitWarranty")),
    ("MIT", ("MitGrantOnly", "MitNotice", "MitWarranty")),
    ("MIT", ("MitGrant", "MitWarranty")),
    ("MIT", ("MitGrantOnly", "MitNotice")),
    ("MIT", ("MitReleased",)),
    ("MIT", ("MitTitle",)),
    ("ISC", ("IscGrant",)),
    ("BSD-3-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary")),
    ("BSD-3-Clause", ("BsdStyle",)),
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplSee")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("GPL-3.0", ("GplThree",)),
    ("GPL-2.0-or-later", ("GplFreeTwo", "GplHope", "GplSee")),
    ("GPL-2.0-or-later", ("GplFreeTwo",)),
    ("GPL-2.0", ("GplTwo",)),
    ("LGPL-2.1-or-later", ("LgplFree",)),
    ("MPL-2.0", ("MplForm",)),
    ("CC-BY-NC-4.0", ("CcByNc",)),
    ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC-BY-4.0", ("CcBy",)),
    ("CC-BY-4.0", ("CcByAttribution",)),
    ("CC0-1.0", ("CcZero",)),
    ("Unlicense", ("Unlicense",)),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope", "AgplSee")),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("LGPL-3.0-or-later", ("LgplFreeThree", "GplHope", "LgplSee")),
    ("LGPL-3.0-or-later", ("LgplFreeThree",)),
    ("EPL-2.0", ("EplTwo",)),
    ("EPL-1.0", ("EplOne",)),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("Boost",)),
    *((i, (f"Spdx:{i}",)) for i in SPDX),
    ("All-rights-reserved", ("RightsReserved",)),
)

#: Every known sentence holds one of these, so texts without any hold none (tested).
CUE = r"(?i)licen[sc]e|permission|redistribution|copyright|warranty|reserved|domain"
#: Not after the "v." of a version number; a run of marks is tried at its start only.
SENTENCE_END = r"(?<![.!?])(?!(?<=\b[vV])\.[ \t\r\n*]+[0-9])[.!?]++[ \t\r\n]++|\n[ \t\r]*+\n"
#: A line's comment mark ("!" would end a sentence, REM is a word).
COMMENT = r"(?md)^([ \t]*)(?:[#*;%!/>'\"|<-]+|@?(?:REM|rem)|dnl)(?=[ \t\r]|$)"
#: The number of a list's item, at the start of a line or after another item.
LIST_MARK = r"(?md)(^[ \t*]*|[:;.][ \t]+)\(?([0-9]{1,2}|[A-Za-z]|[ivx]{2,4})[.)][ \t]+"
#: Possessive, as every loop over a group here: a greedy one would nest a call for each turn.
ONLY_MARKS = r"(?:\n(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})(?=\n|\z))*+\n*+"
UNKNOWN = "-"


def normalise(sentence: str) -> str:
    """The rule of :func:`normalised` for the fixed sentences."""
    lower = sentence.translate(str.maketrans(UPPER, LOWER))
    return re.sub(r"[^a-z0-9]+", " ", lower).strip(" ")


KNOWN = {normalise(text): name for name, text in SENTENCES}
#: Known sentences that take up whole lines of a normalised block, the longest first.
RUN = r"\n(?:" + "|".join(k.replace(" ", r"[ \n]") for k in sorted(KNOWN, key=len, reverse=True)) + r")(?=\n)"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def normalised_lines(block: Column) -> Column:
    """Each line normalised, between line ends; lines without a word are left out."""
    kept = F.regexp_replace(F.translate(block, UPPER, LOWER), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), kept, F.lit("\n")), "[ \n]*\n[ \n]*", "\n")


def sentence_identifiers(text: Column) -> Column:
    """One identifier per sentence, UNKNOWN for others. Sentences may be wrapped
    over lines, with comment marks; in a stretch of lines that isn't known as a
    whole every run of lines is looked up, so a heading without a full stop is a
    sentence too. The numbers of a list are no sentences."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    none = F.array().cast("array<string>")

    def name(sentence: Column) -> Column:
        return F.coalesce(F.get(F.array(F.element_at(known, normalised(sentence))), F.lit(0)), F.lit(UNKNOWN))

    def of_runs(lines: Column) -> Column:
        return let(F.regexp_extract_all(lines, F.lit(RUN), F.lit(0)), lambda found: F.flatten(F.transform(F.split(lines, RUN, -1), lambda other, i: F.concat(
            F.when(other.rlike(rf"\A{ONLY_MARKS}\z"), none).otherwise(F.array(F.lit(UNKNOWN))),
            F.when(i < F.size(found), F.array(name(F.get(found, i)))).otherwise(none)))))

    def of_block(block: Column) -> Column:
        return let(name(block), lambda whole: F.when((whole != UNKNOWN) | ~F.contains(block, F.lit("\n")), F.array(whole))
                   .otherwise(let(normalised_lines(block), of_runs)))

    marked = F.regexp_replace(F.regexp_replace(text, COMMENT, "$1*"), LIST_MARK, "$1*\n$2\n")
    return F.flatten(F.transform(F.split(marked, SENTENCE_END, -1), of_block))


def scan_licenses(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licenses, n_unmatched) per row.

    sentence_ids: the identifier sequence, each run of unknown sentences as one
    ``-``, for example ``[-][MitReleased]``. licenses: comma-separated, in
    the order of the rules, each once. n_unmatched: known sentences that no rule
    used. Null and empty texts, and texts without a known sentence, have empty
    strings and zeros. Time is linear in a text, whatever its script. Repeated
    rows repeat; an empty table gives no rows; other columns are ignored.
    """
    text = text_of(docs)
    joined = F.concat(F.lit("["), F.array_join(sentence_identifiers(text), "]["), F.lit("]"))
    sequence = F.regexp_replace(joined, r"(?:\[-\])++", "[-]")
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.when(text.rlike(CUE), sequence).otherwise(F.lit("")).alias("seq"))
    found = found.select("doc_id", F.when(F.col("seq").rlike(r"\[[^-]"), F.col("seq")).otherwise(F.lit("")).alias("seq"))
    # Rule after rule: note the hit, use up what it matched.
    state = F.struct(F.col("seq").alias("rest"), F.array().cast("array<string>").alias("hits"))
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"[{i}]" for i in ids)).alias("ids")) for licence, ids in rules])
    folded = F.aggregate(table, state, lambda acc, r: F.struct(
        F.replace(acc["rest"], r["ids"], F.lit("[+]")).alias("rest"),
        F.when(F.contains(acc["rest"], r["ids"]), F.array_union(acc["hits"], F.array(r["licence"]))).otherwise(acc["hits"]).alias("hits")))
    matched = found.select("doc_id", "seq", F.when(F.col("seq") != "", folded).alias("m"))
    return matched.select(
        "doc_id", _names(F.col("seq")).alias("n_known"), F.col("seq").alias("sentence_ids"),
        F.coalesce(F.array_join("m.hits", ","), F.lit("")).alias("licenses"),
        F.coalesce(_names(F.col("m.rest")), F.lit(0)).cast("long").alias("n_unmatched"))


def _names(sequence: Column) -> Column:
    """How many identifiers a sequence holds, besides UNKNOWN and used ones."""
    left = F.regexp_replace(sequence, r"\[[-+]\]", "")
    return (F.length(left) - F.length(F.replace(left, F.lit("["), F.lit("")))).cast("long")
