"""Licence scan by sentence rules, in DataFrame operations only.

A text is cut into sentences (at ``.``, ``!``, ``?``, ``;`` or ``:`` before white
space, and at empty lines); a sentence is also tried line by line, since notices
often stand on a line of their own after a line without a full stop. Each is
normalised (lower case, runs of anything but ASCII letters and digits become one
space) and looked up among the known licence sentences. The identifiers found,
in text order, form a document's sequence; copyright notices are noted but do
not interrupt it. Ordered rules, longer ones first, take runs of identifiers out
of the sequence and name the licence; identifiers that no rule takes are
reported as unmatched.

The catalogue is fixed and small, so it is broadcast. Only recognised sentences
are shuffled.

Defined results: null or empty text has no sentence and no licence; repeated
rows (equal id and text) give equal results; null ids are kept; a licence named
several times is listed once; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, as written there.
SENTENCES: list[tuple[str, str]] = [
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions"),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software"),
    ("MitWarranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("MitLiability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("MitName", "Released under the MIT License"),
    ("MitName", "Licensed under the MIT License"),
    ("MitName", "This project is licensed under the MIT License"),
    ("MitName", "SPDX-License-Identifier: MIT"),
    ("ApacheName", "Licensed under the Apache License, Version 2.0"),
    ("ApacheName", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("ApacheName", "SPDX-License-Identifier: Apache-2.0"),
    ("ApacheComply", "you may not use this file except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at"),
    ("ApacheLink", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheWarranty", "Unless required by applicable law or agreed to in writing, software distributed under the "
     "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
     "implied"),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("Gpl3Name", "This work is licensed under the GNU General Public License, version 3"),
    ("Gpl3Name", "Licensed under the GNU General Public License, version 3"),
    ("Gpl3Name", "SPDX-License-Identifier: GPL-3.0-only"),
    ("Gpl2Name", "This work is licensed under the GNU General Public License, version 2"),
    ("Gpl2Name", "Licensed under the GNU General Public License, version 2"),
    ("Gpl2Name", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GplFree", "This program is free software"),
    ("Gpl3Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version"),
    ("Gpl2Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
     "version"),
    ("GplHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GplFitness", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GplSee", "See the GNU General Public License for more details"),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and "
     "the following disclaimer"),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
     "and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission"),
    ("BsdName", "Released under the BSD License"),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MplName", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CcByNcName", "Licensed under CC BY-NC 4.0"),
    ("CcByName", "Licensed under CC BY 4.0"),
    ("CcBySaName", "Licensed under CC BY-SA 4.0"),
    ("CcZeroName", "This work is released under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Reserved", "All rights reserved"),
]
#: Licence rules, each an ordered run of sentence identifiers.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty")),
    ("Apache-2.0", ("ApacheName", "ApacheComply", "ApacheCopy", "ApacheLink", "ApacheWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheName", "ApacheComply", "ApacheCopy", "ApacheWarranty", "ApacheSee")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Later", "GplHope", "GplFitness", "GplSee")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Later", "GplHope", "GplFitness", "GplSee")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Later")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Later")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("ApacheName",)),
    ("MIT", ("MitName",)),
    ("GPL-3.0-only", ("Gpl3Name",)),
    ("GPL-2.0-only", ("Gpl2Name",)),
    ("BSD", ("BsdName",)),
    ("ISC", ("IscGrant",)),
    ("MPL-2.0", ("MplName",)),
    ("CC-BY-NC-4.0", ("CcByNcName",)),
    ("CC-BY-4.0", ("CcByName",)),
    ("CC-BY-SA-4.0", ("CcBySaName",)),
    ("CC0-1.0", ("CcZeroName",)),
    ("Unlicense", ("Unlicense",)),
    ("Proprietary", ("Reserved",)),
]

SENTENCE_END = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
_OTHER = "[^a-z0-9]+"


def normalise(text: str) -> str:
    return re.sub(_OTHER, " ", text.lower()).strip()


def catalogue() -> list[tuple[str, str]]:
    """``(normal form, identifier)``, once per normal form; a sentence that holds an end mark is cut there."""
    out: dict[str, str] = {}
    for name, text in SENTENCES:
        parts = [normalise(p) for p in re.split(SENTENCE_END, text)]
        out.setdefault(parts[-1] if len(parts) > 1 else parts[0], name)
    return sorted(out.items())


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """Longer rules first; among equals the given order."""
    return sorted(RULES, key=lambda r: -len(r[1]))


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), _OTHER, " "))


def sentence_hits(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, at, line, identifier)``: recognised sentences; line 0 is the whole sentence."""
    known = docs.sparkSession.createDataFrame(catalogue(), "normal string, identifier string")
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
                    F.posexplode(F.split("text", SENTENCE_END)).alias("at", "sentence"))
    parts = F.when(F.instr("sentence", "\n") > 0,
                   F.concat(F.array("sentence"), F.split("sentence", "\n"))).otherwise(F.array("sentence"))
    s = s.select("doc_id", "h", "at", F.posexplode(parts).alias("line", "part"))
    s = s.where(F.length(F.trim("part")) >= 3).withColumn("normal", _normal(F.col("part")))
    marked = F.col("normal").rlike("^(copyright|c) (c )?[0-9]{4}\\b|^copyright c ")
    hit = s.join(F.broadcast(known), "normal", "left").withColumn(
        "identifier", F.coalesce("identifier", F.when(marked, F.lit("Copyright"))))
    return hit.where("identifier is not null").select("doc_id", "h", "at", "line", "identifier")


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, licenses, sentences, copyrights, unmatched)`` per row of ``docs``; lists are comma-separated."""
    hits = (sentence_hits(docs).groupBy("doc_id", "h")
            # repeated rows find the same sentences at the same places
            .agg(F.array_sort(F.collect_set(F.struct("at", "line", "identifier"))).alias("seq")))
    names = F.filter(F.transform("seq", lambda x: x["identifier"]), lambda x: x != "Copyright")
    # every identifier stands between commas of its own, so equal neighbours can be taken out one by one
    sequence = F.concat(F.lit(","), F.array_join(names, ",,"), F.lit(","))
    r = hits.select("doc_id", "h", F.size(names).cast("long").alias("sentences"),
                    F.size(F.filter("seq", lambda x: x["identifier"] == "Copyright")).cast("long").alias("copyrights"),
                    sequence.alias("rest"), F.array().cast("array<string>").alias("licenses"))
    for name, ids in rules():
        run = "," + ",,".join(ids) + ","
        r = r.select("doc_id", "h", "sentences", "copyrights",
                     F.replace("rest", F.lit(run), F.lit("")).alias("rest"),
                     F.when(F.instr("rest", run) > 0, F.array_union("licenses", F.array(F.lit(name))))
                     .otherwise(F.col("licenses")).alias("licenses"))
    r = r.select(F.col("doc_id").alias("d"), F.col("h").alias("x"), "sentences", "copyrights",
                 F.array_join(F.array_sort("licenses"), ",").alias("licenses"),
                 F.trim(F.regexp_replace("rest", ",+", " ")).alias("unmatched"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    out = keys.join(r, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")), "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"),
                      F.coalesce("sentences", none).alias("sentences"),
                      F.coalesce("copyrights", none).alias("copyrights"),
                      F.coalesce("unmatched", F.lit("")).alias("unmatched"))


def oracle() -> str:
    """The same scan of ``documents`` as one DuckDB statement."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    known = ", ".join(f"({quote(t)}, {quote(i)})" for t, i in catalogue())
    end, space = quote(SENTENCE_END.replace(r"\n", "\n")), quote(" ")
    rest, found = "rest0", []
    steps = []
    for n, (name, ids) in enumerate(rules()):
        run = quote("," + ",,".join(ids) + ",")
        found.append(f"CASE WHEN contains(rest{n}, {run}) THEN {quote(name)} END")
        steps.append(f"s{n + 1} AS (SELECT *, replace(rest{n}, {run}, '') AS rest{n + 1} FROM s{n})")
    last = len(rules())
    return f"""
WITH known(normal, identifier) AS (VALUES {known}),
a AS (SELECT doc_id, unnest(regexp_split_to_array(text, {end})) AS sentence,
             generate_subscripts(regexp_split_to_array(text, {end}), 1) AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, pos, CASE WHEN contains(sentence, chr(10))
             THEN list_concat([sentence], string_split(sentence, chr(10))) ELSE [sentence] END AS parts FROM a),
c AS (SELECT doc_id, pos, unnest(parts) AS part, generate_subscripts(parts, 1) AS line_no FROM b),
d AS (SELECT doc_id, pos, line_no, trim(regexp_replace(lower(part), '{_OTHER}', {space}, 'g'), ' ') AS normal FROM c
      WHERE length(trim(part, ' ')) >= 3),
e AS (SELECT DISTINCT doc_id, pos, line_no, coalesce(identifier,
             CASE WHEN regexp_matches(normal, '^(copyright|c) (c )?[0-9]{{4}}\\b|^copyright c ') THEN 'Copyright' END)
             AS identifier FROM d LEFT JOIN known USING (normal)),
s0 AS (SELECT doc_id, count(*) FILTER (identifier <> 'Copyright') AS sentences,
              count(*) FILTER (identifier = 'Copyright') AS copyrights,
              ',' || coalesce(string_agg(identifier, ',,' ORDER BY pos, line_no) FILTER (identifier <> 'Copyright'), '')
              || ',' AS {rest}
       FROM e WHERE identifier IS NOT NULL GROUP BY doc_id),
{", ".join(steps)},
r AS (SELECT doc_id, sentences, copyrights,
             list_sort(list_distinct(list_filter([{", ".join(found)}], lambda x: x IS NOT NULL))) AS licenses,
             trim(regexp_replace(rest{last}, ',+', ' ', 'g'), ' ') AS unmatched FROM s{last})
SELECT d.doc_id, coalesce(array_to_string(r.licenses, ','), '') AS licenses,
       CAST(coalesce(r.sentences, 0) AS BIGINT) AS sentences, CAST(coalesce(r.copyrights, 0) AS BIGINT) AS copyrights,
       coalesce(r.unmatched, '') AS unmatched
FROM documents d LEFT JOIN r USING (doc_id)
"""
