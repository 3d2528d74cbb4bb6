"""Licences found by sentence rules, by DataFrame functions only.

A text is cut into sentences; each is normalised (lower case, runs of other characters
than a-z and 0-9 to one space) and looked up among known licence sentences. The identifiers,
with "-" for any other sentence, form the document's sequence. Rules, the longest first,
are ordered identifier sequences; what a rule has matched is not matched again. A line is a
sentence too, unless it is part of a known sentence that is wrapped over lines; bare list
markers are none.
No row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licence notices, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind": "as_is",
    "licensed under the apache license version 2 0": "apache2_ref",
    "licensed under the apache license version 2 0 the license": "apache2_ref",
    "apache license": "apache_title",
    "version 2 0 january 2004": "apache2_version",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_copy",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "this work is licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software": "gpl_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_terms",
    "either version 3 of the license or at your option any later version": "gpl3_later",
    "either version 2 of the license or at your option any later version": "gpl2_later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_terms",
    "licensed under cc by nc 4 0": "ccbync4_ref",
    "licensed under cc by 4 0": "ccby4_ref",
    "licensed under cc by sa 4 0": "ccbysa4_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4_ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4_ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_ref",
    "this is free and unencumbered software released into the public domain": "unlicense_ref",
    "all rights reserved": "reserved",
}
# Ordered rules.
RULES = [
    (("gpl_free", "gpl_terms", "gpl3_later"), "GPL-3.0-or-later"),
    (("gpl_free", "gpl_terms", "gpl2_later"), "GPL-2.0-or-later"),
    (("gpl_free", "lgpl_terms"), "LGPL"),
    (("apache2_ref", "apache2_comply", "apache2_copy"), "Apache-2.0"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("apache_title", "apache2_version"), "Apache-2.0"),
    (("mit_title", "mit_notice", "as_is"), "MIT"),
    (("mit_notice", "as_is"), "MIT"),
    (("mit_title",), "MIT"),
    (("mit_ref",), "MIT"),
    (("apache2_ref",), "Apache-2.0"),
    (("gpl3_ref",), "GPL-3.0"),
    (("gpl2_ref",), "GPL-2.0"),
    (("ccbync4_ref",), "CC-BY-NC-4.0"),
    (("ccby4_ref",), "CC-BY-4.0"),
    (("ccbysa4_ref",), "CC-BY-SA-4.0"),
    (("mpl2_ref",), "MPL-2.0"),
    (("unlicense_ref",), "Unlicense"),
    (("reserved",), "Proprietary"),
]
_LONGEST_FIRST = sorted(RULES, key=lambda r: -len(r[0]))
_CUT = r"[.!?;:][^\p{L}\p{N} \t\r\n]*(?:[ \t\r\n]+|$)|[\r\n|]+"


# The sentences as the published texts have them, besides the short ones above.
_FSF = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
PUBLISHED = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    _FSF.format("", "3"): "gpl3_terms",
    _FSF.format("", "2"): "gpl2_terms",
    _FSF.format("lesser ", "3"): "lgpl_terms",
    _FSF.format("lesser ", "2 1"): "lgpl_terms",
    "this library is free software": "gpl_free",
    _FSF.format("affero ", "3"): "agpl3_terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl_terms",
    "either version 2 1 of the license or at your option any later version": "lgpl21_later",
    "gnu general public license": "gpl_title",
    "gnu lesser general public license": "lgpl_title",
    "gnu affero general public license": "agpl_title",
    "version 3 29 june 2007": "fsf_v3",
    "version 2 june 1991": "fsf_v2",
    "version 2 1 february 1999": "fsf_v21",
    "version 3 19 november 2007": "fsf_affero3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib_origin",
    "the origin of this software must not be misrepresented": "zlib_origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib_altered",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "boost software license version 1 0 august 17th 2003": "bsl_title",
    "distributed under the boost software license version 1 0": "bsl_ref",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advertising",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_ref",
    "mozilla public license version 2 0": "mpl2_title",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_copy",
    "eclipse public license v 2 0": "epl2_title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_ref",
    "creative commons legal code": "cc_code",
    "cc0 1 0 universal": "cc0_title",
    "creative commons attribution 4 0 international public license": "ccby4_title",
    "creative commons attribution sharealike 4 0 international public license": "ccbysa4_title",
    "creative commons attribution noncommercial 4 0 international public license": "ccbync4_title",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_grant",
}
PUBLISHED_RULES = [
    (("gpl_free", "gpl3_terms"), "GPL-3.0-or-later"),
    (("gpl_free", "gpl2_terms"), "GPL-2.0-or-later"),
    (("reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), "BSD-3-Clause"),
    (("reserved", "bsd_grant", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("reserved", "mit_grant", "mit_notice", "as_is"), "MIT"),
    (("mit_grant", "mit_notice", "as_is"), "MIT"),
    (("mit_grant", "mit_notice"), "MIT"),
    (("gpl_free", "agpl3_terms"), "AGPL-3.0-or-later"),
    (("gpl_free", "agpl_terms", "gpl3_later"), "AGPL-3.0-or-later"),
    (("gpl_free", "lgpl_terms", "lgpl21_later"), "LGPL"),
    (("gpl_free", "lgpl_terms", "gpl3_later"), "LGPL"),
    (("gpl_title", "fsf_v3"), "GPL-3.0"),
    (("gpl_title", "fsf_v2"), "GPL-2.0"),
    (("lgpl_title", "fsf_v3"), "LGPL"),
    (("lgpl_title", "fsf_v21"), "LGPL"),
    (("agpl_title", "fsf_affero3"), "AGPL-3.0"),
    (("isc_grant",), "ISC"),
    (("zlib_grant", "zlib_origin"), "Zlib"),
    (("bsl_title",), "BSL-1.0"),
    (("bsl_ref",), "BSL-1.0"),
    (("reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising"), "BSD-4-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising"), "BSD-4-Clause"),
    (("mpl2_ref", "mpl2_copy"), "MPL-2.0"),
    (("mpl2_title",), "MPL-2.0"),
    (("epl2_title",), "EPL-2.0"),
    (("epl2_ref",), "EPL-2.0"),
    (("cc_code", "cc0_title"), "CC0-1.0"),
    (("cc0_title",), "CC0-1.0"),
    (("ccby4_title",), "CC-BY-4.0"),
    (("ccbysa4_title",), "CC-BY-SA-4.0"),
    (("ccbync4_title",), "CC-BY-NC-4.0"),
    (("unlicense_ref", "unlicense_grant"), "Unlicense"),
]
_ALL_LONGEST_FIRST = sorted(RULES + PUBLISHED_RULES, key=lambda r: -len(r[0]))
_ENDS, _LINES = _CUT.rsplit("|[", 1)[0], r"[\r\n|]+"
_MARKER = "^(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})$"
_LISTED = r"^[^\p{L}\p{N}]*(?:[0-9]{1,2}|[A-Za-z]|[ivxIVX]{2,4})\)[ \t]+"
_NAMES = "neither the name of the copyright holder nor the names of its contributors"
#: (pattern over lines, sentence) of every known sentence, the longest first; any holder's name may stand in the third BSD clause.
_WRAPPED = [
    (k.replace(_NAMES, "neither the name of @ nor the names of its contributors").replace(" ", "[ \n]").replace("@", "[a-z0-9 \n]{1,200}?"), k)
    for k in sorted({**SENTENCES, **PUBLISHED}, key=lambda k: -len(k))
]


def sentence_ids(text: Column) -> Column:
    """The identifier, or "-", of each sentence in order; sentences without letters or digits and bare list markers are left out."""
    known = F.create_map(*[F.lit(x) for kv in {**SENTENCES, **PUBLISHED}.items() for x in kv])
    keys = F.array(*[F.struct(F.lit(rf"(?<![^\n])(?:{p})(?![^\n])").alias("p"), F.lit(k).alias("k")) for p, k in _WRAPPED])
    any_key = r"(?<![^\n])(?:" + "|".join(p for p, _ in _WRAPPED) + r")(?![^\n])"
    plain = lambda s: F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, _LISTED, "")), "[^a-z0-9]+", " "))
    lines = F.transform(F.split(text, _ENDS), lambda s: F.when(s.rlike(_LINES), F.array_join(F.filter(F.transform(F.split(s, _LINES), plain), lambda x: x != ""), "\n")).otherwise(plain(s)))
    joined = F.transform(
        lines,
        lambda s: F.when(
            (F.contains(s, F.lit("\n")) | F.startswith(s, F.lit("neither the name of "))) & s.rlike(any_key),
            F.aggregate(keys, s, lambda a, k: F.regexp_replace(a, k["p"], k["k"])),
        ).otherwise(s),
    )
    own = F.filter(F.flatten(F.transform(joined, lambda s: F.split(s, "\n"))), lambda s: (s != "") & ((F.length(s) > 4) | ~s.rlike(_MARKER)))
    return F.transform(own, lambda s: F.coalesce(F.element_at(known, s), F.lit("-")))


def licences(docs: DataFrame) -> DataFrame:
    """Per document: ``n_known`` licence sentences, their ``sentence_ids`` and ``licences``, the last two sorted, without repeats and joined by commas.

    A null or empty text has none. Repeated rows give repeated results; other columns are
    not read. A text of any length is one expression over its sentences.
    """
    rules = F.array(*[F.struct(F.lit(" " + "  ".join(ids) + " ").alias("p"), F.lit(name).alias("l")) for ids, name in _ALL_LONGEST_FIRST])
    ids = docs.select("doc_id", sentence_ids(F.coalesce(F.col("text"), F.lit(""))).alias("ids"))
    joined = ids.select(
        "doc_id",
        F.filter("ids", lambda x: x != "-").alias("known"),
        F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("seq"),
    )
    start = F.struct(F.col("seq").alias("s"), F.array().cast("array<string>").alias("f"))
    step = lambda a, r: F.struct(
        F.replace(a["s"], r["p"], F.lit(" # ")).alias("s"),
        F.when(F.contains(a["s"], r["p"]), F.concat(a["f"], F.array(r["l"]))).otherwise(a["f"]).alias("f"),
    )
    found = F.when(F.size("known") > 0, F.aggregate(rules, start, step, lambda a: a["f"])).otherwise(F.array().cast("array<string>"))
    tidy = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return joined.select(
        "doc_id", F.size("known").cast("long").alias("n_known"), tidy(F.col("known")).alias("sentence_ids"), tidy(found).alias("licences")
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    """The law over a list of lines: a doubled line break stands between two, so that each has an end of its own for the next pattern."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in {**SENTENCES, **PUBLISHED}.items())
    plain = lambda x: rf"trim(regexp_replace(lower(regexp_replace({x}, '{_LISTED}', '')), '[^a-z0-9]+', ' ', 'g'))"
    spread = lambda k: k.replace(_NAMES, "neither the name of @ nor the names of its contributors").replace(" ", r"(?: |\n\n)").replace("@", r"(?:[a-z0-9 ]|\n\n){1,200}?")
    longest = sorted({**SENTENCES, **PUBLISHED}, key=lambda k: -len(k))
    found = "s"
    for k in longest:
        found = rf"regexp_replace({found}, '(^|\n)(?:{spread(k)})(\n|$)', '\1{k}\2', 'g')"
    any_key = rf"(?:^|\n)(?:{'|'.join(map(spread, longest))})(?:\n|$)"
    steps, last = [], "q0"
    for i, (ids, name) in enumerate(_ALL_LONGEST_FIRST):
        p = quoted(" " + "  ".join(ids) + " ")
        steps.append(f"q{i + 1} AS (SELECT doc_id, known, replace(seq, {p}, ' # ') AS seq, CASE WHEN contains(seq, {p}) THEN list_append(f, {quoted(name)}) ELSE f END AS f FROM {last})")
        last = f"q{i + 1}"
    return rf"""
WITH k(s, id) AS (VALUES {known}),
km AS (SELECT map_from_entries(list({{'k': s, 'v': id}})) AS m FROM k),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(coalesce(text, ''), '{_ENDS}') AS parts FROM documents),
e AS (SELECT r, doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS nr FROM d),
l AS (SELECT r, doc_id, nr, array_to_string(list_filter(list_transform(regexp_split_to_array(s, '{_LINES}'), lambda x: {plain('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS s FROM e),
w AS (
  SELECT r, doc_id, nr, regexp_split_to_array(CASE WHEN (contains(s, chr(10)) OR starts_with(s, 'neither the name of ')) AND regexp_matches(s, '{any_key}')
    THEN {found} ELSE s END, '\n\n') AS lines FROM l),
i AS (
  SELECT doc_id, list_transform(list_filter(flatten(list(lines ORDER BY nr)), lambda x: x <> '' AND (length(x) > 4 OR NOT regexp_matches(x, '{_MARKER}'))), lambda x: coalesce(any_value(m)[x], '-')) AS ids
  FROM w, km GROUP BY r, doc_id),
q0 AS (SELECT doc_id, list_filter(ids, lambda x: x <> '-') AS known, ' ' || array_to_string(ids, '  ') || ' ' AS seq, CAST([] AS VARCHAR[]) AS f FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(known) AS BIGINT) AS n_known,
  coalesce(array_to_string(list_sort(list_distinct(known)), ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(f)), ','), '') AS licences
FROM {last}
"""


SQL = _sql()
