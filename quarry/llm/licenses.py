"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, at end marks and blank lines, so that a sentence may be wrapped
over lines (and comment signs); the dot of "Inc." and the like is none. Each sentence is
normalised (lower case, every run of other characters than a-z and 0-9 one blank) and looked up
among known licence sentences; if it is none of them, its lines are looked up one by one, and if
they are none either, a phrase that names a licence is looked for in it, unless it says "not".
The sequence of identifiers found is then matched against ordered rules, each a sequence of
identifiers that must follow one another. The first rule that matches is the document's
licence, all that match are listed. The identifiers that a machine-readable tag gives count as
rules of their own, before all others; the title of a whole licence comes before the notices in it.

Null and empty texts have no sentences and no licence. Repeated rows each get a row; very long
texts are taken whole; an empty table gives an empty result; other columns are ignored.
There is no shuffle: every row is decided by itself. The SQL twin does the same with the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences, in normalised form.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license": "apache-2",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-v3-later",
    "either version 2 of the license or at your option any later version": "gpl-v2-later",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
}
# Rules in order, the first that matches names the licence.
RULES: list[tuple[str, str]] = [
    ("GPL-3.0-or-later", "gpl-free gpl-terms gpl-v3-later"),
    ("GPL-2.0-or-later", "gpl-free gpl-terms gpl-v2-later"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("MIT", "mit-grant mit-notice"),
    ("Apache-2.0", "apache-2 apache-comply apache-copy"),
    ("Apache-2.0", "apache-2"),
    ("MIT", "mit"),
    ("GPL-3.0", "gpl-3"),
    ("GPL-2.0", "gpl-2"),
    ("CC-BY-NC-4.0", "cc-by-nc-4"),
    ("CC-BY-SA-4.0", "cc-by-sa-4"),
    ("CC-BY-4.0", "cc-by-4"),
]
_TERMS = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_LESSER = _TERMS.replace("general", "lesser general")
_AFFERO = _TERMS.replace("general", "affero general")
_CC = "this work is licensed under a creative commons attribution {} 4 0 international license"
# Sentences as the whole notices have them, besides SENTENCES.
WHOLE_SENTENCES: dict[str, str] = {
    "this library is free software": "gpl-free",
    _LESSER: "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "gpl-v21-later",
    f"{_LESSER} either version 2 1 of the license or at your option any later version": "lgpl-terms-v21-later",
    f"{_LESSER} either version 3 of the license or at your option any later version": "lgpl-terms-v3-later",
    _AFFERO: "agpl-terms",
    f"{_AFFERO} either version 3 of the license or at your option any later version": "agpl-terms-v3-later",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation": "gfdl-13",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-0-grant",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl-subject",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl-1",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-copies",
    "this font software is licensed under the sil open font license version 1 1": "ofl-11",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "licensed under the bsd 2 clause license": "bsd-2",
    "licensed under the bsd 3 clause license": "bsd-3",
    "licensed under the isc license": "isc",
    "licensed under the mozilla public license 2 0": "mpl-2",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "licensed under the gnu lesser general public license version 3": "lgpl-3",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "licensed under the eupl": "eupl",
    _CC.format("sharealike"): "cc-by-sa-4",
    _CC.format("noncommercial"): "cc-by-nc-4",
    _CC.format("noderivatives"): "cc-by-nd-4",
    _CC.format("noncommercial sharealike"): "cc-by-nc-sa-4",
    _CC.format("noncommercial noderivatives"): "cc-by-nc-nd-4",
    f"{_TERMS} either version 3 of the license or at your option any later version": "gpl-terms-v3-later",
    f"{_TERMS} either version 2 of the license or at your option any later version": "gpl-terms-v2-later",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
}
# Rules for them, before those of RULES.
WHOLE_RULES: list[tuple[str, str]] = [
    ("GPL-3.0-or-later", "gpl-free gpl-terms-v3-later"),
    ("GPL-2.0-or-later", "gpl-free gpl-terms-v2-later"),
    ("LGPL-3.0-or-later", "gpl-free lgpl-terms-v3-later"),
    ("LGPL-3.0-or-later", "gpl-free lgpl-terms gpl-v3-later"),
    ("LGPL-2.1-or-later", "gpl-free lgpl-terms-v21-later"),
    ("LGPL-2.1-or-later", "gpl-free lgpl-terms gpl-v21-later"),
    ("AGPL-3.0-or-later", "gpl-free agpl-terms-v3-later"),
    ("AGPL-3.0-or-later", "gpl-free agpl-terms gpl-v3-later"),
    ("GFDL-1.3-or-later", "gfdl-13"),
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advert"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names"),
    ("MPL-2.0", "mpl-subject mpl-2-copy"),
    ("EPL-2.0", "epl-2"),
    ("CDDL-1.0", "cddl-subject"),
    ("ISC", "isc-grant"),
    ("0BSD", "0bsd-grant"),
    ("MIT-0", "mit-0-grant"),
    ("PostgreSQL", "postgresql-grant"),
    ("Unlicense", "unlicense"),
    ("Zlib", "zlib-grant"),
    ("BSL-1.0", "bsl-1"),
    ("CC0-1.0", "cc0-dedication"),
    ("WTFPL", "wtfpl-copies"),
    ("OFL-1.1", "ofl-11"),
    ("BSD-2-Clause", "bsd-2"),
    ("BSD-3-Clause", "bsd-3"),
    ("ISC", "isc"),
    ("MPL-2.0", "mpl-2"),
    ("LGPL-3.0", "lgpl-3"),
    ("AGPL-3.0", "agpl-3"),
    ("EUPL-1.2", "eupl"),
    ("CC-BY-ND-4.0", "cc-by-nd-4"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-4"),
    ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-4"),
]
# Titles of whole licences, and one more notice.
TITLES: dict[str, str] = {
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2-1-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "gnu free documentation license version 1 3 3 november 2008": "gfdl-13-title",
    "apache license version 2 0 january 2004": "apache-2-title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache-2-title",
    "apache license version 2 0 january 2004 https www apache org licenses": "apache-2-title",
    "mozilla public license version 2 0": "mpl-2-title",
    "eclipse public license v 2 0": "epl-2-title",
    "boost software license version 1 0 august 17th 2003": "bsl-1",
    "sil open font license version 1 1 26 february 2007": "ofl-11",
    "creative commons attribution 4 0 international public license": "cc-by-4",
    "creative commons attribution sharealike 4 0 international public license": "cc-by-sa-4",
    "creative commons attribution noncommercial 4 0 international public license": "cc-by-nc-4",
    "creative commons attribution noderivatives 4 0 international public license": "cc-by-nd-4",
    "cc0 1 0 universal": "cc0-dedication",
    "mit license": "mit",
    "the mit license": "mit",
    "the mit license mit": "mit",
    "isc license": "isc",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache-2",
}
# Rules for titles, before all others.
TITLE_RULES: list[tuple[str, str]] = [
    ("GPL-3.0", "gpl-3-title"), ("GPL-2.0", "gpl-2-title"), ("LGPL-3.0", "lgpl-3-title"), ("LGPL-2.1", "lgpl-2-1-title"), ("AGPL-3.0", "agpl-3-title"),
    ("GFDL-1.3", "gfdl-13-title"), ("Apache-2.0", "apache-2-title"), ("MPL-2.0", "mpl-2-title"), ("EPL-2.0", "epl-2-title"),
]
# Phrases that name a licence within a sentence, the more special ones first.
PHRASES: list[tuple[str, str]] = [
    ("gnu lesser general public license version 3", "lgpl-3"), ("gnu lesser general public license v3", "lgpl-3"), ("gnu affero general public license version 3", "agpl-3"),
    ("gnu general public license version 3", "gpl-3"), ("gnu general public license v3", "gpl-3"), ("gpl version 3", "gpl-3"), ("gpl v3", "gpl-3"), ("gplv3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"), ("gnu general public license v2", "gpl-2"), ("gpl version 2", "gpl-2"), ("gpl v2", "gpl-2"), ("gplv2", "gpl-2"),
    ("under the apache license version 2 0", "apache-2"), ("under the apache license 2 0", "apache-2"), ("under the apache 2 0 license", "apache-2"), ("under apache 2 0", "apache-2"),
    ("under the mit license", "mit"), ("under the terms of the mit license", "mit"), ("under an mit license", "mit"), ("under mit license", "mit"), ("license mit", "mit"),
    ("under the bsd 3 clause license", "bsd-3"), ("under the bsd 2 clause license", "bsd-2"), ("governed by a bsd style license", "bsd-style"), ("under the isc license", "isc"),
    ("under the mozilla public license version 2 0", "mpl-2"), ("under the mozilla public license 2 0", "mpl-2"), ("under the unlicense", "unlicense"), ("under cc0", "cc0-dedication"),
]
PHRASE_RULES: list[tuple[str, str]] = [("BSD-style", "bsd-style")]
#: A machine-readable tag and the expression behind it; what parts the identifiers of one.
TAG, TAG_PARTS = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)", r"[() ]+"
#: Ends of sentences: marks, and lines without a letter or digit; abbreviations whose dot ends none.
SENTENCE_END = r"[.!?;:]+[ \t\n\f\r]+|\n[^A-Za-z0-9\n]*\n"
ABBREVIATION = r"(?i)\b(inc|ltd|co|corp|llc|e\.g|i\.e)\."
#: Every known sentence has one of these; other texts are not cut up. Line ends may come in between.
SIGN = "(?i)licen[sc]e|redistribut|permission|free[^a-z0-9]+software|later[^a-z0-9]+version|version [0-9.]+ of the|public[^a-z0-9]+domain|advertising[^a-z0-9]+materials|copy of the mpl|gpl|under[^a-z0-9]+(apache|cc0)|cc0 1"
#: Whoever is named there.
NAMES = "^neither the name of .+ nor the names of its contributors may"


ALL_SENTENCES = SENTENCES | WHOLE_SENTENCES | TITLES
ALL_RULES = TITLE_RULES + WHOLE_RULES + RULES + PHRASE_RULES


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in text order."""
    known = F.create_map(*[F.lit(x) for pair in ALL_SENTENCES.items() for x in pair])

    def plain(part: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(part), "[^a-z0-9]+", " "))

    def look_up(part: Column) -> Column:
        return F.try_element_at(known, F.regexp_replace(plain(part), NAMES, "neither the name of the copyright holder nor the names of its contributors may"))

    def named(part: Column) -> Column:
        padded = F.concat(F.lit(" "), plain(part), F.lit(" "))
        first = F.coalesce(*[F.when(padded.contains(f" {phrase} "), F.lit(name)) for phrase, name in PHRASES])
        return F.when(~padded.contains(" not "), first)

    def ids(part: Column) -> Column:
        lines = F.filter(F.transform(F.split(part, "\n"), look_up), lambda x: x.isNotNull())
        return F.when(look_up(part).isNotNull(), F.array(look_up(part))).when(F.size(lines) > 0, lines).otherwise(F.array(named(part)))

    whole = F.regexp_replace(text, ABBREVIATION, "$1")
    found = F.flatten(F.transform(F.filter(F.split(whole, SENTENCE_END), lambda s: s.rlike(SIGN)), ids))
    return F.when(text.rlike(SIGN), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def tags(text: Column) -> Column:
    """The licences that the tags of a text name, in text order."""
    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda t: F.split(t, TAG_PARTS)))
    return F.filter(words, lambda w: ~w.isin("", "OR", "AND", "WITH", "-") & ~w.rlike("exception"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, licenses, sentence_ids, n_sentences): license is null where no rule matches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(text).alias("ids"), tags(text).alias("tags"))
    sequence = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    hits = [F.when(sequence.contains(f" {rule} "), F.lit(name)) for name, rule in ALL_RULES]
    matched = F.array_distinct(F.concat("tags", F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return found.select(
        "doc_id",
        F.coalesce(F.get("tags", F.lit(0)), *hits).alias("license"),
        F.array_join(matched, ",").alias("licenses"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.size("ids").alias("n_sentences"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import table

    return scan(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    known = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in ALL_SENTENCES.items()) + "}"
    cases = ", ".join(f"CASE WHEN contains(seq, ' {rule} ') THEN '{name}' END" for name, rule in ALL_RULES)
    phrase = "CASE WHEN contains(p, ' not ') THEN NULL " + " ".join(f"WHEN contains(p, ' {x} ') THEN '{name}'" for x, name in PHRASES) + " END"
    plain = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    sign = SIGN.replace("'", "''")
    return f"""
WITH k AS (SELECT {known} AS known),
s AS (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '{ABBREVIATION}', '\\1', 'g'), '{SENTENCE_END}')) AS part,
  unnest(range(len(string_split_regex(regexp_replace(coalesce(text, ''), '{ABBREVIATION}', '\\1', 'g'), '{SENTENCE_END}')))) AS place, row FROM (SELECT *, row_number() OVER () AS row FROM documents) d),
l AS (SELECT row, place, known[regexp_replace({plain.format('part')}, '{NAMES}', 'neither the name of the copyright holder nor the names of its contributors may')] AS whole,
  list_filter(list_transform(string_split(part, chr(10)), lambda x: known[regexp_replace({plain.format('x')}, '{NAMES}', 'neither the name of the copyright holder nor the names of its contributors may')]), lambda x: x IS NOT NULL) AS lines,
  ' ' || {plain.format('part')} || ' ' AS p FROM s, k WHERE regexp_matches(part, '{sign}')),
i AS (SELECT row, flatten(list(CASE WHEN whole IS NOT NULL THEN [whole] WHEN len(lines) > 0 THEN lines ELSE [{phrase}] END ORDER BY place)) AS ids FROM l GROUP BY row),
d AS (SELECT *, row_number() OVER () AS row FROM documents),
t AS (SELECT d.doc_id, list_filter(coalesce(ids, []), lambda x: x IS NOT NULL) AS ids,
  list_filter(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '{TAG}', 1), lambda x: string_split_regex(x, '{TAG_PARTS}'))), lambda w: w NOT IN ('', 'OR', 'AND', 'WITH', '-') AND NOT regexp_matches(w, 'exception')) AS tags
  FROM d LEFT JOIN i ON i.row = d.row),
q AS (SELECT *, ' ' || coalesce(array_to_string(ids, ' '), '') || ' ' AS seq FROM t),
m AS (SELECT *, list_concat(tags, list_filter([{cases}], lambda x: x IS NOT NULL)) AS hits FROM q)
SELECT doc_id, hits[1] AS license,
       coalesce(array_to_string(list_filter(hits, lambda x, k: list_position(hits, x) = k), ','), '') AS licenses,
       coalesce(array_to_string(ids, ' '), '') AS sentence_ids, CAST(len(ids) AS INTEGER) AS n_sentences
FROM m"""


OP2_SQL = _op2_sql()
