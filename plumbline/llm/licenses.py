"""Licence recognition by sentences and ordered rules. DataFrame functions only.

Sentences of a text are normalised and mapped to the identifiers of known
licence sentences; the identifiers, in the order found, are matched against
licence rules, each an ordered sequence of identifiers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, whole

#: Known licence sentences (fixed values: public licence texts and usual notices), by identifier.
SENTENCES = {
    "mit-note": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache-note": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl3-note": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "ccbync-note": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ccby-note": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ccbysa-note": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-note": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "lgpl21-grant": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-grant": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl3-note": ["Licensed under the GNU Lesser General Public License, version 3."],
    "agpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-note": ["Licensed under the GNU Affero General Public License, version 3."],
    "cc0-grant": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "cc0-note": ["Licensed under CC0 1.0.", "This work is licensed under a Creative Commons Zero 1.0 Universal License."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "epl2-note": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."],
    "bsl1-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "bsl1-note": ["Distributed under the Boost Software License, Version 1.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}
#: Rules in order (fixed values): family, licence, category, identifiers that follow each other in a text, not always at once.
RULES = [
    ("bsd", "BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd", "BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("mit", "MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("mit", "MIT", "permissive", ["mit-note"]),
    ("isc", "ISC", "permissive", ["isc-grant"]),
    ("apache", "Apache-2.0", "permissive", ["apache-note", "apache-copy"]),
    ("apache", "Apache-2.0", "permissive", ["apache-note"]),
    ("gpl", "GPL-3.0-or-later", "copyleft", ["gpl-grant"]),
    ("gpl", "GPL-2.0-or-later", "copyleft", ["gpl2-grant"]),
    ("gpl", "GPL-3.0-only", "copyleft", ["gpl3-note"]),
    ("lgpl", "LGPL-3.0-or-later", "copyleft", ["lgpl3-grant"]),
    ("lgpl", "LGPL-2.1-or-later", "copyleft", ["lgpl21-grant"]),
    ("lgpl", "LGPL-3.0-only", "copyleft", ["lgpl3-note"]),
    ("agpl", "AGPL-3.0-or-later", "copyleft", ["agpl3-grant"]),
    ("agpl", "AGPL-3.0-only", "copyleft", ["agpl3-note"]),
    ("mpl", "MPL-2.0", "copyleft", ["mpl-note"]),
    ("epl", "EPL-2.0", "copyleft", ["epl2-note"]),
    ("cc", "CC-BY-NC-4.0", "noncommercial", ["ccbync-note"]),
    ("cc", "CC-BY-SA-4.0", "copyleft", ["ccbysa-note"]),
    ("cc", "CC-BY-4.0", "permissive", ["ccby-note"]),
    ("cc", "CC0-1.0", "permissive", ["cc0-grant"]),
    ("cc", "CC0-1.0", "permissive", ["cc0-note"]),
    ("zlib", "Zlib", "permissive", ["zlib-grant"]),
    ("boost", "BSL-1.0", "permissive", ["bsl1-grant"]),
    ("boost", "BSL-1.0", "permissive", ["bsl1-note"]),
    ("unlicense", "Unlicense", "permissive", ["public-domain"]),
    ("reserved", "All-Rights-Reserved", "reserved", ["reserved"]),
]
#: Every known sentence holds one of these; only sentences that do are looked up.
ANCHOR = r"(?i)licen[sc]e|copyright|permission|redistribut|public domain|rights reserved"
#: The most restrictive category found names the document's.
CATEGORIES = ["reserved", "noncommercial", "copyleft", "permissive"]


def plain(sentence: str) -> str:
    """The normal form: lower case, everything but letters and digits as single blanks."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def pieces(sentence: str) -> list[str]:
    """The normal forms of the parts that a reading cuts a sentence into."""
    return [plain(x) for x in re.sub(r"([.!?:])[ \t\n\r]+", r"\1\n", sentence).split("\n")]


def _identified(text: Column) -> Column:
    """Identifiers of the known sentences in order, for each of three readings: a line end as an end of sentence, as a blank, or as a blank unless the next line is indented.

    A known sentence that the readings cut is found by its first piece with the
    anchor, if its other pieces stand around that one.
    """
    forms = [(name, pieces(s), [bool(re.search(ANCHOR, x)) for x in pieces(s)].index(True)) for name, ss in SENTENCES.items() for s in ss]
    known = F.create_map(*[F.lit(x) for name, parts, _ in forms if len(parts) == 1 for x in (parts[0], name)])

    def reading(t: Column) -> Column:
        cut = F.split(F.regexp_replace(t, r"([.!?:])[ \t\n\r]+", "$1\n"), "\n")

        def identifier(s: Column, i: Column) -> Column:
            ids = [F.element_at(known, _normal(s))]
            for name, parts, at in forms:
                if len(parts) > 1:
                    hit = _normal(s) == parts[at]
                    for k, part in enumerate(parts):
                        if k != at:
                            hit = hit & (_normal(F.get(cut, i + (k - at))) == part)
                    ids.append(F.when(hit, F.lit(name)))
            return F.when(s.rlike(ANCHOR), F.coalesce(*ids))

        return F.filter(F.transform(cut, identifier), lambda i: i.isNotNull())

    def joined(t: Column, paragraph: str, line_end: str) -> Column:
        marked = F.regexp_replace(t, paragraph, ".\u0001 ")
        return F.translate(F.regexp_replace(marked, line_end, " "), "\u0001", "\n")

    # a line without letters and digits (blank, or a comment mark alone) ends a paragraph; in the third reading an indented line opens one
    return F.array(reading(text), reading(joined(text, r"\n[^\p{L}\p{N}\n]*\n", r"[\r\n]+")), reading(joined(text, r"\n[ \t\r]*\n", r"[\r\n]+(?! )")))


def _matched(ids: Column) -> Column:
    """Whether each rule's identifiers are in `ids` in their order: one pass, which counts for every rule how many it has met."""
    rules = F.array(*[F.array(*map(F.lit, r[3])) for r in RULES])
    none = F.array(*[F.lit(0)] * len(RULES))

    def met(counts: Column, i: Column) -> Column:
        return F.zip_with(counts, rules, lambda n, own: n + F.coalesce((F.get(own, n) == i).cast("int"), F.lit(0)))

    return F.zip_with(F.aggregate(ids, none, met), rules, lambda n, own: n == F.size(own))


def licensed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, category): one row for each row of docs.

    In a family of rules the first that matches counts; `licenses` is in the
    order of the rules. Texts without a known sentence, empty and null ones
    have 0, empty strings and category `none`; known sentences that fit no rule
    give category `unknown`. A null doc_id stays null, rows that repeat are read
    alike, the time of a very long text grows with its length, other columns
    play no part, and an empty table gives no row.
    """
    text = whole()
    none = F.array(*[F.array().cast("array<string>")] * 3)
    rows = docs.select("doc_id", F.when(text.rlike(ANCHOR), _identified(text)).otherwise(none).alias("r"))
    # the reading that knows the most sentences; the first of them on ties
    n, r = [F.size(F.get("r", F.lit(i))) for i in range(3)], [F.get("r", F.lit(i)) for i in range(3)]
    best = F.when((n[2] > n[1]) & (n[2] > n[0]), r[2]).when(n[1] > n[0], r[1]).otherwise(r[0])
    rows = rows.select("doc_id", best.alias("ids"))
    rows = rows.select("doc_id", "ids", F.when(F.size("ids") > 0, _matched(F.col("ids"))).alias("m"))
    hits, families = [], {}
    for i, (family, name, kind, _) in enumerate(RULES):
        first = hit = F.get("m", F.lit(i))
        earlier = families.setdefault(family, [])
        for e in earlier:
            first = first & ~e
        earlier.append(hit)
        hits.append(F.when(first, F.struct(F.lit(name).alias("license"), F.lit(kind).alias("kind"))))
    found = F.when(F.size("ids") > 0, F.filter(F.array(*hits), lambda h: h.isNotNull())).otherwise(F.array().cast("array<struct<license:string,kind:string>>"))
    rows = rows.select("doc_id", "ids", found.alias("found"))
    kinds = F.transform("found", lambda h: h["kind"])
    category = F.when(F.size("ids") == 0, "none")
    for c in CATEGORIES:
        category = category.when(F.array_contains(kinds, c), c)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
                       F.array_join(F.transform("found", lambda h: h["license"]), ",").alias("licenses"), category.otherwise("unknown").alias("category"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; edge cases as in licensed."""
    return licensed(table(spark, sf_dir, "documents"))


def op9_sql() -> str:
    """DuckDB's form of op9_licenses. Rules are regular expressions over the identifiers there, in an engine that doesn't backtrack."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    forms = [(name, pieces(s), [bool(re.search(ANCHOR, x)) for x in pieces(s)].index(True)) for name, ss in SENTENCES.items() for s in ss]
    known = ", ".join(f"({quote(parts[0])}, {quote(name)})" for name, parts, _ in forms if len(parts) == 1)
    cut = lambda t: f"string_split(regexp_replace({t}, '([.!?:])[ \\t\\n\\r]+', '\\1' || chr(10), 'g'), chr(10))"
    joined = lambda p, t: f"replace(regexp_replace(regexp_replace({t}, '{p}', '.' || chr(1) || ' ', 'g'), '[\\r\\n]+', ' ', 'g'), chr(1), chr(10))"
    # in the third reading a line end before a blank stays: it is hidden while the others are joined
    hidden = lambda p, t: f"replace(replace(regexp_replace(regexp_replace(regexp_replace({t}, '{p}', '.' || chr(1) || ' ', 'g'), '[\\r\\n] ', chr(2) || ' ', 'g'), '[\\r\\n]+', ' ', 'g'), chr(1), chr(10)), chr(2), chr(10))"
    readings = [cut("t"), cut(joined(r"\n[^\p{L}\p{N}\n]*\n", "t")), cut(hidden(r"\n[ \t\r]*\n", "t"))]
    normal = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"

    def identified(c: str) -> str:
        cases = " ".join("WHEN " + " AND ".join(f"coalesce({c}n[i + {k - at}], '') = {quote(p)}" if k != at else f"{c}n[i] = {quote(p)}" for k, p in enumerate(parts)) + f" AND i + {-at} >= 1 THEN {quote(name)}"
                         for name, parts, at in forms if len(parts) > 1)
        return f"list_filter(list_transform(list_filter(range(1, len({c}) + 1), lambda i: regexp_matches({c}[i], {quote(ANCHOR)})), lambda i: coalesce(m[{c}n[i]], CASE {cases} END)), lambda x: x IS NOT NULL)"

    hits, families = [], {}
    for family, name, kind, ids in RULES:
        own = "regexp_matches(s, " + quote(r"\|" + r"\|(?:.*\|)?".join(ids) + r"\|") + ")"
        earlier = families.setdefault(family, [])
        hits.append(f"CASE WHEN {' AND '.join([own, *[f'NOT {e}' for e in earlier]])} THEN {{'license': {quote(name)}, 'kind': {quote(kind)}}} END")
        earlier.append(own)
    order = " ".join(f"WHEN list_contains(list_transform(found, lambda h: h.kind), {quote(c)}) THEN {quote(c)}" for c in CATEGORIES)
    return f"""
WITH known(k, v) AS (VALUES {known}), names AS (SELECT map_from_entries(list((k, v))) AS m FROM known),
a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), {quote(ANCHOR)}) AS anchored FROM documents),
b AS (SELECT doc_id, {', '.join(f"CASE WHEN anchored THEN {r} ELSE []::VARCHAR[] END AS c{i}" for i, r in enumerate(readings))} FROM a),
n AS (SELECT *, {', '.join(f"list_transform(c{i}, lambda s: {normal('s')}) AS c{i}n" for i in range(3))} FROM b),
r AS (SELECT doc_id, {', '.join(f"{identified(f'c{i}')} AS r{i}" for i in range(3))} FROM n, names),
c AS (SELECT doc_id, CASE WHEN len(r2) > len(r1) AND len(r2) > len(r0) THEN r2 WHEN len(r1) > len(r0) THEN r1 ELSE r0 END AS ids FROM r),
d AS (SELECT doc_id, ids, '|' || array_to_string(ids, '|') || '|' AS s FROM c),
e AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN list_filter([{', '.join(hits)}], lambda h: h IS NOT NULL) ELSE [] END AS found FROM d)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_transform(found, lambda h: h.license), ',') AS licenses,
  CASE WHEN len(ids) = 0 THEN 'none' {order} ELSE 'unknown' END AS category FROM e"""
