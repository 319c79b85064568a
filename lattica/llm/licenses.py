"""Operator 6: licence scan by sentence rules, with DataFrame functions only.

A text is split into sentences, a sentence is normalised (lower case, runs of other signs than letters and digits become
one blank), and known sentences become identifiers. Sentences end at stops followed by white space, at a colon that ends a
line, and at blank lines; a line that is a known sentence by itself is one, too. Any other line break, with the comment marks
around it, is a blank, so hard-wrapped licence headers read like those on one line. Rules are ordered; each is a sequence of
identifiers that must occur in that order, with other known sentences between them allowed. The first rule that holds names
the licence; all that hold are listed. It is one projection: nothing is shuffled, and a text without any of the anchor
stems, one of which is in every known sentence, isn't split.

Defined cases: null and empty texts have no licence; repeated rows give repeated results; null ids stay null; very long texts
are taken whole, in linear time; extra columns are ignored; an empty table gives an empty result; a sentence that occurs twice counts
twice in n_sentences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier -> sentences, as they are written; they are normalised like those of the texts.
SENTENCES: dict[str, list[str]] = {
    "apache2": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the Apache License 2.0"],
    "apache2_compliance": ["you may not use this file except in compliance with the License"],
    "apache2_copy": ["You may obtain a copy of the License at"],
    "asis_basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "bsd": ["BSD License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License", "Released under the BSD License"],
    "bsd2": ["BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc": ["ISC License", "SPDX-License-Identifier: ISC", "Licensed under the ISC License"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain"],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "gpl3": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl_grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2_grant_a": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl2_grant_b": ["either version 2 of the License, or (at your option) any later version"],
    "lgpl_grant": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl_grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "ccby": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "ccbysa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "ccbync": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "ccbynd": ["Licensed under CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc0": ["Released under CC0 1.0", "Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["No license is granted", "Unlicensed use is prohibited", "Redistribution is not permitted"],
}
#: (rule, licence, kind, identifiers in order); earlier rules win.
RULES: list[tuple[str, str, str, list[str]]] = [
    ("apache-header", "Apache-2.0", "permissive", ["apache2", "apache2_compliance", "apache2_copy", "asis_basis"]),
    ("mit-text", "MIT", "permissive", ["mit_grant", "mit_notice"]),
    ("bsd3-text", "BSD-3-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("bsd2-text", "BSD-2-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("agpl-grant", "AGPL-3.0", "copyleft", ["agpl_grant"]),
    ("agpl-named", "AGPL-3.0", "copyleft", ["agpl"]),
    ("gpl3-grant", "GPL-3.0", "copyleft", ["gpl_grant"]),
    ("gpl3-named", "GPL-3.0", "copyleft", ["gpl3"]),
    ("gpl2-named", "GPL-2.0", "copyleft", ["gpl2"]),
    ("gpl2-grant", "GPL-2.0", "copyleft", ["gpl2_grant_a", "gpl2_grant_b"]),
    ("lgpl-grant", "LGPL-3.0", "copyleft", ["lgpl_grant"]),
    ("lgpl-named", "LGPL-3.0", "copyleft", ["lgpl"]),
    ("mpl-named", "MPL-2.0", "copyleft", ["mpl2"]),
    ("ccbync-named", "CC-BY-NC-4.0", "restricted", ["ccbync"]),
    ("ccbynd-named", "CC-BY-ND-4.0", "restricted", ["ccbynd"]),
    ("proprietary-named", "Proprietary", "restricted", ["proprietary"]),
    ("ccbysa-named", "CC-BY-SA-4.0", "copyleft", ["ccbysa"]),
    ("ccby-named", "CC-BY-4.0", "permissive", ["ccby"]),
    ("cc0-named", "CC0-1.0", "permissive", ["cc0"]),
    ("apache-named", "Apache-2.0", "permissive", ["apache2"]),
    ("mit-named", "MIT", "permissive", ["mit"]),
    ("mit-grant", "MIT", "permissive", ["mit_grant"]),
    ("bsd2-named", "BSD-2-Clause", "permissive", ["bsd2"]),
    ("bsd-named", "BSD-3-Clause", "permissive", ["bsd"]),
    ("bsd-grant", "BSD-3-Clause", "permissive", ["bsd_grant"]),
    ("isc-grant", "ISC", "permissive", ["isc_grant"]),
    ("isc-named", "ISC", "permissive", ["isc"]),
    ("unlicense-named", "Unlicense", "permissive", ["unlicense"]),
    ("zlib-grant", "Zlib", "permissive", ["zlib_grant"]),
]
#: One of these is in every known sentence.
ANCHORS = "licen|permi|redistribut|copyright|rights|cc0|warrant|public domain"


#: Comment marks and white space at the ends of a line; a stop, or a colon at a line's end, with the white space behind it.
MARGIN = r"(?m)^[ \t]*(?:/\*+|\*+/|//+|[#*;%>|]+|--+|dnl\b|rem\b)?[ \t\r]*|[ \t\r]+(?:\*+/)?[ \t\r]*$"
STOP = r"([.!?;])\s+|:[ \t]*\n"
#: A sign that no text keeps: it ends sentences.
END = "\x01"


def normal(sentence: str) -> str:
    """A known sentence as the scan sees it."""
    import re

    return re.sub(r"[^\w]+|_+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {normal(s): i for i, ss in SENTENCES.items() for s in ss}


def rule_pattern(identifiers: list[str]) -> str:
    """Pattern over ' id1 id2 ... ' for identifiers in that order."""
    return " " + "( | .* )".join(identifiers) + " "


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (id, license, kind, rule, licenses, identifiers, n_sentences)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in known().items() for x in kv])
    known_id = lambda x: F.try_element_at(table, F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    lines = F.split(F.regexp_replace(F.regexp_replace(F.translate(text, END, " "), MARGIN, ""), STOP, END + "\n"), "\n")
    # a known line and a blank one end the sentence before them; other line breaks are blanks
    whole = F.array_join(F.transform(lines, lambda x: F.when((x == "") | known_id(x).isNotNull(), F.concat(F.lit(END), x, F.lit(END))).otherwise(x)), " ")
    ids = F.filter(F.transform(F.split(whole, END), known_id), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    found = docs.select(docs[id_col].alias("key"), F.when(F.lower(text).rlike(ANCHORS), ids).otherwise(none).alias("ids"))
    found = found.select("key", F.array_join("ids", " ").alias("identifiers"), F.size("ids").cast("long").alias("n_sentences"))
    around = F.concat(F.lit(" "), F.col("identifiers"), F.lit(" "))
    pick = lambda at: reduce(lambda case, r: case.when(around.rlike(rule_pattern(r[3])), F.lit(r[at])), RULES[1:], F.when(around.rlike(rule_pattern(RULES[0][3])), F.lit(RULES[0][at])))
    every = F.array_distinct(F.filter(F.array(*[F.when(around.rlike(rule_pattern(r[3])), F.lit(r[1])) for r in RULES]), lambda x: x.isNotNull()))
    out = found.select("key", pick(1).alias("license"), pick(2).alias("kind"), pick(0).alias("rule"), F.array_join(every, ",").alias("licenses"), "identifiers", "n_sentences")
    return out.withColumnRenamed("key", id_col)


def scan_sql() -> str:
    """The same in DuckDB's dialect."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    keys, values = zip(*known().items(), strict=True)
    case = lambda at: "CASE " + " ".join(f"WHEN regexp_matches(ar, {q(rule_pattern(r[3]))}) THEN {q(r[at])}" for r in RULES) + " END"
    # a licence that two rules name is listed once, at the first of them that holds
    every = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(ar, {q(rule_pattern(r[3]))}) THEN {q(r[1])} END" for r in RULES) + "], lambda x: x IS NOT NULL)"
    ordered = f"array_to_string(list_filter({every}, lambda x, i: list_position({every}, x) = i), ',')"
    return f"""
WITH known AS (SELECT unnest([{', '.join(map(q, keys))}]) AS sentence, unnest([{', '.join(map(q, values))}]) AS ident),
lines AS (SELECT rid, doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM
  (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(1), ' '), {q(MARGIN)}, '', 'g'), {q(STOP)}, chr(1) || chr(10), 'g'), chr(10)) AS s FROM documents)),
marked AS (SELECT rid, doc_id, string_agg(CASE WHEN line = '' OR sentence IS NOT NULL THEN chr(1) || line || chr(1) ELSE line END, ' ' ORDER BY pos) AS whole FROM lines
  LEFT JOIN known ON trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = sentence GROUP BY rid, doc_id),
split AS (SELECT rid, doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS raw FROM (SELECT rid, doc_id, string_split(whole, chr(1)) AS s FROM marked)),
hits AS (SELECT rid, pos, ident FROM split JOIN known ON trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = sentence),
seqs AS (SELECT rid, string_agg(ident, ' ' ORDER BY pos) AS identifiers, count(*) AS n FROM hits GROUP BY rid),
ids AS (SELECT rid, any_value(doc_id) AS doc_id FROM split GROUP BY rid),
rows_ AS (SELECT doc_id, coalesce(identifiers, '') AS identifiers, coalesce(n, 0) AS n_sentences, ' ' || coalesce(identifiers, '') || ' ' AS ar FROM ids LEFT JOIN seqs USING (rid))
SELECT doc_id, {case(1)} AS license, {case(2)} AS kind, {case(0)} AS rule, {ordered} AS licenses, identifiers, n_sentences FROM rows_"""
