"""Operator 6: rules over sentences, against its SQL and by hand."""

import re

import duckdb
import pytest

from lattica.llm import licenses

from .helpers import SF, clashing, documents, empty, frame, odd

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
WRAPPED = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and"""
comment = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
CASES = {
    MIT: ("MIT", "mit-text"),
    comment(MIT, "#"): ("MIT", "mit-text"),
    MIT.replace("\n", "\r\n"): ("MIT", "mit-text"),
    MIT.split("\n", 4)[4]: ("MIT", "mit-text"),
    BSD: ("BSD-2-Clause", "bsd2-text"),
    BSD + ENDORSE: ("BSD-3-Clause", "bsd3-text"),
    comment(BSD + ENDORSE, "--"): ("BSD-3-Clause", "bsd3-text"),
    WRAPPED: ("Apache-2.0", "apache-header"),
    "/*\n" + comment(WRAPPED, " *") + "\n */\nint main() {}": ("Apache-2.0", "apache-header"),
    comment(WRAPPED, ";;"): ("Apache-2.0", "apache-header"),
    comment(GPL, "//"): ("GPL-3.0", "gpl3-grant"),
    comment(GPL2, " *"): ("GPL-2.0", "gpl2-grant"),
    "some line before\nReleased under the MIT License\nsome line behind": ("MIT", "mit-named"),
    APACHE: ("Apache-2.0", "apache-header"),
    "\n".join(reversed(APACHE.split("\n"))): ("Apache-2.0", "apache-named"),  # the sentences are there, but in another order
    "Some words. SPDX-License-Identifier: MIT": ("MIT", "mit-named"),
    "Released under CC0 1.0; please share. Licensed under CC BY-NC 4.0.": ("CC-BY-NC-4.0", "ccbync-named"),
    "We discuss the MIT License at length here": (None, None),
    "RELEASED   under the --- MIT license!": ("MIT", "mit-named"),
    "": (None, None),
}


def rows_of(df):
    return sorted((repr(r.doc_id), r.license, r.kind, r.rule, r.licenses, r.identifiers, r.n_sentences) for r in df.collect())


def by_sql(documents):
    con = duckdb.connect()
    con.register("documents", documents)
    cursor = con.execute(licenses.scan_sql())
    names = [d[0] for d in cursor.description]
    return sorted(tuple(repr(v) if n == "doc_id" else v for n, v in zip(names, row, strict=True)) for row in cursor.fetchall())


@pytest.mark.parametrize("sentence", [s for ss in licenses.SENTENCES.values() for s in ss])
def test_anchors_are_in_every_sentence(sentence):
    assert re.search(licenses.ANCHORS, sentence.lower())


def test_rules(spark):
    docs = frame(spark, list(enumerate(CASES)))
    found = {r.doc_id: (r.license, r.rule) for r in licenses.scan(docs).collect()}
    assert [found[i] for i in range(len(CASES))] == list(CASES.values())


def test_as_its_sql(spark):
    for docs in (documents(spark), frame(spark, list(enumerate(CASES)))):
        assert rows_of(licenses.scan(docs)) == by_sql(docs.toArrow())


def test_defined_cases(spark):
    found = rows_of(licenses.scan(clashing(odd(spark))))
    assert len(found) == 10 and all(r[1] is None and r[6] == 0 for r in found)
    assert licenses.scan(empty(spark)).count() == 0
    twice = licenses.scan(frame(spark, [(1, "MIT License\nMIT License")])).first()
    assert (twice.n_sentences, twice.licenses) == (2, "MIT")


def test_native(spark):
    plan = licenses.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.replace("ArrowToRow", ""))
    assert SF
