import textwrap

from pyspark.sql import functions as F

from orrery.llm import licences as L


def docs(spark):
    plain = "Some words of ordinary prose that fill the line with text number {i} and go on a little."
    rows, want = [], {}
    i = 0
    for family, texts in L.TEMPLATES.items():
        for text in texts:
            rows.append((i, plain.format(i=i) + "\n" + text + "\nmore prose here"))
            want[i] = family
            i += 1
    for text in ["Licensed under the Apache License, Version 2.0. " + plain * 40, plain + " Released under the MIT License."]:
        rows.append((i, text))
        want[i] = "Apache-2.0" if "Apache" in text else "MIT"
        i += 1
    for text in [*(plain.format(i=k) for k in range(40)), "The driver lost a license in the valley.", "The license of the mayor was renewed, version 3 of it.", None, ""]:
        rows.append((i, text))
        want[i] = ""
        i += 1
    return rows, want, spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1)).withColumn("id", F.lit(2))


def test_families(spark):
    rows, want, df = docs(spark)
    again = df.union(df.filter("doc_id = 0")).union(spark.createDataFrame([(None, "Released under the MIT License.", 1, 2)], df.schema))
    got = L.licences(again)
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    out = got.collect()
    assert len(out) == len(rows) + 2
    wrong = [(r["doc_id"], r["families"], want[r["doc_id"]]) for r in out if r["doc_id"] is not None and r["families"] != want[r["doc_id"]]]
    assert not wrong
    assert [r["families"] for r in out if r["doc_id"] is None] == ["MIT"]
    assert all(r["probability"] >= L.LEAST_PROBABILITY for r in out if r["families"])


def test_every_template_has_an_anchor():
    for texts in L.TEMPLATES.values():
        for text in texts:
            assert any(a in text.lower() for a in L.ANCHORS) and len(L.template_shingles(text)) > 0


def test_too_little_of_a_template_without_anchors_and_hints():
    single = [a for a in [*L.ANCHORS, *L.HINTS] if " " not in a]
    for texts in L.TEMPLATES.values():
        for text in texts:
            shingles = L.template_shingles(text)
            assert sum(not any(a in x for a in single) for x in shingles) < L.LEAST_CONTAINED * len(shingles)


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."


def test_wrapped_notices(spark):
    rows, want = [], []

    def add(text, families, n):
        rows.append((len(rows), text))
        want.append((families, n))

    for family, notice in (("BSD", BSD), ("ISC", ISC), ("LGPL", LGPL)):
        for width in (30, 50, 66, 72, 78):
            for mark in ("", " * ", "# "):
                add("Some prose before the notice.\n\n" + "\n".join(mark + x for x in textwrap.wrap(notice, width)) + "\n\nSome prose behind.", family, 1)
        add(notice, family, 1)
    # Not wrapped over a blank line; a part without an anchor; lines that hold a notice each; a notice in a longer sentence.
    add("Redistribution and use in source and\n\nbinary forms, with or without modification", "", 0)
    part = "hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    add(part, "MIT", 1)
    add(part.replace("obtaining ", "obtaining\n"), "MIT", 1)
    add("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\n", "Apache-2.0,MIT", 2)
    add("These words come first\nReleased under the MIT License.\nAnd these last", "MIT", 1)
    add("one line of prose without a full stop\n" * 12 + "\n".join(textwrap.wrap(BSD, 60)), "BSD", 1)
    out = {r["doc_id"]: r for r in L.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(rows[i][1], out[i], w) for i, w in enumerate(want) if (out[i]["families"], out[i]["n_confirmed"]) != w]
    assert not wrong
    # Lines of a notice that is confirmed as a whole are not unknown.
    assert all(out[i]["n_unknown"] == 0 for i in range(16))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.licences(df).count() == 0


def test_shingles_agree(spark):
    for text in ["Licensed under CC BY-NC 4.0.", "x GPL-3.0-or-later: y", "v. 2.0. Ünder the"]:
        row = spark.range(1).select(L.grams(L.words(F.lit(text)), 3).alias("g")).first()
        assert set(row["g"]) == L.template_shingles(text)
    assert L.template_shingles("one two") == {"one two"} and L.template_shingles("one") == set()


# Notices as projects have them; the words around the templates' differ.
NOTICES = {
    "GPL-3.0": "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. Foo is distributed in the hope that it will be useful.",
    "GPL-2.0": "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": LGPL,
    "BSD": BSD,
    "ISC": ISC,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, subject to the following conditions:',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
}


def test_standard_notices(spark):
    rows, want = [], []
    for family, notice in NOTICES.items():
        for width in (0, 60, 72, 80):
            for mark in ("", " * ", "# ", "// "):
                body = "\n".join(mark + x for x in textwrap.wrap(notice, width)) if width else notice
                rows.append((len(rows), "Some prose before.\n\n" + body + "\n\nSome prose behind."))
                want.append(family)
    long = "plain words without a point " * 40_000
    rows += [(len(rows), long + BSD + " " + long), (len(rows) + 1, long)]
    want += ["BSD", ""]
    out = {r["doc_id"]: r["families"] for r in L.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, out[i], w) for i, w in enumerate(want) if out[i] != w] == []


def test_samples_come_from_all_parts(spark):
    rows = [(i, "\n".join(f"Sentence {k} of text {i}." for k in range(50))) for i in range(300)] + [(1000 + i, "Copied. Twice.") for i in range(50)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r["passage"] for r in L.sampled(df, "text", 200, F.lit(True)).collect()]
    assert 190 <= len(found) <= 200 and len(set(found)) == len(found)
    assert len({x.split()[1] for x in found if x.startswith("Sentence")}) > 40
    assert L.sampled(df.limit(0), "text", 5, F.lit(True)).count() == 0
