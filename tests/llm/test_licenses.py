import time

from sessionlens.llm.licenses import NOTICES, TEMPLATES, Scanner, blocks_of, op2_license_scan, scan_documents, words

LINES = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved"}
PROSE = "Thatou erin the work of nd, under which thion. Reing was it version of ha and to."


def names(text):
    return [x["license"] for x in Scanner().scan(text)[1]]


def test_notices_in_any_place():
    for line, name in LINES.items():
        for text in (line, f"{PROSE}\n{line}\n{PROSE}", f"{PROSE} {line} {PROSE}", PROSE * 40 + " " + line + " " + PROSE * 40, line.upper()):
            assert names(text) == [name], (line, text[:80])
    assert names("\n".join(LINES)) == sorted(LINES.values())


def test_other_words_are_no_license():
    for text in ("", PROSE, "A driving license is needed here.", "Licensed under the Foo License.", "Copyright law is long", "Licensed under the Apache License, Version 1.1.", "mit der Zeit", "Licensed under the terms of it. Das ist mit der Zeit eine gute Sache und auch mehr. The license"):
        assert names(text) == []


def test_wording_differences():
    n, found = Scanner().scan("This work is released under the GNU General Public License, version 3.")
    assert n == 1 and found[0]["license"] == "GPL-3.0" and found[0]["missing"] == ["licensed"] and found[0]["added"] == ["released"]
    wrapped = "Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may\nnot use this file except in compliance\nwith the License."
    assert names(wrapped) == ["Apache-2.0"]
    assert [x["license"] for x in Scanner().scan("This work is licensed under the GNU General Public License, version 2.")[1]] == ["GPL-2.0"]


def test_wrapped_notices_in_long_paragraphs():
    lines = [PROSE] * 60
    wrapped = {
        "Licensed under the Apache License,\nVersion 2.0.": "Apache-2.0",
        "Redistribution and use in source and binary forms,\nwith or without modification,\nare permitted provided that the\nfollowing conditions are met": "BSD",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in\nthe Software without restriction": "MIT",
        "This work is licensed under the GNU General Public License,\nversion 3.": "GPL-3.0",
    }
    for notice, name in wrapped.items():
        for at in (0, 30, 60):
            assert names("\n".join([*lines[:at], notice, *lines[at:]])) == [name], (notice, at)
    both = "\n".join([*lines, *wrapped, *lines])
    assert names(both) == sorted(wrapped.values())


def common(a, b):
    """Pairs of places of a longest common subsequence, by the textbook."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def by_hand(text):
    """All templates against the whole text, without blocks, compression or ranking."""
    tokens, found = words(text), []
    for name, template, needed in TEMPLATES:
        own, needed = words(template), set(needed.split())
        if not needed <= set(tokens):
            continue
        anchor = sorted(needed, key=lambda w: (tokens.count(w), w))[0]
        for at in [k for k, w in enumerate(tokens) if w == anchor]:
            start = max(0, at - len(own) - 6)
            pairs = common(own, tokens[start : at + len(own) + 6])
            close = [p for k, p in enumerate(pairs) if (k and p[1] - pairs[k - 1][1] <= 5) or (k + 1 < len(pairs) and pairs[k + 1][1] - p[1] <= 5) or len(pairs) == 1]
            if len(close) >= 0.75 * len(own) and needed <= {own[i] for i, _ in close}:
                found.append((name, {start + j for _, j in close}))
    return sorted({n for n, places in found if not any(places < other for m, other in found if m != n)})


def test_whole_texts_equal_plain_alignment(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: sorted(filter(None, r.licenses.split(","))) for r in op2_license_scan(spark, small).collect()}
    assert got == {i: by_hand(t) for i, t in docs.items()}
    ten = " ".join(t for n, t, _ in NOTICES if t.startswith("Licensed under"))
    filler = " ".join(["thion eren of ha"] * 1200)
    for notice in [t for _, t, _ in TEMPLATES] + [ten]:
        for text in (f"{notice} {filler}", f"{filler}\n{notice} {filler}", f"{filler} {notice}", "\n".join([*["eren thion of ha " * 4] * 80, *notice.replace(", ", ",\n").split("\n"), *["ha of thion " * 5] * 80])):
            assert names(text) == by_hand(text), (notice, text[:60])
    assert len(names(ten + " " + filler)) == len({n for n, t, _ in NOTICES if t.startswith("Licensed under")})


def test_spdx_lines():
    assert names("// SPDX-License-Identifier: Apache-2.0\ncode") == ["Apache-2.0"] and names("# SPDX-License-Identifier: MIT") == ["MIT"]
    assert names("SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0"] and names("SPDX-License-Identifier: Foo-1.0") == []


def test_blocks():
    assert blocks_of("no mention\nof it") == [] and blocks_of("x\nAll rights reserved.\ny")[1:] == ["All rights reserved."]
    long = "a " * 2000 + "license " + "b " * 2000 + "license " + "c " * 2000
    assert len(blocks_of(long)) == 2 and all("license" in b for b in blocks_of(long)) and words("CC BY-NC 4.0.") == ["cc", "by", "nc", "4.0"]


def test_edges_and_query(spark, small):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (4, "word " * 50000 + "All rights reserved.", None)]
    out = scan_documents(spark.createDataFrame(rows, "doc_id long, text string, licenses string"))
    assert out.columns == ["doc_id", "text", "n_blocks", "licenses"]
    assert sorted((r.doc_id, [x.license for x in r.licenses]) for r in out.collect()) == [(1, []), (2, []), (3, ["MIT"]), (3, ["MIT"]), (4, ["all-rights-reserved"])]
    assert scan_documents(out.select("doc_id", "text").limit(0)).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in op2_license_scan(spark, small).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        assert {name for line, name in LINES.items() if line in text} <= got[i]
        if not any(w in text.lower() for w in ("licen", "rights reserved", "copyright", "commons", "domain", "granted", "gnu", "apache")):
            assert not got[i]


BSD_3 = """Copyright (c) 2020, Some Body
All rights of the name are kept.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT_FILE = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_files_and_families_by_their_right_names():
    """Expected names are written down, not derived."""
    assert names(BSD_3) == ["BSD-3-Clause"]
    assert names(MIT_FILE) == ["MIT"]
    whole = Scanner().scan(MIT_FILE)[1][0]
    assert whole["coverage"] == 1 and not whole["missing"]  # the file, not its first sentence alone
    assert names(PROSE * 60 + "\n\n" + BSD_3 + "\n\n" + PROSE * 60) == ["BSD-3-Clause"]
    for text, want in {
        "This library is licensed under the GNU Library General Public License, version 2.": ["LGPL-2.0"],
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
        "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0": ["CC-BY-NC-SA-4.0"],
        "This is not licensed under the MIT License.": [],
        "It isn't released under the MIT License.": [],
        "Licensed under the MIT License, not under another.": ["MIT"],
        "Please do not copy. Licensed under the MIT License.": ["MIT"],
    }.items():
        assert names(text) == want, text


def test_every_template_is_a_candidate():
    assert all(blocks_of(text) for _, text, _ in TEMPLATES)


def test_texts_dense_with_mentions_take_linear_time():
    """200 kB in seconds, whether the mentions are names, notices or parts of them."""
    scanner = Scanner()
    lists = ["MIT License, Apache License 2.0, GNU General Public License 3, BSD License, ", "license ", "copyright gnu apache permission to ", "Licensed under the MIT License. ", "redistribution and use in source and binary forms of the software "]
    for piece in lists:
        seconds = []
        for size in (50_000, 200_000):
            start = time.perf_counter()
            scanner.known.clear()
            scanner.scan(piece * (size // len(piece)))
            seconds.append(time.perf_counter() - start)
        assert seconds[1] < 8 and seconds[1] < 8 * seconds[0] + 0.5, (piece, seconds)
    assert len(blocks_of("license " * 25_000, 1500)) < 60
