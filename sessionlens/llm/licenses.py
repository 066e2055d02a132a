"""License scans by conditional compression.

A candidate block (a line, or a paragraph of wrapped lines, that mentions licensing; of long ones the surroundings of each mention)
is compressed by zstandard alone and with each license template as raw dictionary. The more a template says what the block says,
the more its size shrinks; templates are ranked by that reduction. All that save anything, or cost no more than sizes waver by, are confirmed by exact wording: the template's
words are aligned with the block's, and a license is reported with the words that are missing and added, if enough of its
words are there, none of those that tell it from others (its name, its version) is missing, and none of the added ones makes it
another license (QUALIFIERS) or denies it (NEGATIONS).

Time goes with the length of a text, however many mentions it has: surroundings that overlap are one region, cut into chunks that
share a stretch as long as the longest template; a template is aligned only where enough of its words lie around its rarest
needed one, which a sliding count tells, and equal places are aligned once.

Defined results: null and empty texts have no blocks and no licenses; repeated rows are scanned each; a license that several
blocks name is reported once, by its best block; ties go to the template listed first; extra columns stay unless a result column
has their name; an empty table gives an empty result. Long lines, paragraphs and texts are searched around every mention, across
line breaks and blank lines, as far as the longest template reaches.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, text_or_empty

MENTION = re.compile(r"licen[cs]e|copyright|©|rights reserved|public domain|creative commons|\bcc[ -]?by|\bcc0\b|spdx|hereby granted|redistribution and use|\bgnu\b|apache|unlicense|permission (?:is|to)\b", re.I)
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
SENTENCE = re.compile(r"[.!?;:]\s|\n[^\S\n]*\n")
LONG, AROUND = 600, 220
#: Of a long block a short template saves less than sizes waver by: from this reduction on a template is confirmed.
NOISE = -0.03
GAP = 4

# Words that make a license another one, where they aren't its own; words that deny it before or inside the notice.
QUALIFIERS = frozenset("lesser library affero documentation nc nd sa noncommercial noderivatives noderivs sharealike".split())
NEGATIONS = frozenset("not never isn aren wasn".split())

# Usual license notices; words that a match must not miss.
NOTICES = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "permission granted"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "permission granted sublicense"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gnu lesser 2.1"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser 2.1"),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2.", "gnu library 2"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu library 2"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("BSD", "Licensed under the BSD License.", "bsd"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistribution binary reproduce retain"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistribution binary reproduce retain endorse"),
    ("ISC", "Licensed under the ISC License.", "isc"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission granted fee"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "permission granted anyone alter"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("CC0-1.0", "Licensed under CC0 1.0.", "cc0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4.0"),
    ("CC-BY-NC-SA-4.0", "Released under CC BY-NC-SA 4.0.", "cc by nc sa 4.0"),
    ("CC-BY-NC-ND-4.0", "Released under CC BY-NC-ND 4.0.", "cc by nc nd 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative sharealike 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative noncommercial 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "creative noderivatives 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "creative noncommercial sharealike 4.0"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "creative noncommercial noderivatives 4.0"),
    ("all-rights-reserved", "All rights reserved.", "all rights reserved"),
]
# Identifiers that SPDX lines name.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def worded(text: str) -> tuple[list[str], list[int]]:
    """The words, and the sentence that each is in."""
    low, out, sentences, end, n = text.lower(), [], [], 0, 0
    for m in WORD.finditer(low):
        n += bool(SENTENCE.search(low, end, m.start()))
        out.append(m.group())
        sentences.append(n)
        end = m.end()
    return out, sentences


#: Every name of SPDX has a line of its own as template, of which no word may be missing.
TEMPLATES = NOTICES + [(name, f"SPDX-License-Identifier: {name}", " ".join(words(f"spdx license identifier {name}"))) for name in SPDX]


def around_mentions(piece: str, around: int) -> list[str]:
    """The surroundings of the mentions, so many characters on both sides: overlapping ones as one, in chunks that overlap by as many."""
    regions: list[list[int]] = []
    for m in MENTION.finditer(piece):
        start, end = max(0, m.start() - around), min(len(piece), m.end() + around)
        if regions and start <= regions[-1][1]:
            regions[-1][1] = end
        else:
            regions.append([start, end])
    return [piece[k : min(k + 4 * around, end)] for start, end in regions for k in range(start, max(end - around, start + 1), 3 * around)]


def blocks_of(text: str, around: int = AROUND) -> list[str]:
    """Lines, paragraphs of several lines and texts of several paragraphs that mention licensing; of long ones the surroundings of the mentions."""
    if not MENTION.search(text):
        return []
    out: dict[str, None] = {}
    paragraphs = PARAGRAPH.split(text)
    pieces = [(text, LONG * 4)] if len(paragraphs) > 1 else []
    for paragraph in paragraphs:
        if MENTION.search(paragraph):
            lines = paragraph.split("\n")
            pieces += [(paragraph, LONG * 4)] if len(lines) > 1 else []
            pieces += [(line, LONG) for line in lines if MENTION.search(line)]
    for piece, most in pieces:
        out |= dict.fromkeys([piece] if len(piece) <= most else around_mentions(piece, around))
    return list(out)


@dataclass
class Template:
    license: str
    text: str
    needed: frozenset[str]
    tokens: list[str] = field(default_factory=list)
    compressor: zstandard.ZstdCompressor | None = None

    def __post_init__(self):
        self.counts, self.refused = Counter(self.tokens), (QUALIFIERS | {"not"}) - set(self.tokens)


class Scanner:
    """Templates with compressors; kept per Python worker task."""

    def __init__(self, templates=None, coverage: float = 0.75, level: int = 3):
        self.coverage = coverage
        options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**options)
        self.templates = []
        for name, text, needed in templates or TEMPLATES:
            raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append(Template(name, text, frozenset(needed.split()), words(text), zstandard.ZstdCompressor(dict_data=raw, **options)))
        self.around = max([AROUND, *[len(t.text) * 5 // 4 for t in self.templates]])
        self.known: dict[str, list[dict]] = {}

    def reductions(self, block: str) -> list[tuple[float, int]]:
        """(share of the size that a template saves, its place), largest first."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(t.compressor.compress(data)) / alone, k) for k, t in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))

    def confirm(self, template: Template, tokens: list[str], places: dict[str, list[int]], sentences: list[int]) -> dict | None:
        """The best wording of the template in the block, if it is there: every place of its rarest needed word with enough of its words around.

        A notice that the same sentence denies, at most three words before it, is none.
        """
        if not all(w in places for w in template.needed):
            return None
        anchor, reach, best = min(sorted(template.needed), key=lambda w: len(places[w])), 2 * len(template.tokens), None
        enough, have, shared, low, high = self.coverage * len(template.tokens), Counter(), 0, 0, 0
        aligned: dict[tuple, dict | None] = {}
        for at in places[anchor]:
            start, end = max(0, at - reach), min(len(tokens), at + reach + 1)
            if start >= high:  # nothing in common with the window before
                have, shared, low, high = Counter(), 0, start, start
            for w in tokens[high:end]:
                have[w] += 1
                shared += have[w] <= template.counts[w]
            for w in tokens[low:start]:
                shared -= have[w] <= template.counts[w]
                have[w] -= 1
            low, high = start, end
            if shared < enough:
                continue
            key = tuple(tokens[start:end])
            if key not in aligned:
                aligned[key] = self.align(template, tokens[start:end])
            found = aligned[key]
            first = start + min(found["places"]) if found else 0
            if found and any(tokens[k] in NEGATIONS and sentences[k] == sentences[first] for k in range(max(0, first - 3), first)):
                continue
            if found and (best is None or (found["coverage"], -len(found["added"])) > (best["coverage"], -len(best["added"]))):
                best = found | {"places": {p + start for p in found["places"]}}
                if best["coverage"] == 1 and not best["added"]:
                    break
        return best

    def align(self, template: Template, tokens: list[str]) -> dict | None:
        """Wording differences if the template is in these words: coverage, missing and added words inside the aligned stretch."""
        matches = [m for m in SequenceMatcher(None, template.tokens, tokens, autojunk=False).get_matching_blocks() if m.size]
        # around the longest run, with gaps of at most GAP words: the same words elsewhere are no notice
        low = high = max(range(len(matches)), key=lambda k: matches[k].size, default=0)
        while low > 0 and matches[low].b - (matches[low - 1].b + matches[low - 1].size) <= GAP:
            low -= 1
        while high + 1 < len(matches) and matches[high + 1].b - (matches[high].b + matches[high].size) <= GAP:
            high += 1
        matches = matches[low : high + 1]
        share = sum(m.size for m in matches) / len(template.tokens)
        if share < self.coverage:
            return None
        used = {m.a + k for m in matches for k in range(m.size)}
        missing = [w for k, w in enumerate(template.tokens) if k not in used]
        if template.needed & set(missing):
            return None
        there = {m.b + k for m in matches for k in range(m.size)}
        first = min(there)
        added = [tokens[k] for k in range(first, max(there) + 1) if k not in there]
        if template.refused.intersection(added):
            return None
        return {"coverage": share, "missing": missing, "added": added, "places": there}

    def scan_block(self, block: str) -> list[dict]:
        found = self.known.get(block)
        if found is None:
            if len(self.known) > 20_000:
                self.known.clear()
            (tokens, sentences), found, places = worded(block), [], {}
            for k, w in enumerate(tokens):
                places.setdefault(w, []).append(k)
            for reduction, k in self.reductions(block):
                t = self.templates[k]
                if reduction > NOISE and (c := self.confirm(t, tokens, places, sentences)):
                    found.append({"license": t.license, "reduction": reduction, **c, "block": block})
            # a license whose words are part of another's in this block isn't named itself
            found = [x for x in found if not any(x["places"] < y["places"] for y in found if y["license"] != x["license"])]
            for x in found:
                own = x.pop("places")
                x["stretch"] = " ".join(["", *tokens[min(own) : max(own) + 1], ""])
            self.known[block] = found
        return found

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """The number of candidate blocks; the licenses, each by its best block, in the order of their names."""
        best: dict[str, dict] = {}
        blocks = blocks_of(text, self.around)
        for block in blocks:
            for x in self.scan_block(block):
                old = best.get(x["license"])
                if old is None or (x["coverage"], -len(x["added"]), x["reduction"]) > (old["coverage"], -len(old["added"]), old["reduction"]):
                    best[x["license"]] = x
        # what a smaller block has of another license's wording isn't named either
        kept = [k for k in sorted(best) if not any(len(x["stretch"]) > len(best[k]["stretch"]) and best[k]["stretch"] in x["stretch"] for x in best.values())]
        return len(blocks), [{c: v for c, v in best[k].items() if c != "stretch"} for k in kept]


FOUND = T.StructType([T.StructField("license", T.StringType()), T.StructField("reduction", T.DoubleType()), T.StructField("coverage", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("added", T.ArrayType(T.StringType())), T.StructField("block", T.StringType())])
FOUND_ARROW = pa.struct([("license", pa.string()), ("reduction", pa.float64()), ("coverage", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("block", pa.string())])


def scan_documents(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_blocks and licenses (license, reduction, coverage, missing, added, block) to keep (all columns)."""
    bounded_batches(docs.sparkSession)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_blocks", "licenses")]
    source = docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text).alias("__body"))
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField("n_blocks", T.IntegerType()), T.StructField("licenses", T.ArrayType(FOUND))])

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            scanned = [scanner.scan(body.as_py()) for body in batch.column("__body")]
            more = [pa.array([n for n, _ in scanned], pa.int32()), pa.array([x for _, x in scanned], pa.list_(FOUND_ARROW))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more], names=[*names, "n_blocks", "licenses"])

    return source.mapInArrow(run, schema)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document: its candidate blocks, licenses, and how exactly the best fits."""
    found = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    names = F.array_join(F.transform("licenses", lambda x: x["license"]), ",")
    exact = F.exists("licenses", lambda x: (F.size(x["missing"]) == 0) & (F.size(x["added"]) == 0))
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["reduction"])), F.lit(0.0))
    return found.select("doc_id", "n_blocks", F.size("licenses").alias("n_licenses"), names.alias("licenses"), exact.alias("exact"), best.alias("best_reduction"))
