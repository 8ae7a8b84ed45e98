"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages of a file, its lines and paragraphs, are sparse vectors weighted by inverse document frequency over all files;
a passage has the licence whose template is nearest by cosine, if near enough. Most are passed over at once, as too
little of their length lies in the templates' vocabulary for any cosine to be great enough. A file without a licence of its own takes that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: By SPDX name, how headers say it and what the licence's file says, as they are commonly written.
TEMPLATES = {
    "MIT": (
        "Licensed under the MIT license.", "Released under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "EPL-2.0": ("SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    "ISC": ("Licensed under the ISC license.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Zlib": ("SPDX-License-Identifier: Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    "BSL-1.0": ("SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    "Unlicense": ("SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "CC0-1.0": ("SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
}
LICENCE_FILE = re.compile(r"(?i)^(licen[sc]es?|copying|unlicense|notice)([._-].*)?$")
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


VOCABULARY = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms(x)})


def frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each term of the vocabulary. It goes to the driver: a row a term."""
    own = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM.pattern), F.lit(0)), F.array(*map(F.lit, [*VOCABULARY, ""])))
    counts = files.select(F.explode(F.array_append(own, "")).alias("term")).groupBy("term").count().collect()
    found = {r["term"]: r["count"] for r in counts}
    return found.pop("", 0), found


class Templates:
    """Unit vectors of all templates, log-scaled term frequency times inverse document frequency, as lists of (template, weight) by term."""

    def __init__(self, n_files: int, holding: dict[str, int]):
        self.idf = {t: math.log((n_files + 1) / (holding.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.rare = math.log(n_files + 1) + 1
        self.names = [name for name in sorted(TEMPLATES) for _ in TEMPLATES[name]]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, text in enumerate(x for name in sorted(TEMPLATES) for x in TEMPLATES[name]):
            raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in Counter(terms(text)).items()}
            size = math.sqrt(sum(x * x for x in raw.values()))
            for t, x in raw.items():
                self.postings.setdefault(t, []).append((i, x / size))

    def near(self, words: list[str], min_cosine: float) -> dict[str, float]:
        """Cosines of min_cosine or more by licence. Terms outside the vocabulary count in a passage's length as the rarest do."""
        counts = Counter(words)
        own = {t: (1 + math.log(counts[t])) * x for t, x in self.idf.items() if t in counts} if len(counts) > len(self.idf) else {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items() if t in self.idf}
        inside = sum(x * x for x in own.values())
        # Each other term adds the square of rare at least; a cosine is at most the share of the length that lies in the vocabulary.
        if inside < min_cosine**2 * (inside + (len(counts) - len(own)) * self.rare**2):
            return {}
        size = math.sqrt(inside + sum(((1 + math.log(n)) * self.rare) ** 2 for t, n in counts.items() if t not in own))
        dots = [0.0] * len(self.names)
        for t, x in own.items():
            for i, y in self.postings[t]:
                dots[i] += x * y
        out: dict[str, float] = {}
        for name, dot in zip(self.names, dots):
            if dot >= min_cosine * size:
                out[name] = max(out.get(name, 0.0), dot / size)
        return out


def paragraphs(text: str) -> Iterator[list[list[str]]]:
    """Passages of every paragraph: terms of its lines, and of several lines together."""
    for paragraph in re.split(r"\n[\x20\x09-\x0D]*\n", text):
        lines = [terms(line) for line in paragraph.split("\n")]
        yield lines + [[t for line in lines for t in line]] if len(lines) > 1 else lines


def scan_files(files: DataFrame, min_cosine: float = 0.6) -> DataFrame:
    """Licences of files (file_id, path, text).

    Returns file_id, path, license (that of the greatest cosine; null if none), score (the cosine), licenses (all that
    a passage comes within min_cosine of as its best, by name), n_passages (how many do), license_file (it has a
    licence and is named like a licence's file), share (of its terms, those in passages that have a licence). Of equal cosines the first licence by name wins. Null text or path
    counts as empty. Every row gives one row; other columns are not read. An empty table gives no rows.
    """
    templates = Templates(*frequencies(files))

    def one(path: str, text: str) -> tuple:
        best, said, size = [], 0, 0
        for own in paragraphs(text):
            n = len(own[-1])  # the last holds all of its terms
            size, held = size + n, 0
            for words in own:
                if words and (near := templates.near(words, min_cosine)):
                    best.append(max((x, -i, name) for i, (name, x) in enumerate(near.items())))
                    held += len(words)
            said += min(n, held)
        top = max(best, default=(None, None, None))
        return top[2], top[0], sorted({x[2] for x in best}), len(best), bool(best) and bool(LICENCE_FILE.match(path.rsplit("/", 1)[-1])), said / size if size else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [one(p or "", t or "") for p, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["file_id", "path", "license", "score", "licenses", "n_passages", "license_file", "share"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "path", "text").mapInArrow(run, "file_id long, path string, license string, score double, licenses array<string>, n_passages long, license_file boolean, share double")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds effective_license and inherited_from (the directory; null where the file's own licence counts or there is none) to scan_files()'s rows.

    Directories are looked up, not files: each distinct one meets the licence files of those above it, at most as many
    as its path has parts. Of several licence files in a directory the best-scored counts, then the first by path, then by licence. A file is a directory's licence file by its name alone.
    """
    folder = F.coalesce(F.regexp_substr("path", F.lit("^.*(?=/)")), F.lit(""))
    scanned = cut(scanned.withColumn("dir", folder))
    best = F.min_by("license", F.struct(-F.col("score"), "path", "license")).alias("found")
    holders = cut(scanned.where("license_file").groupBy("dir").agg(best))
    dirs = scanned.select("dir").distinct()
    parts = F.split("dir", "/", -1)
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))).alias("x")).select("dir", "x.depth", "x.up")
    above = spread_join(cut(above), holders.select(F.col("dir").alias("up"), "found"), "up")
    nearest = cut(above.groupBy("dir").agg(F.max_by(F.struct(F.col("found").alias("license"), F.col("up").alias("up")), "depth").alias("near")))
    out = spread_join(scanned, nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select("file_id", "path", "license", "score", "licenses", "n_passages", "license_file", F.coalesce("license", "near.license").alias("effective_license"), F.when(~own, F.col("near.up")).alias("inherited_from"))


#: Share of a document's terms that say its licence from which on it is a notice.
NOTICE = 0.5


def license_of_documents(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source) as files source/lang/doc_id.txt.

    None of them is named like a licence's file. One that says little but a licence (NOTICE of its terms) is a notice
    and stands for one: those of its source and language that have no licence of their own inherit from it.
    """
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    scanned = scan_files(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return inherit(scanned.withColumn("license_file", F.col("license").isNotNull() & (F.col("share") >= NOTICE))).withColumnRenamed("file_id", "doc_id")
