"""Operator 9: licence scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are runs of letters and digits in lower case, shingles are five words.  A template with s shingles is looked for in
windows of twice the next power of two, w >= s, with a stride of w, so that wherever it stands one window holds all of it.  If
at least 0.8 of its shingles stand there, their Jaccard similarity with the window is at least 0.8 s / (2 w + 0.2 s) > 0.19.
A band is one MinHash value; of 64 bands at least one agrees with a probability over 1 - 0.81 ** 64 > 0.999998.  Windows with an agreeing band are
verified: containment is the exact share of the template's distinct shingles that stand in the window.

A text that shares no shingle with any template can't agree in any band and gets no windows.  Long texts are gone through in pieces that
overlap by the largest window, so that memory doesn't grow with a text's bands.

Templates are a fixed list in this module, or one that the caller gives; their number, not the data's, sets the memory.
Texts are worked on where they lie, each as a whole: no shuffle.

Defined results: null, empty and wordless texts have no licence; of several windows the best counts, on ties the first; every template
is reported at most once for a text, in the order of their names; repeated rows are all reported; a column with the name of the output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm._text import TermHashes, add_column, found_in, held, mix64, shingles
from linkweave.session import table

BANDS, THRESHOLD = 64, 0.8
#: Shingles of a text whose bands are worked out at once (a multiple of every window's size).
PIECE = 1 << 13
KIND = "array<struct<license: string, template: string, containment: double, start_word: long, n_words: long>>"

#: Licence notices (fixed values): licence, name of the template, its text.
TEMPLATES = (
    ("MIT", "mit-line", "Released under the MIT License."),
    ("MIT", "mit-line-licensed", "Licensed under the MIT License."),
    ("MIT", "mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "apache-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "apache-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "gpl3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gpl3-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gpl2-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL", "lgpl-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "agpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "mpl-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "bsd-condition", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "bsd-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "cc-by-line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc-by-sa-line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "all-rights-reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
)

_rng = np.random.default_rng(9)
_ODD = _rng.integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def minima(hashed: np.ndarray) -> np.ndarray:
    """MinHash values of single shingles: a row for each, a column for each band."""
    return mix64(hashed[:, None] * _ODD + _ADD)


class Index:
    """Templates by the size of their windows."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...]):
        hashes = TermHashes()
        self.templates = []
        for license_id, name, text in sorted(templates, key=lambda t: (t[1], t[0])):
            words = hashes.of(text)
            if len(words) >= 5:
                distinct = np.unique(shingles(words))
                width = 1 << max(0, len(words) - 5).bit_length()
                self.templates.append((license_id, name, distinct, minima(distinct).min(0), width))
            elif len(words):
                raise ValueError(f"template {name} has fewer than five words")
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *(t[2] for t in self.templates)]))

    def scan(self, words: np.ndarray, threshold: float = THRESHOLD, piece: int = PIECE) -> list[dict]:
        if len(words) < 5:
            return []
        text = shingles(words)
        widest = max((t[4] for t in self.templates), default=1)
        piece = max(piece, widest)
        best: dict[int, dict] = {}
        for start in range(0, len(text), piece):
            # windows that begin in this piece reach into the next one
            part = text[start : start + piece + widest]
            if (found_in(part, self.known) >= 0).any():
                self._scan_piece(part, start, piece, threshold, best)
        return [best[k] for k in sorted(best)]

    def _scan_piece(self, text: np.ndarray, start: int, piece: int, threshold: float, best: dict[int, dict]) -> None:
        # Blocks of a power of two: the window that begins at a block is that block and the next.
        blocks, width = minima(text), 1
        by_width: dict[int, list[int]] = {}
        for k, template in enumerate(self.templates):
            by_width.setdefault(template[4], []).append(k)
        while by_width:
            for k in by_width.pop(width, []):
                license_id, name, distinct, signature, _ = self.templates[k]
                window = np.minimum(blocks, np.concatenate([blocks[1:], blocks[-1:]]))
                for i in np.flatnonzero((window == signature).any(1)):
                    if i * width >= piece:
                        break
                    inside = found_in(text[i * width : (i + 2) * width], distinct)
                    share = len(np.unique(inside[inside >= 0])) / len(distinct)
                    if share >= threshold and (k not in best or share > best[k]["containment"]):
                        at = np.flatnonzero(inside >= 0)
                        best[k] = {"license": license_id, "template": name, "containment": share, "start_word": int(start + i * width + at[0]), "n_words": int(at[-1] - at[0] + 5)}
            if len(blocks) % 2:
                blocks = np.concatenate([blocks, blocks[-1:]])
            blocks, width = np.minimum(blocks[::2], blocks[1::2]), width * 2


def annotate(docs: DataFrame, text: str = "text", out: str = "licenses", templates: tuple[tuple[str, str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the licence notices of each text, with the place and containment of each."""

    def prepare() -> Callable[[str | None], list[dict]]:
        hashes, index = held("terms", TermHashes), Index(templates)
        return lambda value: index.scan(hashes.of(value), threshold)

    return add_column(docs, text, out, KIND, prepare)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: a row for every document and licence template found in it."""
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.inline("licenses"))
    return found.select("doc_id", F.col("license").alias("license_id"), "template", "containment", "start_word", "n_words")
