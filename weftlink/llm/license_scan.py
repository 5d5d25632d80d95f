"""Licence scan: sparse TF-IDF cosine of texts to licence templates, inherited down the directory tree.

Every line of a file and its joined lines (a header may stand anywhere, wrapped or not) and, for licence files, the whole
text are compared to several templates of each licence.
A file without a licence of its own takes that of the nearest ancestor directory whose licence file has one.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.shared import slices, stored

# Public licence texts, standard headers and short notices by SPDX identifier. A GPL named without a version
# is, by its own terms, of any version.
TEMPLATES = {
    "AGPL-3.0": (
        "GNU Affero General Public License Version 3, 19 November 2007",
        "GNU Affero General Public License version 3",
        "GNU Affero General Public License v3 or later",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This project is licensed under the AGPL v3 license.",
        "AGPL 3",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License.",
        "SPDX-License-Identifier: AGPL-3.0",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License 2.0",
        "This project is licensed under the Apache 2.0 license.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": (
        "BSD 2-Clause License",
        "Simplified BSD License",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 3-Clause License",
        "New BSD License",
        "This project is licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0.",
        "Licensed under CC BY 4.0.",
        "Creative Commons Attribution 4.0 International Public License",
        "Attribution 4.0 International Creative Commons Corporation",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License, CC BY-NC 4.0.",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
        "Attribution-NonCommercial 4.0 International Creative Commons Corporation",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0.",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License",
        "Attribution-ShareAlike 4.0 International Creative Commons Corporation",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0-1.0": (
        "Creative Commons Legal Code CC0 1.0 Universal",
        "CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "GPL-1.0-or-later": (
        "GNU General Public License",
        "Licensed under the GNU General Public License.",
        "GNU GPL",
        "SPDX-License-Identifier: GPL-1.0-or-later",
    ),
    "GPL-2.0": (
        "GNU General Public License Version 2, June 1991",
        "GNU General Public License version 2",
        "GNU General Public License v2 or later",
        "This work is licensed under the GNU General Public License, version 2.",
        "This project is licensed under the GPL v2 license.",
        "GPL 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "GNU General Public License Version 3, 29 June 2007",
        "GNU General Public License version 3",
        "GNU General Public License v3 or later",
        "This work is licensed under the GNU General Public License, version 3.",
        "This project is licensed under the GPL v3 license.",
        "GPL 3",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted under the ISC License.",
        "This project is licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-2.0": (
        "GNU Library General Public License Version 2, June 1991",
        "GNU Library General Public License version 2",
        "GNU Library General Public License v2 or later",
        "This work is licensed under the GNU Library General Public License, version 2.",
        "This project is licensed under the LGPL v2 license.",
        "LGPL 2",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, version 2 of the License.",
        "SPDX-License-Identifier: LGPL-2.0",
        "SPDX-License-Identifier: LGPL-2.0-or-later",
        "SPDX-License-Identifier: LGPL-2.0-only",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1.",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "GNU Lesser General Public License version 2.1",
        "GNU Lesser General Public License v2.1 or later",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This project is licensed under the LGPL v2.1 license.",
        "LGPL 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1 of the License.",
        "SPDX-License-Identifier: LGPL-2.1",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "LGPL-3.0": (
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "GNU Lesser General Public License version 3",
        "GNU Lesser General Public License v3 or later",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This project is licensed under the LGPL v3 license.",
        "LGPL 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License.",
        "SPDX-License-Identifier: LGPL-3.0",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "This project is licensed under the MIT License.",
        "This file is distributed under the MIT license, see LICENSE for details.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "This project is licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "The Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
# Words of which a text must have one of each group to be that licence: the names and versions that tell it from others.
MARKS = {
    "AGPL-3.0": ("affero agpl", "3"),
    "Apache-2.0": ("apache", "2", "license licensed licenses"),
    "BSD-2-Clause": ("bsd redistributions", "clause style license licensed redistributions"),
    "BSD-3-Clause": ("bsd redistributions", "clause style license licensed redistributions"),
    "CC-BY-4.0": ("cc creative", "by attribution", "4"),
    "CC-BY-NC-4.0": ("cc creative", "nc noncommercial", "4"),
    "CC-BY-SA-4.0": ("cc creative", "sa sharealike", "4"),
    "CC0-1.0": ("cc0",),
    "GPL-1.0-or-later": ("gpl general", "gpl gnu"),
    "GPL-2.0": ("gpl gnu", "2"),
    "GPL-3.0": ("gpl gnu", "3"),
    "ISC": ("isc permission", "license licensed granted"),
    "LGPL-2.0": ("lgpl library", "2"),
    "LGPL-2.1": ("lgpl lesser", "2", "1"),
    "LGPL-3.0": ("lgpl lesser", "3"),
    "MIT": ("mit permission", "license licensed granted"),
    "MPL-2.0": ("mpl mozilla", "2"),
    "Unlicense": ("unlicense unencumbered",),
}
# Words that name another licence than the one they stand beside.
OTHERS = {
    "Apache-2.0": "llvm",
    "BSD-2-Clause": "endorse",
    "CC-BY-4.0": "nc noncommercial sa sharealike nd noderivatives noderivs",
    "CC-BY-NC-4.0": "sa sharealike nd noderivatives noderivs",
    "CC-BY-SA-4.0": "nc noncommercial nd noderivatives noderivs",
    "GPL-1.0-or-later": "affero agpl lesser lgpl library 2 3",
    "GPL-2.0": "affero agpl lesser lgpl",
    "LGPL-2.0": "lesser",
    "GPL-3.0": "affero agpl lesser lgpl",
    "MIT": "isc fee",
}
# The names of licence files, in lower case: LICENSE, licence.md, COPYING.LESSER, LICENSE-MIT, MIT-LICENSE.txt, UNLICENSE.
LICENSE_FILE = r"^((mit|apache|bsd|a?gpl|lgpl|mpl|isc|cc0)[-_.])?((un)?licen[cs]es?|copying|copyright)([-_.](mit|isc|apache|bsd|mpl|a?gpl|lgpl|lesser|cc|cc0|unlicense|v?[0-9]|[0-9a-z]*clause)[-_.0-9a-z]*)?([.](txt|md|rst|html?|text|adoc))?$"
_FILE = re.compile(LICENSE_FILE)
_WORD = re.compile(r"[a-z0-9]+")
_VERSION = re.compile(r"(?:(?<![a-z])|(?<=gpl)|(?<=apache))v?(?=[0-9])")


def words(text: str) -> list[str]:
    """Lower-case words; 'licence' as 'license', and a version's v is left out."""
    return _WORD.findall(_VERSION.sub(" ", text.lower().replace("licence", "license")))


class Templates:
    """Vectors of every template. A word weighs by how few of the licences have it, so the weights depend on neither the
    table nor its size; words of no template weigh as one that half of the licences have."""

    def __init__(self, threshold: float, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.threshold, self.unseen = threshold, log(2) + 1
        held = Counter(w for ts in templates.values() for w in {w for t in ts for w in words(t)})
        self.idf = {w: log((1 + len(templates)) / (1 + n)) + 1 for w, n in held.items()}
        #: licence, vector, its length, square that shared words must reach, words of a window at most
        self.vectors: list[tuple[str, dict[str, float], float, float, int]] = []
        self.holders: dict[str, list[tuple[int, float]]] = {}
        for name, texts in sorted(templates.items()):
            for text in texts:
                n = Counter(words(text))
                v = {w: k * self.idf[w] for w, k in n.items()}
                norm = sum(x * x for x in v.values())
                for w, x in v.items():
                    self.holders.setdefault(w, []).append((len(self.vectors), x * x))
                self.vectors.append((name, v, sqrt(norm), threshold * threshold * norm * (1 - 1e-9), 2 * n.total() + 16))
        self.marks = {k: [frozenset(g.split()) for g in MARKS.get(k, ())] for k in templates}
        self.others = {k: frozenset(OTHERS.get(k, "").split()) for k in templates}

    def possible(self, seen: set[str]) -> list[int]:
        """Templates that a part of a text with these words can reach: by Cauchy and Schwarz a cosine is at most the share of
        the template's length that lies on shared words, and the marks must be there."""
        held: dict[int, float] = {}
        for w in seen:
            for k, x in self.holders.get(w, ()):
                held[k] = held.get(k, 0.0) + x
        return [k for k, x in held.items() if x >= self.vectors[k][3] and not any(g.isdisjoint(seen) for g in self.marks[self.vectors[k][0]])]

    def scan(self, text: str, whole: bool) -> tuple[str | None, float]:
        """The best match of any line, of any joined lines of at most twice the template's words and 16 more, and of the
        whole text for a licence file. Of equal ones the longer template stands, then the first by name."""
        found: tuple[float, float, str] | None = None
        chosen = self.possible(set(words(text)))
        if not chosen:
            return None, 0.0
        lines = [x for x in map(words, text.split("\n")) if x]
        for k in chosen:
            name, t, _, need, most = self.vectors[k]
            near: Counter = Counter()  # the template's words in the lines from i to before hi
            n = hi = 0
            held = 0.0
            for i, first in enumerate(lines):
                while hi < len(lines) and (hi <= i or n + len(lines[hi]) <= most):
                    n += len(lines[hi])
                    for w in lines[hi]:
                        if w in t:
                            held += 0.0 if near[w] else t[w] * t[w]
                            near[w] += 1
                    hi += 1
                # a window without its first line is no worse where that shares no word
                if held >= need * (1 - 1e-9) and not t.keys().isdisjoint(first):
                    found = self._best(k, lines[i:hi], False, found)
                n -= len(first)
                for w in first:
                    if w in t:
                        near[w] -= 1
                        held -= 0.0 if near[w] else t[w] * t[w]
            if whole:
                found = self._best(k, lines, True, found)
        return (found[2], -found[0]) if found else (None, 0.0)

    def _best(self, k: int, lines: list[list[str]], last: bool, found: tuple[float, float, str] | None) -> tuple[float, float, str] | None:
        """The better of ``found`` and template ``k`` for the lines from the first on, up to any or just to the last."""
        name, t, size, need, _ = self.vectors[k]
        seen: Counter = Counter()
        dot = norm = held = 0.0
        for j, line in enumerate(lines, 1):
            for w in line:
                weight, c, x = self.idf.get(w, self.unseen), seen[w], t.get(w, 0.0)
                norm += weight * weight * (2 * c + 1)
                dot += weight * x
                held += 0.0 if c else x * x
                seen[w] = c + 1
            if held < need or last and j < len(lines):
                continue
            cos = round(dot / (sqrt(norm) * size), 9)
            if cos >= self.threshold and (found is None or (-cos, -size, name) < found):
                if self.others[name].isdisjoint(seen) and not any(g.isdisjoint(seen) for g in self.marks[name]):
                    found = (-cos, -size, name)
        return found


def _parent(path: Column) -> Column:
    """The directory of a path; '' is the root, null above it."""
    return F.when(path == "", F.lit(None).cast("string")).when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def license_scan(files: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(``id_col``, own_license, own_score, license, origin, depth), one row per input row.

    ``own_license``: the best template of the file's lines and joined lines (a licence file: also of its whole text) with a cosine of at
    least ``threshold``; ``license``: that, or the one of the nearest ancestor directory with a licensed licence file
    (of several there the best score, then name); ``origin``: 'own', 'inherited' or 'none'; ``depth``: directories between,
    null unless inherited. Null or empty texts have no licence of their own; files with a null path inherit nothing.
    Repeated rows and null ids pass through; an empty table gives an empty table. A
    file's own licence depends on its path and text alone, not on the other rows.
    """
    d = files.select(F.col(id_col).alias("wl_id"), F.trim(F.col(path_col), F.lit("/")).alias("wl_path"), F.coalesce(F.col(text_col), F.lit("")).alias("wl_text"))
    t = Templates(threshold)

    def run(batches):
        for batch in batches:
            for b in slices(batch, 2):
                got = [t.scan(x, bool(p) and bool(_FILE.match(p.rsplit("/", 1)[-1].lower()))) for p, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["wl_id", "wl_path", "own_license", "own_score"])

    kind = d.dtypes[0][1]
    # every text is scanned once, though three steps below read what was found
    own = stored(d.mapInArrow(run, f"wl_id {kind}, wl_path string, own_license string, own_score double"), "licenses")
    name = F.lower(F.element_at(F.split("wl_path", "/"), -1))
    granted = own.filter(F.col("own_license").isNotNull() & name.rlike(LICENSE_FILE)).select(
        _parent(F.col("wl_path")).alias("wl_dir"), F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l")).alias("wl_grant")
    )
    granted = granted.groupBy("wl_dir").agg(F.min("wl_grant").alias("wl_grant"))
    # distinct directories only: their ancestors are few, whatever the number of files in one
    dirs = own.select(_parent(F.col("wl_path")).alias("wl_at")).filter("wl_at is not null").distinct()
    parts = F.split("wl_at", "/")
    depth = F.when(F.col("wl_at") == "", 0).otherwise(F.size(parts))
    up = dirs.select("wl_at", F.explode(F.sequence(F.lit(0), depth)).alias("wl_up"), parts.alias("wl_parts"), depth.alias("wl_size")).select(
        "wl_at", "wl_up", F.array_join(F.slice("wl_parts", 1, F.col("wl_size") - F.col("wl_up")), "/").alias("wl_dir")
    )
    nearest = up.join(granted, "wl_dir").groupBy("wl_at").agg(F.min(F.struct("wl_up", "wl_grant")).alias("wl_near"))
    out = own.withColumn("wl_at", _parent(F.col("wl_path"))).join(nearest, "wl_at", "left")
    inherited = F.col("own_license").isNull() & F.col("wl_near").isNotNull()
    return out.select(
        F.col("wl_id").alias(id_col),
        "own_license",
        "own_score",
        F.coalesce("own_license", F.col("wl_near.wl_grant.l")).alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("wl_near.wl_up")).alias("depth"),
    )
