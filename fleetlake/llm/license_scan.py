"""License scans: MinHash bands over overlapping text windows, verified by containment.

Templates are license notices, given as a bounded list. Each has a window size that
fits its length; all its windows are indexed, at every offset, by ``bands`` MinHash
values. Documents are cut into overlapping windows of the same sizes at half-window
steps, so that a verbatim copy of a template always holds a whole window that is
indexed: it collides with certainty, and a window of which four fifths are left
collides with probability ``1 - 0.2 ** bands``. A template so retrieved is
reported if enough of its 5-word shingles stand in the document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import mix, pieces, shingle_hashes, texts_of
from fleetlake.llm.decontaminate import Members, plain_words, short_shingles

# Wordings of public license notices.
TEMPLATES = [
    ("mit-short", "Released under the MIT License."),
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-short", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-short", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
]


@dataclass(frozen=True)
class LicenseParams:
    shingle: int = 5
    percent: int = 80
    bands: int = 6
    windows: tuple[int, ...] = (1, 4, 32)  # sizes in shingles, powers of two


def window_size(shingles: int, windows: tuple[int, ...]) -> int:
    """The largest size of which a text of so many shingles holds a whole window at any half-window offset."""
    return max([w for w in windows if shingles - w + 1 >= max(1, w // 2)], default=windows[0])


def band_values(s: np.ndarray, windows: tuple[int, ...], bands: int, every: bool) -> dict[int, np.ndarray]:
    """By window size: the banded MinHash values, one row a band and one column a window.

    ``every``: windows at each offset, else at half-window steps.
    """
    out = {}
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))[:, None]
    least, have = mix(s.view(np.uint64)[None, :] ^ seeds), 1
    for w in windows:
        while have < w and least.shape[1] > have:
            least = np.minimum(least[:, :-have], least[:, have:])
            have *= 2
        if have != w or not least.shape[1]:
            break
        step = 1 if every else max(1, w // 2)
        out[w] = mix(least[:, ::step] + mix(seeds + np.uint64(w))).view(np.int64)
    return out


class TemplateIndex:
    """Templates, each with its shingles, and band values that lead to them."""

    def __init__(self, templates: list[tuple[str, str]], p: LicenseParams):
        self.names, self.sets = [], []
        self.short: dict[int, dict[int, list[str]]] = {}  # by number of words and hash: names of shorter templates
        keys, owners = [], []
        for name, text in templates:
            h = plain_words(text.encode())
            if 0 < len(h) < p.shingle:
                self.short.setdefault(len(h), {}).setdefault(int(short_shingles(h, len(h))[0]), []).append(name)
            s = shingle_hashes(h, p.shingle).view(np.int64)
            if not len(s):
                continue
            w = window_size(len(s), p.windows)
            values = np.unique(band_values(s, p.windows, p.bands, True)[w])
            keys.append(values)
            owners += [len(self.names)] * len(values)
            self.names.append(name)
            self.sets.append(Members(s))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.owners = np.array(owners, np.int64)
        self.known = Members(self.keys)

    def retrieve(self, s: np.ndarray, p: LicenseParams) -> list[int]:
        found: set[int] = set()
        for values in band_values(s, p.windows, p.bands, False).values():
            flat = values.ravel()
            hit = np.unique(flat[self.known.find(flat)])
            if len(hit):
                found.update(self.owners[np.isin(self.keys, hit)].tolist())
        return sorted(found)


def _scan(batches, index, p: LicenseParams):
    import pyarrow as pa

    t = index.value
    for b in pieces(batches):
        out: list = []
        first: dict[int, list[int]] = {}
        for d, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            h = plain_words(text)
            for size, names in t.short.items():
                found = short_shingles(h, size)
                for at in np.flatnonzero(np.isin(found, list(names))).tolist():
                    first.setdefault(found[at].item(), [at, at])[1] = at
                for key, (a, z) in first.items():
                    out += [(d, name, 1, 1, a, z + size) for name in names[key]]
                first.clear()
            s = shingle_hashes(h, p.shingle).view(np.int64)
            for i in t.retrieve(s, p) if len(s) else ():
                at = t.sets[i].find(s)
                shared, whole = len(np.unique(s[at])), len(t.sets[i].values)
                if 100 * shared >= p.percent * whole:
                    out.append((d, t.names[i], whole, shared, int(at[0]), int(at[-1]) + p.shingle))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "n_shingles", "n_shared", "first_word", "end_word"])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, params: LicenseParams = LicenseParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_shingles, n_shared, first_word, end_word), one row for each notice found in a row.

    Words count from 0, ``end_word`` is exclusive; together they span all that the
    document shares with the template. Null, empty and short texts hold nothing,
    a template of fewer than five words is one shingle of all its words, repeated rows report each,
    and a tie isn't possible as every template is judged on its own. The templates
    go to all tasks, so their list should stay within some megabytes.
    """
    p = params
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(TEMPLATES if templates is None else templates, p))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(lambda it: _scan(it, index, p), "doc_id long, license string, n_shingles long, n_shared long, first_word long, end_word long")
