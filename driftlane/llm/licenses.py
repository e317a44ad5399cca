"""License scans by patience alignment of texts with license templates.

Words are runs of letters and digits, lower-cased (A-Z). A place is looked at if a stretch of twice
the template's length holds enough of its words. There, text and template are aligned: equal ends are
matched off, then the words that occur once in both are anchors, the longest increasing subsequence
of their places is kept, and the gaps between anchors are aligned in the same way. Coverage is the
share of the template's words that are aligned. Words that set a template apart from its siblings
(name, version, NC or SA) are its keys: each key must stand in the text word by word, and the rest of
the template is aligned on both sides of the first.

Null and empty texts have no notice. Templates without words are never found. Every notice of a text is
returned. Notices that share words (of a short template with keys, words of its keys) are one notice,
of the template with more aligned words, then the larger coverage, then by name. The best notice of a
text has the largest coverage, then more aligned words, then the first name, then the first place. Repeated rows
are scanned each for itself. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, table
from driftlane.llm.words import slices

#: Share of a template's words that must be aligned.
LEAST = 0.75
#: Notices of templates of fewer words are told apart by the places of their keys alone.
SHORT = 20
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[48:58] = NOT_ALNUM[128:] = False

# Notices and grants as their authors word them.
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.")
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version.")

TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-header": _GNU.format(name="GNU Affero General Public License", version="3"),
    "Apache": "Released under the Apache License",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-short": "Licensed under the Apache License 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "BSD": "Released under the BSD License",
    "BSD-2-Clause": _BSD_2,
    "BSD-2-Clause-header": "Released under the BSD 2-Clause License",
    "BSD-3-Clause": _BSD_2 + (
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."),
    "BSD-3-Clause-header": "Released under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-4.0-header": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0-header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "Licensed under CC0 1.0",
    "GPL": "Released under the GNU General Public License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": _GNU.format(name="GNU General Public License", version="2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": _GNU.format(name="GNU General Public License", version="3"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-header": _GNU.format(name="GNU Lesser General Public License", version="2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-header": _GNU.format(name="GNU Lesser General Public License", version="3"),
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_OF = {"AGPL": "GNU Affero General Public License", "GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License"}
#: Phrases of a template that must stand in the text as they are.
KEYS = {
    "Apache": ["Apache License"], "Apache-1.1": ["Apache License, Version 1.1"], "Apache-2.0": ["Apache License, Version 2.0"], "Apache-2.0-header": ["Apache License, Version 2.0"],
    "Apache-2.0-short": ["Apache License 2.0"],
    "BSD": ["BSD License"], "BSD-2-Clause-header": ["BSD 2-Clause"], "BSD-3-Clause": ["endorse or promote products derived from this software"],
    "BSD-3-Clause-header": ["BSD 3-Clause"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-4.0-header": ["Creative Commons Attribution 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-NC-4.0-header": ["Creative Commons Attribution-NonCommercial 4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-SA-4.0-header": ["Creative Commons Attribution-ShareAlike 4.0"], "CC0-1.0": ["CC0 1.0"], "GPL": [_OF["GPL"]], "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    **{f"{k}-{v}": [f"{_OF[k]}, version {v.removesuffix('.0')}"] for k, v in (("AGPL", "3.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"))},
    **{f"{k}-{v}-header": [_OF[k], f"version {v.removesuffix('.0')} of the License"] for k, v in (("AGPL", "3.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"))},
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting with back pointers)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, value in enumerate(values):
        pile = bisect_left(tops, value)
        tops[pile:pile + 1] = [value]
        piles[pile:pile + 1] = [k]
        back.append(piles[pile - 1] if pile else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [anchors[k] for k in increasing([q for _, q in anchors])]
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:])]
    return sorted(out)


def template_words(templates: dict[str, str]) -> dict[str, np.ndarray]:
    names = sorted(templates)
    found = {}
    for at, words in slices(pa.array([templates[n] for n in names], pa.large_string()), True, NOT_ALNUM):
        hashes = words.hashes()
        for k in range(len(words.counts)):
            if words.counts[k]:
                found[names[at + k]] = hashes[words.first[k]:words.first[k + 1]]
    return found


def places(words: np.ndarray, template: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Stretches of a text (start, end in words) that hold enough of the template's words to be aligned."""
    n = len(template)
    known = np.isin(words, template)
    if known.sum() < least * n:
        return
    total = np.concatenate([[0], np.cumsum(known)])
    reach = min(len(words), 2 * n)
    full = np.flatnonzero(total[reach:] - total[:-reach] >= least * n)
    if len(full):
        cut = np.flatnonzero(np.diff(full) > 1)
        for s, e in zip(full[np.r_[0, cut + 1]], full[np.r_[cut, len(full) - 1]]):
            yield int(s), int(e) + reach


def find(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places at which a phrase starts in a text."""
    n = len(words) - len(phrase) + 1
    at = np.flatnonzero(words[:max(0, n)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def keyed_notices(words: np.ndarray, template: np.ndarray, least: float, keys: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """As ``notices``, for a template with keys: aligned on both sides of each place of the first key."""
    out, n, wanted, upto = [], len(template), template.tolist(), 0
    spots = [int(find(template, key)[0]) for key in keys]
    q, size = spots[0], len(keys[0])
    for p in find(words, keys[0]).tolist():
        if p < upto:
            continue
        low, high = max(upto, p - 2 * q), p + size
        left = aligned(words[low:p].tolist(), wanted[:q])
        right = aligned(words[high:high + 2 * (n - q - size)].tolist(), wanted[q + size:])
        match = [(low + a, b) for a, b in left] + [(p + k, q + k) for k in range(size)] + [(high + a, q + size + b) for a, b in right]
        place = {b: a for a, b in match}
        whole = all(place.get(spot, -n) + k == place.get(spot + k) for spot, key in zip(spots, keys) for k in range(len(key)))
        if whole and len(match) >= least * n:
            out.append(match)
            upto = match[-1][0] + 1
    return out


def notices(words: np.ndarray, template: np.ndarray, least: float) -> list[list[tuple[int, int]]]:
    """Matched places (in the text, in the template) of the template's notices in a text, in order, not overlapping."""
    out, n, wanted = [], len(template), template.tolist()
    for start, end in places(words, template, least):
        at = start
        while at < end:
            upto = min(end, at + 2 * n)
            match = aligned(words[at:upto].tolist(), wanted)
            if len(match) >= least * n:
                at += match[0][0]  # the stretch may have cut the notice's end
                match = [(at + a, b) for a, b in aligned(words[at:at + 2 * n].tolist(), wanted)]
                out.append(match)
                at = match[-1][0] + 1
            else:
                at += max(1, n // 2)
    return out


def settled(found: list[tuple[int, float, str, int, int, set[int]]]) -> list[tuple[int, float, str, int, int]]:
    """(aligned words, coverage, name, start, end) of the notices that remain where several share words, by place.

    The last of the six values of ``found`` are the places that a notice must have for itself.
    """
    out, taken = [], set()
    for *notice, own in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        if taken.isdisjoint(own):
            taken |= own
            out.append(tuple(notice))
    return sorted(out, key=lambda f: (f[3], f[4], f[2]))


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_notices, license, coverage, start_word, end_word, notices of every row.

    ``notices`` holds all notices by place, the four columns before it are those of the best one, and
    null where there is none. Templates of the caller have the keys that the caller gives.
    """
    known = template_words(TEMPLATES if templates is None else templates)
    given = keys or ({} if templates is not None else KEYS)
    phrases = {name: list(template_words({str(k): p for k, p in enumerate(given.get(name, []))}).values()) for name in known}
    key_places = {name: {int(find(known[name], p)[0]) + k for p in phrases[name] for k in range(len(p))} for name in known}
    fields = ["license", "coverage", "start_word", "end_word"]
    every = np.unique(np.concatenate(list(known.values()))) if known else np.zeros(0, np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, words in slices(batch.column(1), True, NOT_ALNUM):
                hashes = words.hashes()
                total = np.concatenate([[0], np.cumsum(np.isin(hashes, every))])
                some = total[words.first[1:]] - total[words.first[:-1]]
                for k in range(len(words.counts)):
                    every_notice = []
                    if some[k]:
                        own = hashes[words.first[k]:words.first[k + 1]]
                        for name, template in known.items():
                            n = len(template)
                            if some[k] >= least * n:
                                keyed = phrases[name]
                                for m in keyed_notices(own, template, least, keyed) if keyed else notices(own, template, least):
                                    marks = {a for a, b in m if not keyed or n >= SHORT or b in key_places[name]}
                                    every_notice.append((len(m), len(m) / n, name, m[0][0], m[-1][0] + 1, marks))
                    kept = settled(every_notice)
                    best = min(kept, key=lambda f: (-f[1], -f[0], f[2], f[3]))[1:] if kept else (None,) * 4
                    rows.append((len(kept), best[1], best[0], *best[2:], [dict(zip(fields, (f[2], f[1], *f[3:]))) for f in kept]))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            kinds.append(pa.list_(pa.struct(list(zip(fields, kinds[1:])))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_notices", *fields, "notices"])

    own = "license string, coverage double, start_word long, end_word long"
    return documents.select("doc_id", "text").mapInArrow(
        scan, f"doc_id long, n_notices long, {own}, notices array<struct<license:string,coverage:double,start_word:long,end_word:long>>")


@bound("op1_licenses")
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 9))
    return found.withColumn("notices", F.transform("notices", lambda n: n.withField("coverage", F.round(n["coverage"], 9))))
