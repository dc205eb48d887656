"""License scans: patience alignment of a text's words with licence templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, texts

# Notices and headers of public licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}

#: Letters and digits in lower case, all other ASCII characters blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def patience(a: list[bytes], b: list[bytes], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned places of equal words in two lists.

    Equal heads and tails are aligned first. Words that stand once in each list are anchors; the longest increasing
    subsequence of their places is kept, and the gaps between are aligned the same way. A gap without such a word
    takes, word by word, the next equal one.
    """
    stack, out = [(0, len(a), 0, len(b))], []
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: y for y, w in enumerate(b[k:m], k) if in_b[w] == 1}
        pairs = [(x, place[w]) for x, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place]
        if pairs:
            tails, ends, back = [], [], [-1] * len(pairs)
            for n, (_, y) in enumerate(pairs):
                at = bisect_left(tails, y)
                tails[at:at + 1] = [y]
                ends[at:at + 1] = [n]
                back[n] = ends[at - 1] if at else -1
            n, kept = ends[-1], []
            while n >= 0:
                kept.append(pairs[n])
                n = back[n]
            x0, y0 = i, k
            for x, y in kept[::-1]:
                out.append((x, y))
                stack.append((x0, x, y0, y))
                x0, y0 = x + 1, y + 1
            stack.append((x0, j, y0, m))
        else:
            y = k
            for x in range(i, j):
                z = next((z for z in range(y, m) if b[z] == a[x]), None)
                if z is not None:
                    out.append((x, z))
                    y = z + 1
    return sorted((x + a0, y + b0) for x, y in out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.words = {name: words_of(t) for name, t in templates.items()}
        self.counts = {name: Counter(w) for name, w in self.words.items()}
        self.all = frozenset(w for t in self.words.values() for w in t)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """``(template, coverage, first word, end word)`` of each place where a template is covered.

        A template covered to a share of c has that share of its words in the text, so texts without them are left
        at once. Places are found from the template's word pairs: their offsets against the template are clustered,
        each cluster's stretch is aligned, and a stretch counts for the template with the best coverage and most words.
        """
        if not text:
            return []
        words = words_of(text)
        here = self.all & set(words)
        if not here:
            return []
        found = []
        for name, template in self.words.items():
            possible = sum(n for w, n in self.counts[name].items() if w in here)
            if possible < self.coverage * len(template):
                continue
            n, pairs = len(template), {}
            for y, p in enumerate(zip(template, template[1:], strict=False)):
                pairs.setdefault(p, []).append(y)
            offsets = sorted({x - y for x, p in enumerate(zip(words, words[1:], strict=False)) for y in pairs.get(p, ())})
            at = 0
            while at < len(offsets):
                end = at
                while end + 1 < len(offsets) and offsets[end + 1] - offsets[at] <= n // 4:
                    end += 1
                first, last = max(0, offsets[at] - 2), min(len(words), offsets[end] + n + 2)
                got = patience(words[first:last], template, first)
                share = len(got) / n
                if share >= self.coverage:
                    found.append((name, share, got[0][0], got[-1][0] + 1, len(got)))
                at = end + 1
        found.sort(key=lambda f: (-f[4], -f[1], f[0], f[2]))
        kept = []
        for f in found:  # a shorter template inside what a longer one covers says nothing new
            if all(f[3] <= g[2] or f[2] >= g[3] for g in kept):
                kept.append(f)
        return sorted(((f[0], f[1], f[2], f[3]) for f in kept), key=lambda f: f[2])


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, coverage, start_word, end_word`` of each place in a text that covers a template.

    Words are runs of letters and digits, A-Z in lower case. Places that overlap go to the template with most aligned
    words. Null and empty texts have no places; repeated rows repeat theirs; null ids go through; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        scanner = Scanner(chosen, coverage)
        for b in batches:
            rows = [(i, *f) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for f in scanner.scan(t)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "license", "coverage", "start_word", "end_word"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, license string, coverage double, start_word int, end_word int")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
