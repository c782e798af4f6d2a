"""License notices in documents, found by MinHash bands over overlapping text windows and verified by exact shingle containment.

Words are runs without white space, lower-cased in A-Z and without marks at their ends. A template's shingles are its runs of
five words, or all its words if they are fewer. For a template with n shingles, a text is read in windows of 2 n shingles that
overlap by half, so that every run of n shingles lies in a window. A window that contains a share c of the template has a Jaccard similarity of at
least j = c n / (2 n + (1 - c) n); bands of one row each, as many as make 1 - (1 - j) ^ bands at least `recall`, retrieve the templates
that share the least hash of a band, and the exact share of the template's shingles in the window decides. Texts that have none of a
template's shingles cannot share a least hash with it, so they skip its bands.

The share asked of n shingles is ceil(0.8 n) of them, which for n < 5 is all: such short notices are found word for word only. Other
wordings are therefore listed as notices of their own, and whole texts and headers, which allow for changes, stand beside them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.9999
SEED = 20_011
#: The leading bits of a shingle's code that are looked up first.
MARK_BITS = 20

#: Notices of public licenses, as their owners or stewards word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "reserved": "All rights reserved.",
}

#: More wordings of the short notices; none is a part of another notice, which would report one notice twice.
NOTICES = {
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-terms": "under the terms of the MIT License",
    "MIT-distributed": "Distributed under the MIT License.",
    "Apache-2.0-released": "Released under the Apache License 2.0.",
    "Apache-2.0-licensed": "Licensed under the Apache License 2.0.",
    "Apache-2.0-version": "Released under the Apache License, Version 2.0.",
    "GPL-3.0-released": "Released under the GNU General Public License v3.0.",
    "GPL-2.0-terms": "under the terms of the GNU General Public License version 2",
    "GPL-3.0-terms": "under the terms of the GNU General Public License version 3",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
} | {
    f"{x}-spdx": f"SPDX-License-Identifier: {x}"
    for x in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
}


def all_templates() -> dict[str, str]:
    """The notices, and the whole texts (NAME-text) and standard headers (NAME-header) in `texts`, which the driver reads."""
    files = sorted((Path(__file__).parent / "texts").glob("*.txt"))
    return TEMPLATES | NOTICES | {f.stem if f.stem.endswith("-header") else f"{f.stem}-text": f.read_text("utf-8") for f in files}


def words_of(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""") for x in (text or "").encode("utf-8", "surrogatepass").lower().split()) if w]


class Template:
    def __init__(self, name: str, text: str, containment: float, recall: float) -> None:
        self.name, self.words = name, words_of(text)
        if not self.words:
            raise ValueError(f"template {name} has no words")
        self.k = min(SHINGLE, len(self.words))
        runs = [tuple(self.words[i : i + self.k]) for i in range(len(self.words) - self.k + 1)]
        self.shingles = set(runs)
        self.n = len(runs)
        self.need = math.ceil(containment * len(self.shingles) - 1e-9)
        j = self.need / (2 * self.n + len(self.shingles) - self.need)
        self.bands = math.ceil(math.log(1 - recall) / math.log(1 - j))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def shingle_codes(w: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code for each run of k words, from the words' codes."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(out)] + np.uint64(i + 1)
    return _mix(out)


def band_hashes(codes: np.ndarray, band: int) -> np.ndarray:
    rng = (SEED + 2 * band) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1
    return _mix(codes * np.uint64(rng) + np.uint64(band))


class Scanner:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, recall: float = RECALL) -> None:
        self.templates = [Template(n, t, containment, recall) for n, t in templates.items()]
        self.classes: dict[int, dict[int, list[Template]]] = {}
        for t in self.templates:
            self.classes.setdefault(t.k, {}).setdefault(t.n, []).append(t)
        self.least: dict[str, list[int]] = {}
        self.owners: dict[int, dict[int, list[str]]] = {k: {} for k in self.classes}
        self.marks = {k: np.zeros(1 << MARK_BITS, bool) for k in self.classes}
        for t in self.templates:
            codes = shingle_codes(word_codes(t.words), t.k)
            self.least[t.name] = [int(band_hashes(codes, b).min()) for b in range(t.bands)]
            self.marks[t.k][codes >> np.uint64(64 - MARK_BITS)] = True
            for c in set(codes.tolist()):
                self.owners[t.k].setdefault(c, []).append(t.name)

    def candidates(self, words: list[bytes]) -> Iterator[tuple[Template, int]]:
        """(template, first shingle of the window) for each window that a band retrieves."""
        of_words = word_codes(words)
        for k, of_k in self.classes.items():
            codes = shingle_codes(of_words, k)
            marked = codes[self.marks[k][codes >> np.uint64(64 - MARK_BITS)]]
            live = {name for c in marked.tolist() for name in self.owners[k].get(c, ())}
            if not live:
                continue
            by_n = {n: own for n, ts in of_k.items() if (own := [t for t in ts if t.name in live])}
            found: dict[str, np.ndarray] = {}
            for band in range(max(t.bands for ts in by_n.values() for t in ts)):
                h = band_hashes(codes, band)
                for n, ts in by_n.items():
                    if all(band >= t.bands for t in ts):
                        continue
                    half = np.minimum.reduceat(h, np.arange(0, len(h), n)) if n > 1 else h
                    window = np.minimum(half[:-1], half[1:]) if len(half) > 1 else half
                    for t in ts:
                        if band < t.bands:
                            hit = window == np.uint64(self.least[t.name][band])
                            found[t.name] = found[t.name] | hit if t.name in found else hit
            for n, ts in by_n.items():
                for t in ts:
                    for w in np.flatnonzero(found[t.name]).tolist():
                        yield t, w * n

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, words) of the best window of each template, the first among ties, if it is contained enough."""
        words = words_of(text)
        best: dict[str, tuple[float, int, int]] = {}
        for t, first in self.candidates(words):
            last = min(first + 2 * t.n, len(words) - t.k + 1)
            at: dict[tuple, int] = {}
            for i in range(first, last):
                run = tuple(words[i : i + t.k])
                if run in t.shingles:
                    at.setdefault(run, i)
            share = len(at) / len(t.shingles)
            if len(at) >= t.need and (t.name not in best or share > best[t.name][0]):
                begin = min(at.values())
                best[t.name] = share, begin, max(at.values()) + t.k - begin
        return [(name, *v) for name, v in sorted(best.items())]


def _scan(templates: dict[str, str], containment: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, containment, recall)
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column("_text")):
                for hit in scanner.scan(text.as_py()):
                    row.append(i)
                    found.append(hit)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(row, pa.int64())), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=["_id", "license", "containment", "first_word", "n_words"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """(id, license, containment, first_word, n_words): for each row of `docs` and template (all_templates() by default), the best window with at least `containment`.

    `first_word` and `n_words` are the stretch of words, from 0, between the first and the last shingle found. Null, empty and wordless texts have none;
    texts are read whole. Null and repeated ids are carried along, and repeated rows each have their matches. No templates or an empty table
    give an empty result. The templates go to every task, as a parameter of the query.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(_scan(all_templates() if templates is None else templates, containment, recall), f"_id {kind}, license string, containment double, first_word long, n_words long")
    return out.withColumnRenamed("_id", id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses found in every document. Null texts have none."""
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
