"""License scans: TF-IDF cosine of headers and licence files to templates, inherited by directory.

Units are runs of one to three lines of a text (headers, which may be wrapped) and the whole text
(a licence file). A run that denies its licence ("not licensed under") counts for nothing. A unit and the
templates are sparse TF-IDF vectors over words; inverse document frequencies come from the
templates, and a word outside them has the largest one, so foreign words lower the cosine. The
best template at ``THRESHOLD`` or more is the unit's licence. Whole texts are also compared with the
licences in full, which have vectors and frequencies of their own: there a word counts 1 + ln(count), so
that the frequent words of any prose don't decide. A file that is itself a licence
(its whole text matches, or a run with at least half its words, or any run of a file named like
LICENSE or COPYING) licenses its directory, and a file without a licence of its own inherits from the nearest ancestor directory: the ancestors
of the distinct directories are joined on their paths, and the longest match stays. Directories
that hold many files are answered by a broadcast of fixed length.

Defined results: null and empty texts have no licence; a null path is the file ''; ties go to
the first template by name; several licence files in a directory: the greatest similarity,
then the first name; repeated rows give repeated results; very long texts are compared whole; input
columns named like an output give way to it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.license_texts import FULL
from wayloom.llm.shared import carry, ship, spread_join, store
from wayloom.llm.text import ALNUM, Words, chunks, norm_bytes

THRESHOLD = 0.6
#: Lines of the longest run.
RUN = 3
# Words that deny a licence, and names of licence files.
DENIAL = ("not", "licensed", "released", "distributed", "available", "covered", "governed", "subject", "under")
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright)([._-][^/]*)?$"
# Licence identifiers and the wording of their notices.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


class Templates:
    """TF-IDF vectors of the templates, one row each, over the words of all of them."""

    def __init__(self, templates: dict[str, tuple[str, ...]], damped: bool = False):
        self.damped = damped
        rows = [(name, t) for name in sorted(templates) for t in templates[name]]
        self.names = [n for n, _ in rows]
        w = Words([norm_bytes(t) for _, t in rows], ALNUM)
        self.vocab, term = np.unique(w.hashes(), return_inverse=True)
        tf = np.zeros((len(rows), len(self.vocab)))
        np.add.at(tf, (w.text, term), 1)
        tf = self.count(tf)
        self.idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1
        self.foreign = np.log(1 + len(rows)) + 1
        self.unit = tf * self.idf
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)

    def count(self, tf: np.ndarray) -> np.ndarray:
        return np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) if self.damped else tf

    def terms(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)

    def best(self, term: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best template and cosine of each of n units; ``term`` is -1 for foreign words, each of which counts alone."""
        known = term >= 0
        pair, tf = np.unique(unit[known] * len(self.vocab) + term[known], return_counts=True)
        row, col = pair // len(self.vocab), pair % len(self.vocab)
        weight = self.count(tf) * self.idf[col]
        norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=n) + np.bincount(unit[~known], minlength=n) * self.foreign**2)
        best, cosine = np.zeros(n, dtype=np.int64), np.zeros(n)
        for k, t in enumerate(self.unit):
            c = np.bincount(row, weights=weight * t[col], minlength=n) / np.maximum(norm, 1e-12)
            better = c > cosine + 1e-12
            best[better], cosine[better] = k, c[better]
        return best, cosine


def _runs(size: int, t: Templates, term: np.ndarray, index: np.ndarray, owner: np.ndarray, denied: np.ndarray, n_text: np.ndarray, threshold: float, first: int, lic: list, sim: np.ndarray, whole: np.ndarray) -> None:
    """Compares all runs of ``size`` lines with words; a run is named by its first line."""
    n = len(owner)
    start = np.arange(n)
    ok = start + size <= n
    ok[ok] &= owner[start[ok] + size - 1] == owner[start[ok]]
    for k in range(size):
        ok[ok] &= ~denied[start[ok] + k]
    words, known = np.bincount(index, minlength=n), np.bincount(index, weights=term >= 0, minlength=n)
    total = lambda x: np.convolve(x, np.ones(size))[size - 1 : size - 1 + n]
    # a run needs two words of the templates, and more than a few of them among its words
    some = ok & (total(known) >= 2) & (4 * total(known) >= total(words)) if n else ok
    if not some.any():
        return
    code = np.full(n + size, -1)
    code[:n][some] = np.arange(int(some.sum()))
    unit, at = [], []
    for k in range(size):  # every word is in a run that starts k lines before
        u = np.where(index >= k, code[index - k], -1)
        at.append(np.flatnonzero(u >= 0))
        unit.append(u[at[-1]])
    held = np.flatnonzero(some)
    best, cosine = t.best(term[np.concatenate(at)], np.concatenate(unit), len(held))
    n_run = total(words)
    for k in np.flatnonzero(cosine >= threshold):
        d = owner[held[k]]
        whole[first + d] |= bool(2 * n_run[held[k]] >= n_text[d])
        if cosine[k] > sim[first + d] + 1e-12:
            lic[first + d], sim[first + d] = t.names[best[k]], cosine[k]


def _scan(templates: dict[str, tuple[str, ...]], full: dict[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, f = Templates(templates), Templates({k: (v,) for k, v in full.items()}, damped=True) if full else None
        negation = Words([x.encode() for x in DENIAL], ALNUM).hashes()
        for b in batches:
            names = b.schema.names
            lic, sim, whole = [None] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=bool)
            for first, bodies in chunks(norm_bytes(x) for x in b.column(names.index("_text")).to_pylist()):
                w = Words(bodies, ALNUM)
                h, n_text = w.hashes(), np.diff(w.first)
                term = t.terms(h)
                line = np.searchsorted(np.flatnonzero(w.buf == 10), w.start)  # texts end with a line feed too
                lines, index = np.unique(line, return_inverse=True)
                owner = np.zeros(len(lines), dtype=np.int64)
                owner[index] = w.text
                denied = np.zeros(len(lines), dtype=bool)
                if len(h) > 1:
                    denied[index[:-1][(h[:-1] == negation[0]) & np.isin(h[1:], negation[1:])]] = True
                tb, tc = t.best(term, w.text, len(bodies))
                tc[owner[denied]] = 0
                for k in np.flatnonzero(tc >= threshold):
                    lic[first + k], sim[first + k], whole[first + k] = t.names[tb[k]], tc[k], True
                if f:
                    fb, fc = f.best(f.terms(h), w.text, len(bodies))
                    for k in np.flatnonzero((fc >= threshold) & (fc > sim[first : first + len(bodies)])):
                        lic[first + k], sim[first + k], whole[first + k] = f.names[fb[k]], fc[k], True
                for run_ in range(1, RUN + 1):
                    _runs(run_, t, term, index, owner, denied, n_text, threshold, first, lic, sim, whole)
            new = {"license": pa.array(lic, pa.string()), "similarity": pa.array(sim), "is_license_file": pa.array(whole)}
            kept = [c for c in names if c not in ("_text", *new)]
            yield pa.RecordBatch.from_arrays([b.column(names.index(c)) for c in kept] + list(new.values()), names=[*kept, *new])

    return run


def parent(path: Column) -> Column:
    """The directory of a path; '' for a file at the top."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def scan_licenses(files: DataFrame, path: Column, text_col: str = "text", templates: dict | None = None, threshold: float = THRESHOLD, full: dict | None = None) -> DataFrame:
    """The rows of ``files``, without their text, with path, license, similarity, is_license_file, inherited_license and license_dir.

    Own ``templates`` come without licences in full, unless ``full`` gives them.
    """
    ship(files.sparkSession)
    rows = carry(files.withColumn("_path", F.coalesce(path.cast("string"), F.lit(""))))
    text, at = f"_c{files.columns.index(text_col)}", f"_c{len(files.columns)}"
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != text}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", license string, similarity double, is_license_file boolean"
    found = rows.select(*kinds, F.col(text).cast("string").alias("_text")).mapInArrow(_scan(templates or TEMPLATES, (full or {}) if templates else (FULL if full is None else full), threshold), schema)
    named = F.col("license").isNotNull() & F.col(at).rlike(FILE_NAME)
    found = store(found.withColumn("is_license_file", F.col("is_license_file") | named).withColumn("dir", parent(F.col(at))), "licenses")
    licensed = found.where("is_license_file").groupBy("dir").agg(F.max(F.struct("similarity", F.col("license"))).alias("l")).select(F.col("dir").alias("license_dir"), F.col("l.license").alias("inherited"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    dirs = found.groupBy("dir").agg(F.count("*").alias("files")).select("dir", "files", F.explode(above).alias("license_dir"))
    nearest = dirs.join(licensed, "license_dir").groupBy("dir").agg(F.max("files").alias("files"), F.max(F.struct(F.length("license_dir").alias("n"), "license_dir", "inherited")).alias("l"))
    out = spread_join(found, nearest, "dir", "files", found.count(), "left").withColumns({"path": F.col(at), "inherited_license": F.when(F.col("license").isNull(), F.col("l.inherited")), "license_dir": F.when(F.col("license").isNull(), F.col("l.license_dir"))})
    added = ("path", "license", "similarity", "is_license_file", "inherited_license", "license_dir")
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(files.columns) if c != text_col and c not in added]
    return out.select(*own, *added)
