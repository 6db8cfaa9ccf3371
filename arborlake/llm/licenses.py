"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Every window of up to ``LINES`` consecutive lines of every text is compared as a
possible header, lines without a word not counted, and the text as a whole as a
possible licence file.  Templates are notices, headers and titles, short licence
texts, and long ones, which only whole texts are compared with; comment marks
are no terms.  Inverse document frequencies of the templates' terms are counted
over all texts.  Windows are only scored near lines with a term without which no
template reaches the threshold (Cauchy-Schwarz), which drops no match.  An SPDX
tag with ids of the SPDX list counts as its ids, at score 1.  A file without a
licence of its own takes that of the nearest ancestor directory with a licence
file: the distinct directories are joined with licensed ones through their
ancestors, then files with directories.

Defined cases: a null or empty text has no licence of its own; a very long text
is scored whole, its windows ``BLOCK`` lines at a time; a null path has
no directory and inherits nothing; a tag, and a licence text matched at
``WHOLE``, come before notices, then the best score, and equal scores go to the
name that sorts first; in a directory with several licence files the best score
counts, then the name; repeated rows agree; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files as resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.common import cut, fresh, quoted

# Names and notices of public licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
]
# Headers and titles of the GNU licences and Creative Commons notices, which differ in names only.
GNU = [("GPL-2.0", "GNU General Public License", "2", "June 1991"), ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"), ("LGPL-2.0", "GNU Library General Public License", "2", "June 1991"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"), ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007")]
ADDRESSES = ["You should have received a copy of the {0} along with this {1}. If not, see <https://www.gnu.org/licenses/>.", "You should have received a copy of the {0} along with this {1}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
for name, full, version, date in GNU:
    NOTICES.append((name, f"{full} Version {version}, {date}"))
    for end, thing in ((a, b) for a in ADDRESSES for b in ("program", "library")[: 2 if name.startswith("LGPL") else 1]):
        for later in (f"either version {version} of the License, or (at your option) any later version", f"version {version} of the License"):
            NOTICES.append((name, f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation; {later}. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details. {end.format(full, thing)}"))
for kind, full in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for version, where in {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}.items():
        full_ = full if version == "4.0" else full.replace("NoDerivatives", "NoDerivs")
        notice = f"This work is licensed under a Creative Commons {full_} {version} {where} License."
        url = f"http://creativecommons.org/licenses/{kind.lower()}/{version}/"
        NOTICES += [(f"CC-{kind}-{version}", x) for x in (f"Licensed under CC {kind} {version}.", notice, f"{notice} To view a copy of this license, visit {url}.", url, f"{full_} {version} {where}", f"Creative Commons {full_} {version} {where} Public License") if (f"CC-{kind}-{version}", x) not in NOTICES]
_FOLDER = resources("arborlake.llm") / "licence_texts"
TEXTS = sorted((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in _FOLDER.iterdir() if x.name.endswith(".txt"))
# The Affero licence is GPL 3 under its own name but for the section on network use.
TEXTS.append(("AGPL-3.0", dict(TEXTS)["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("29 June 2007", "19 November 2007")))
SHORT = [x for x in TEXTS if len(x[1]) < 2000]
#: Those before ``WINDOWED`` are compared with windows of lines, those from ``NOTICE`` on are licence texts.
TEMPLATES = [*NOTICES, *SHORT, *(x for x in TEXTS if x not in SHORT)]
NOTICE, WINDOWED = len(NOTICES), len(NOTICES) + len(SHORT)
#: Ids of the SPDX list by their lower-case form.
SPDX = {x.lower(): x for x in (_FOLDER / "spdx_ids").read_text("utf-8").split()}
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.IGNORECASE)
#: Most consecutive lines of a window, and lines whose windows are scored at once.
LINES, BLOCK = 40, 200
TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Least cosine of a header line, and of a whole text that counts as its directory's licence file.
HEADER, WHOLE = 0.75, 0.9
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def tagged(body: str) -> list[str]:
    """Ids of all SPDX tags, without ``-only`` and ``-or-later``."""
    ids = [SPDX.get(x.rstrip(".-").lower()) for tag in TAG.findall(body) for x in re.findall(r"[A-Za-z0-9.+-]+", re.sub(r"(?i)\bwith\s+\S+", "", tag))]
    return [re.sub(r"(-only|-or-later|\+)$", "", x) for x in ids if x]


class Matcher:
    """Templates as unit vectors, by term."""

    def __init__(self, idf: dict[str, float], unseen: float):
        self.idf, self.unseen = idf, unseen
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, (_, text) in enumerate(TEMPLATES):
            counts = Counter(terms(text))
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
            for t, n in counts.items():
                self.postings.setdefault(t, []).append((i, n * idf[t] / norm))

        self.columns, self.anchors = {}, set()
        for t, found in self.postings.items():
            self.columns[t] = np.zeros(WINDOWED)
            for i, w in found:
                if i < WINDOWED:
                    self.columns[t][i] = w
        missing = np.zeros(WINDOWED)
        # without a template's anchors, what is left of its unit vector is too short for the threshold; rare terms first
        for t in sorted(self.columns, key=lambda t: (-idf[t], t)):
            asked = (self.columns[t] > 0) & (missing <= 1 - HEADER**2 + 1e-6)
            if asked.any():
                self.anchors.add(t)
                missing[asked] += self.columns[t][asked] ** 2

    def windows(self, lines: list[list[str]]) -> np.ndarray | None:
        """Best cosine of each windowed template over all windows of ``lines``, or None where none reaches ``HEADER``."""
        lines = [x for x in lines if x]
        near = sorted({k for i, x in enumerate(lines) if not self.anchors.isdisjoint(x) for k in range(max(i - LINES + 1, 0), i + 1)})
        top = np.zeros(WINDOWED)
        while near:
            first = near[0]
            starts = [k for k in near if k < first + BLOCK]
            near = near[len(starts) :]
            part = lines[first : starts[-1] + LINES]
            places = {t: j for j, t in enumerate({t: None for x in part for t in x})}
            counts = np.zeros((len(part), len(places)))
            for i, x in enumerate(part):
                for t in x:
                    counts[i, places[t]] += 1
            counts *= np.array([self.idf.get(t, self.unseen) for t in places])
            known = [t for t in places if t in self.columns]
            dots, norms = np.zeros((len(part) + 1, WINDOWED)), np.zeros((len(part) + 1,) * 2)
            dots[1:] = np.cumsum(counts[:, [places[t] for t in known]] @ np.array([self.columns[t] for t in known]), axis=0)
            norms[1:, 1:] = np.cumsum(np.cumsum(counts @ counts.T, axis=0), axis=1)  # of a window: the sum of its square block
            at = np.array(starts) - first
            for n in range(1, min(LINES, len(part)) + 1):
                a = at[at + n <= len(part)]
                b = a + n
                top = np.maximum(top, ((dots[b] - dots[a]) / np.sqrt(norms[b, b] - norms[a, b] - norms[b, a] + norms[a, a])[:, None]).max(axis=0, initial=0.0))
        return top if top.max() >= HEADER - 1e-9 else None

    def licence(self, body: str) -> tuple[str | None, float, bool]:
        """(name or None, score, whether the whole text is a licence) of a text."""
        lines = [terms(x) for x in body.split("\n")]
        found = [(0, -1.0, x) for x in tagged(body)]
        whole = self.scores([t for x in lines for t in x], WHOLE)
        for i, score in [*enumerate(top if (top := self.windows(lines)) is not None else ()), *whole.items()]:
            if (score := round(float(score), 9)) >= HEADER:
                found.append((0 if i >= NOTICE and score >= WHOLE else 1, -score, TEMPLATES[i][0]))
        best = min(found, default=(1, 0.0, None))
        return best[2], -best[1] if found else 0.0, any(round(s, 9) >= WHOLE for s in whole.values())

    def best(self, found: list[str], least: float) -> tuple[float, str] | None:
        """Best (cosine, name) of a list of terms, if it reaches ``least``."""
        top = min(((-round(s, 9), TEMPLATES[i][0]) for i, s in self.scores(found, least).items()), default=(0.0, ""))
        return (-top[0], top[1]) if -top[0] >= least else None

    def scores(self, found: list[str], least: float) -> dict[int, float]:
        """Cosines of a list of terms to templates near or above ``least``."""
        known = Counter(t for t in found if t in self.idf)
        inside = sum((n * self.idf[t]) ** 2 for t, n in known.items())
        if not inside or inside < (least * self.unseen) ** 2 * (len(found) - sum(known.values())) * (1 - 1e-9):
            return {}
        outside = sum((n * self.unseen) ** 2 for t, n in Counter(t for t in found if t not in self.idf).items())
        norm, scores = math.sqrt(inside + outside), {}
        if math.sqrt(inside) < least * norm * (1 - 1e-9):
            return {}
        for t, n in known.items():
            for i, w in self.postings[t]:
                scores[i] = scores.get(i, 0.0) + n * self.idf[t] * w / norm
        return {i: s for i, s in scores.items() if s >= least - 1e-8}


def frequencies(files: DataFrame, text: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all texts, and that of a term none has."""
    vocabulary = sorted({t for _, x in TEMPLATES for t in terms(x)})

    def count(batches):
        n, rows, known = Counter(), 0, frozenset(vocabulary)
        for batch in batches:
            for body in batch.column(0):
                n.update(known.intersection(terms(body.as_py() or "")))
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *n], pa.string()), pa.array([rows, *n.values()], pa.int64())], names=["term", "n"])

    found = files.select(quoted(text)).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r.term: r.n for r in found.collect()}  # one row a template term
    total = n.pop("", 0)
    return {t: math.log((1 + total) / (1 + n.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + total) + 1


def scan(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``files`` with own_license, own_score, license and license_from (``own``, a directory, or null); also the names."""
    keys = ("own_license", "own_score", "license", "license_from")
    names = dict(zip(keys, fresh(files, *keys), strict=True))
    whole, folder = fresh(files, "whole_license", "license_folder")
    idf, unseen = frequencies(files, text)
    at = files.columns.index(text)
    added = [T.StructField(names["own_license"], T.StringType()), T.StructField(names["own_score"], T.DoubleType()), T.StructField(whole, T.BooleanType())]

    def run(batches):
        matcher = Matcher(idf, unseen)
        for batch in batches:
            out = [matcher.licence(body.as_py() or "") for body in batch.column(at)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in added)])

    own = files.mapInArrow(run, T.StructType([*files.schema.fields, *added]))
    own = own.withColumn(folder, F.regexp_replace(quoted(path), r"/?[^/]*$", ""))
    is_file = quoted(whole) | (quoted(names["own_license"]).isNotNull() & quoted(path).rlike(LICENSE_FILE))
    rank = F.struct((-quoted(names["own_score"])).alias("s"), quoted(names["own_license"]).alias("l"))
    # one row a folder, kept, so that texts are scanned once for this and once for the result
    summary = cut(own.where(quoted(folder).isNotNull()).groupBy(quoted(folder).alias("folder")).agg(F.min(F.when(is_file, rank)).getField("l").alias("inherited"), F.max(quoted(names["own_license"]).isNull()).alias("asks")))
    licensed = summary.where("inherited is not null").select(F.col("folder").alias("ancestor"), "inherited")
    folders = summary.where("asks").select("folder")
    steps = F.split("folder", "/")
    above = folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("depth", "ancestor"))
    # cut, so that the join with files has a shuffle of its own on both sides and a folder of many files can be split
    nearest = cut(above.join(licensed, "ancestor").groupBy("folder").agg(F.max_by(F.struct("ancestor", "inherited"), "depth").alias("near")))
    joined = own.join(nearest, quoted(folder) == F.col("folder"), "left")
    has = quoted(names["own_license"]).isNotNull()
    return joined.select(
        *[quoted(c) for c in files.columns],
        quoted(names["own_license"]),
        quoted(names["own_score"]),
        F.coalesce(quoted(names["own_license"]), F.col("near.inherited")).alias(names["license"]),
        F.when(has, "own").otherwise(F.col("near.ancestor")).alias(names["license_from"]),
    ), names


def cosine(a: str, b: str, idf: dict[str, float], unseen: float) -> float:
    """Plain cosine of two texts, for tests."""
    x, y = Counter(terms(a)), Counter(terms(b))
    keys = sorted(x.keys() | y.keys())
    u, v = (np.array([c[k] * idf.get(k, unseen) for k in keys]) for c in (x, y))
    return float(u @ v / max(np.linalg.norm(u) * np.linalg.norm(v), 1e-300))
