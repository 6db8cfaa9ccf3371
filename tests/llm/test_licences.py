"""Licence texts, wrapped headers, tags and windows of lines."""

import random
import textwrap
from collections import Counter

import pytest

from arborlake.llm import licenses

TEXTS = dict(licenses.TEXTS)
GNU = "This {1} is free software{3} you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.\n\nThis {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details.\n\nYou should have received a copy of the {0} along with this {1}. If not, see <http://www.gnu.org/licenses/>."
MIT = TEXTS["MIT"].strip()
CASES = {
    "mit": ("MIT", f"Copyright (c) 2020 A. Person\n\n{MIT}"),
    "mit, part": ("MIT", MIT[: MIT.index("NONINFRINGEMENT") + 15]),
    "mit, titled": ("MIT", f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{MIT}"),
    "mit, in code": ("MIT", "\n".join(f"// {x}" for x in MIT.split("\n")) + "\nint main() { return 0; }" * 50),
    "gpl 3": ("GPL-3.0", GNU.format("GNU General Public License", "program", "3", ":")),
    "gpl 2": ("GPL-2.0", GNU.format("GNU General Public License", "program", "2", ";")),
    "lgpl 2.1": ("LGPL-2.1", GNU.format("GNU Lesser General Public License", "library", "2.1", ";")),
    "lgpl program": ("LGPL-2.1", GNU.format("GNU Lesser General Public License", "program", "2.1", ":")),
    "agpl 3": ("AGPL-3.0", GNU.format("GNU Affero General Public License", "program", "3", ":")),
    "bsd, opening": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"),
    "bsd 2": ("BSD-2-Clause", TEXTS["BSD-2-Clause"].replace("OWNER", "HOLDER")),
    "apache title": ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
    "gpl title": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"),
    "gpl file": ("GPL-3.0", TEXTS["GPL-3.0"].replace("<year>", "2020")),
    "apache file": ("Apache-2.0", TEXTS["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A. Person")),
    "spdx": ("MIT", "// SPDX-License-Identifier: MIT\nint x;"),
    "spdx, later": ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
    "spdx, exception": ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception"),
    "cc title": ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike 4.0 International"),
    "cc url": ("CC-BY-ND-4.0", "see\nhttp://creativecommons.org/licenses/by-nd/4.0/\n"),
    "prose": (None, "the license of the work\nunder the law of the land, with any version\nof the software"),
    "unknown tag": (None, "SPDX-License-Identifier: nothing-such"),
}


def layouts(text):
    wrapped = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, 70), ""]]
    yield text
    yield "\n".join(wrapped)
    yield "#!/bin/sh\n\n" + "\n".join(f" * {x}" for x in wrapped) + "\n */\n" + "\n".join(f"call{i}(x);" for i in range(90))


@pytest.mark.parametrize("case", CASES)
def test_known_licences(spark, case):
    want, text = CASES[case]
    # the short notices wholly, long files only as they are: commented, they are no whole text
    tried = list(layouts(text))[: 1 if case.endswith("file") else 3]
    rows = [(i, x, f"r/{i}.c") for i, x in enumerate(tried)] + [(100 + i, "word " * (i % 5), "q/z") for i in range(60)]
    found, n = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string, path string"))
    assert [r[n["own_license"]] for r in found.where("doc_id < 100").orderBy("doc_id").collect()] == [want] * len(tried)
    assert found.where("doc_id >= 100 and license is not null").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_windows_against_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(licenses, "LINES", 4)
    monkeypatch.setattr(licenses, "BLOCK", 7)
    idf = {t: 1 + (i * 7 % 11) / 2 for i, t in enumerate(sorted({t for _, x in licenses.TEMPLATES for t in licenses.terms(x)}))}
    matcher = licenses.Matcher(idf, 6.5)
    lines = []
    while len(lines) < 60:
        if rng.random() < 0.3:
            lines += textwrap.wrap(rng.choice(licenses.TEMPLATES[: licenses.WINDOWED])[1], rng.choice([30, 70, 400]))[:5]
        lines += [" ".join(rng.choice(["zz", "license", "the", "2.0", "gnu", "yy"]) for _ in range(rng.randint(0, 6)))]
    words = [x for x in map(licenses.terms, lines) if x]
    shown = [(i, x) for i, (_, x) in enumerate(licenses.TEMPLATES[: licenses.WINDOWED]) if i % 6 == seed]
    best = Counter()
    for a in range(len(words)):
        for b in range(a + 1, min(a + 4, len(words)) + 1):
            window = " ".join(t for x in words[a:b] for t in x)
            for i, x in shown:
                best[i] = max(best[i], licenses.cosine(window, x, idf, 6.5))
    got = matcher.windows([licenses.terms(x) for x in lines])
    for i, _ in shown:
        if best[i] >= licenses.HEADER:
            assert got[i] == pytest.approx(best[i], abs=1e-9)
        else:
            assert got is None or got[i] < licenses.HEADER
