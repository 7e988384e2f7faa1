import pytest

from matchloom.llm.licenses import NOTICES, bigrams, scan_notices

from .conftest import rows

# Written apart from NOTICES, as they stand in files and documents.
FOUND = [
    ("Released under the MIT License.", "MIT"),
    ("All rights reserved.", "proprietary"),
    ("Copyright (c) 2019 Some One. All rights reserved. Contact us for terms.", "proprietary"),
    ("// Released under the MIT License. Copyright 2021 by the team", "MIT"),
    ("The tool is nice and small. It is licensed under the Apache License,\n# Version 2.0, so use it as you like.", "Apache-2.0"),
    ("/*\n * SPDX-License-Identifier: GPL-3.0-or-later\n */", "GPL-3.0"),
    ("MIT License\n\nCopyright (c) 2020", "MIT"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
     "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
     "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
     "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n"
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\n"
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.", "MIT"),
    ("# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
     "# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.", "GPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("pictures: CC BY-NC 4.0, texts are ours", "CC-BY-NC-4.0"),
]
NONE = [None, "", "license", "The permission was granted and the software license was renewed.", "All the rights were reserved for them.", "Released under the moon. The license of MIT students."]


def brute(text, at_least=0.8):
    """Every run of every length from every place."""
    out, least = {}, at_least / (2 - at_least)
    import re
    w = re.findall(r"[^\W_]+", (text or "").lower())
    p = [f"{a} {b}" for a, b in zip(w, w[1:])]
    for name, t, must, lacks in NOTICES:
        own, n = set(bigrams(t)), len(re.findall(r"[^\W_]+", t)) - 1
        for i in range(len(p)):
            seen = set()
            for x in p[i:i + int(n / least + 1e-9)]:
                seen.add(x)
                d = 2 * len(seen & own) / (len(seen) + len(own))
                if d >= at_least and set(must) <= seen and not set(lacks) & seen:
                    out[name] = max(out.get(name, 0), d)
    return out


def test_notices_written_by_others_are_found(table):
    docs = [(k, "Some prose first.\n" * (k % 2) + t + "\nand prose after it" * (k % 3)) for k, (t, _) in enumerate(FOUND)] + [(100 + k, t) for k, t in enumerate(NONE)]
    got = rows(scan_notices(table(docs, clash=True)), "doc_id", "licence", "dice")
    assert [(i, n) for i, n, _ in got] == [(k, n) for k, (_, n) in enumerate(FOUND)]
    assert got == [(i, n, pytest.approx(d)) for i, t in docs for n, d in sorted(brute(t).items())]


def test_each_notice_inside_a_paragraph(table):
    docs = [(k, f"some words before {t} and some after".replace(" ", "\n" if k % 2 else " ")) for k, (_, t, _, _) in enumerate(NOTICES)]
    got = {(i, n): d for i, n, d in rows(scan_notices(table(docs)), "doc_id", "licence", "dice")}
    assert all(got.get((k, name)) == 1.0 for k, (name, *_) in enumerate(NOTICES))


def test_edges(table):
    line = "Released under the MIT License."
    docs = table([(None, line), (4, line), (4, line), (5, "word " * 200_000 + line), (6, (line + " ") * 5000)])
    assert [(i, n) for i, n, _ in rows(scan_notices(docs), "doc_id", "licence", "dice")] == [(4, "MIT"), (5, "MIT"), (6, "MIT"), (None, "MIT")]
    assert scan_notices(table([])).collect() == [] and scan_notices(docs, notices=(("x", "one", (), ()),)).collect() == []
