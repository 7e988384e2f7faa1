from matchloom.llm.licenses import TEMPLATES, bigrams, scan_licenses

from .conftest import rows


def brute(docs, at_least=0.8):
    out = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            for name, t in TEMPLATES:
                a, b = set(bigrams(line)), set(bigrams(t))
                if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= at_least:
                    out[i, name] = max(out.get((i, name), 0), d)
    return sorted((i, n, d) for (i, n), d in out.items())


def test_against_every_line_and_template(table):
    lines = [t for _, t in TEMPLATES]
    docs = [(k, "\n".join(["some prose here"] * (k % 3) + [t.upper() if k % 2 else t] + ["x " * 50])) for k, t in enumerate(lines)]
    docs += [(100 + k, t.rsplit(" ", 1)[0]) for k, t in enumerate(lines)] + [(200 + k, t + " See the file for more words") for k, t in enumerate(lines)]
    docs += [(300, "Licensed under the Apache License, Version 3.1"), (301, "word " * 200_000 + "\n" + lines[0])]
    got = rows(scan_licenses(table(docs, clash=True)), "doc_id", "licence", "dice")
    assert got == brute(docs) and len(got) > 12


def test_edges(table):
    line = TEMPLATES[0][1]
    docs = table([(1, None), (2, ""), (3, "one"), (None, line), (4, line), (4, line), (5, "\n\n")])
    assert rows(scan_licenses(docs), "doc_id", "licence", "dice") == [(4, "Apache-2.0", 1.0), (None, "Apache-2.0", 1.0)]
    assert scan_licenses(table([])).collect() == [] and scan_licenses(docs, templates=(("x", "one"),)).collect() == []
