import random
import textwrap

import numpy as np

from tests.llm.data import ODD, SF, clashing, docs, text
from tidemark.llm import licenses

KNOWN = licenses.templates()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_every_template_has_a_cue_and_finds_itself():
    for t in KNOWN:
        own = b" ".join(t.words)
        assert licenses.CUES.search(own)
        noted = b"words before it\nand more " + own + b" and after\nthe end"
        (found,) = licenses.scan(noted, KNOWN)[1]
        assert found[3] == 0 and noted[found[1] : found[2]] == own and own in {b" ".join(x.words) for x in KNOWN if x.name == found[0]}


def test_differences_match_a_plain_edit_distance():
    r = np.random.default_rng(1)
    for _ in range(60):
        template = tuple(bytes([c]) for c in r.choice(list(b"abc"), r.integers(1, 7)))
        words = [bytes([c]) for c in r.choice(list(b"abcd"), r.integers(0, 12))]
        n, start, end = licenses.differences(template, words)
        best = min(edits(template, words[s:e]) for s in range(len(words) + 1) for e in range(s, len(words) + 1))
        assert n == best == edits(template, words[start:end])


def test_changed_wordings():
    long = next(t for t in KNOWN if t.name == "MIT" and len(t.words) > 50)
    words = list(long.words)
    words[10] = b"zebra"
    (found,) = licenses.scan(b"x " + b" ".join(words), KNOWN)[1]
    assert found[0] == "MIT" and found[3] == 1
    assert licenses.scan(b"Released under the XYZ License.", KNOWN) == (1, [])
    assert licenses.scan(b"no notice here", KNOWN) == (0, [])
    assert [f[0] for f in licenses.scan(b"Released under the MIT License.\nLicensed under CC BY 4.0.", KNOWN)[1]] == ["MIT", "CC-BY-4.0"]


def test_notice_in_a_very_long_line():
    noted = " ".join([text(1, 5000), "Licensed under the Apache License, Version 2.0.", text(2, 5000)])
    (found,) = licenses.scan(noted.encode(), KNOWN)[1]
    assert found[0] == "Apache-2.0" and noted[found[1] : found[2]].startswith("Licensed under the Apache")


def test_odd_documents(spark):
    rows = [*ODD, (20, "x\nReleased under the MIT License.\ny")]
    got = licenses.scanned(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows) and {r.doc_id: r.licenses for r in got if r.licenses} == {20: ["MIT"]}
    assert licenses.scanned(docs(spark, [])).count() == 0


def test_query_finds_the_lines(spark):
    got = {r.doc_id: r.licenses for r in licenses.op6_license_scan(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    plain = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    plain["This work is licensed under the GNU General Public License, version 3."] = "GPL-3.0"
    assert got == {r.doc_id: sorted({v for k, v in plain.items() if k in r.text}) for r in table}


def test_wrapped_and_commented_wordings_are_found_whole():
    """Every wording at several widths and behind the usual marks of comments."""
    for name, wordings in licenses.TEMPLATES.items():
        for k, wording in enumerate(wordings):
            for width in (40, 60, 72, 79, 100):
                mark = (" * ", "# ", "// ", "")[(k + width) % 4]
                lines = "\n".join(f"{mark}{line}" for line in textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=False))
                noted = f"{text(1, 40)}\n\n{lines}\n\n{text(2, 40)}".encode()
                found = licenses.scan(noted, KNOWN)[1]
                assert [(f[0], f[3]) for f in found] == [(name, 0)], (wording, width)
                assert licenses._normal(noted[found[0][1] : found[0][2]]) == licenses._normal(wording.encode())


def test_ranking_keeps_wordings_at_the_allowed_edits():
    """By brute force over all templates: of those edited in a tenth of their words, the ranking drops at most a tenth."""
    r = random.Random(2)
    for t in KNOWN:
        size, found = len(t.words), 0
        for trial in range(10):
            own = list(t.words)
            cues = [i for i, w in enumerate(own) if licenses.CUES.search(w)]
            for i in r.sample([j for j in range(size) if j != cues[0]], int(licenses.DIFFERENT * size)):
                own[i] = r.choice([b"", b"other", own[i] + b" more"])
            edited = [w for w in b" ".join(own).split()]
            near = [w.encode() for w in text(10 * trial, 30).split()]
            got = licenses._notices([*near, *edited, *near], KNOWN)
            assert len(edited) - size <= int(licenses.DIFFERENT * size)
            found += any(s <= 30 + size // 2 < e for s, e, _, _ in got)
        assert found >= 9, t.name


def test_short_statements_of_every_licence():
    for name, said in (("MIT", "Licensed under the MIT License"), ("Apache-2.0", "released under the Apache License, Version 2.0"), ("LGPL-2.1", "distributed under the terms of the GNU Lesser General Public License, version 2.1"), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), ("MIT-0", "SPDX-License-Identifier: MIT-0")):
        assert [f[0] for f in licenses.scan(f"{text(3, 20)}\n{said}\n{text(4, 20)}".encode(), KNOWN)[1]] == [name]
