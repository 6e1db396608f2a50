import random
import re

import pytest

from gleaner.llm import licenses
from gleaner.llm.licenses import NOTICES, PHRASES, Template, report


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, templates=(*PHRASES, *NOTICES), shift=licenses.SHIFT, gram=licenses.GRAM):
    """(template, start, stop, share) by comparing every place of a text with every place of a template."""
    own, out = words(text), []
    for k, t in enumerate(templates):
        w = words(t.text)
        size = min(gram, len(w))
        hits = sorted(
            (i - p, p) for p in range(len(w) - size + 1) for i in range(len(own) - size + 1) if size and own[i : i + size] == w[p : p + size]
        )
        spans = []
        for d, p in hits:
            if not spans or d - spans[-1][-1][0] > (0 if t.exact else min(shift, len(w) - 1)):
                spans.append([])
            spans[-1].append((d, p))
        for s in spans:
            places = {p + j for _, p in s for j in range(size)}
            out.append((k, min(d + p for d, p in s), max(d + p for d, p in s) + size, round(len(places) / len(w), 6)))
    return sorted(out)


def expected(pairs):
    rows = []
    for i, t in pairs:
        found = brute(t)
        whole = [f for f in found if f[0] < len(PHRASES) and f[3] == 1]
        more = [f for f in found if f[0] >= len(PHRASES) and f[3] >= licenses.LEAST_SHARE]
        name = lambda fs: ",".join(sorted({[*PHRASES, *NOTICES][f[0]].label for f in fs}))
        starts = [f[1] for f in whole]
        score = max((f[3] for f in found), default=0.0)
        rows.append((i, len(words(t)), len(whole), min(starts, default=None), max(starts, default=None), name(whole), name(whole + more), score))
    return sorted(rows, key=str)


def rows(made):
    names = "doc_id n_words n_base first_word last_word base_labels labels score".split()
    return sorted((tuple(r[n] for n in names) for r in made.collect()), key=str)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(12)
    notice = lambda k: NOTICES[k].text
    made = [
        (1, "Released under the MIT License."),
        (2, "cc-by cc by, CC BY-NC 4.0 and nothing"),
        (3, "a b c. This work is licensed under the GNU General Public License, version 3. And GNU general PUBLIC license"),
        (4, notice(8)),
        (5, notice(9).replace("source and", "source code and all") + " x y " + notice(9)),
        (6, notice(10).replace("any purpose", "every single purpose").replace("hereby", "")),
        (7, "the mit licenses"),
        (8, "mit\nlicense mit license mit mit license"),
        (9, ""),
        (10, None),
        (None, "apache license"),
        (1, "Apache Licence"),
        (11, " ".join(rng.choice(["cc", "by", "mit", "license", "gnu", "general", "public", "été"]) for _ in range(4000))),
        (12, "x " * 30000 + "this is free and unencumbered software released into the public domain"),
        (3, "free software foundation " * 50),
    ]
    return made + [(100 + k, made[0][1]) for k in range(40)]


def test_against_brute_force(docs, pairs):
    assert rows(report(docs(pairs))) == expected(pairs)


def test_shuffled_joins_give_the_same(docs, pairs, monkeypatch):
    monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", -1)
    assert rows(report(docs(pairs))) == expected(pairs)


def test_edited_notices_keep_their_label(docs):
    text = NOTICES[3].text.split()
    edited = " ".join(text[:6] + ["really"] + text[6:12] + text[13:])
    far = " ".join(w + " filler" for w in text)
    made = {r.doc_id: r.labels for r in report(docs([(1, edited), (2, far)])).collect()}
    assert "apache-2.0" in made[1] and "apache-2.0" not in made[2]


def test_spans_of_own_templates(docs):
    made = licenses.found_licenses(docs([(1, "one two three four two three")]), [Template("x", "two three"), Template("none", "...")])
    assert [tuple(s) for s in made.first().found] == [(0, 1, 3, 1.0), (0, 4, 6, 1.0)]


def test_empty_table_and_no_templates(docs):
    assert report(docs([(1, "mit license")]).limit(0)).collect() == []
    assert licenses.found_licenses(docs([(1, "mit license")]), []).first().found == []


def test_no_python_in_the_plan(docs):
    plan = report(docs([(1, "mit license")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
