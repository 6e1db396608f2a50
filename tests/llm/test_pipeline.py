"""Every stage of the pipeline against a brute-force version of it, on the same input."""

import pytest
import test_decontaminate
import test_jaccard
import test_pii

import corpus_pipeline
from gleaner.llm import toxicity
from gleaner.llm.common import table
from gleaner.plans.tables import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, FOLDER, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(steps) == 6


def test_toxicity(spark, steps):
    model = toxicity.train(steps[0], table(spark, FOLDER, "labels"))
    clean = {r.doc_id for r in toxicity.score(steps[0], model).collect() if not r.predicted}
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(clean) and clean


def brute_kept(rows):
    """Indices of the rows that stay: of each component the one of the smallest id, then of the first text."""
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    component = {int(i): c for i, _, c in test_jaccard.brute(numbered, 5, 80)}
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(component[i] if (t or "").split() else f"own {i}", []).append((d if d is not None else 2**63 - 1, i))
    return {min(g)[1] for g in groups.values()}


def test_near_copies(steps):
    rows = pairs(steps[1])
    assert sorted(pairs(steps[2])) == sorted(rows[i] for i in brute_kept(rows))
    assert steps[2].count() < len(rows)


def test_near_copies_of_odd_rows(docs):
    rows = test_jaccard.corpus(8, 150) + test_jaccard.ODD + [(7000, "one and the same text")] * 4 + [(None, "x y z"), (None, "x  y z")]
    made = corpus_pipeline.drop_near_copies(None, docs(rows), FOLDER)
    key = lambda r: (str(r[0]), " ".join((r[1] or "").lower().split()))
    assert sorted(map(key, pairs(made))) == sorted(key(rows[i]) for i in brute_kept(rows))


def test_contaminated(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    want = {i for i, *_, hit in test_decontaminate.brute(pairs(steps[2]), items) if not hit}
    assert sorted(str(i) for i, _ in pairs(steps[3])) == sorted(want) and len(want) < steps[2].count()


def test_personal_data(steps):
    rows, made = pairs(steps[3]), {r.doc_id: r for r in steps[4].collect()}
    spans = {i: s for i, *_, s in test_pii.brute(rows)}
    masks = dict(zip(test_pii.KINDS, ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", ""), strict=True))
    for i, text in rows:
        out, at = "", 0
        for kind, start, end in (x.split(":") for x in spans[str(i)].split(",") if x):
            if int(start) >= at:
                out += text[at : int(start)] + masks[kind]
            at = max(at, int(end))
        assert made[i].text == out + text[at:] and made[i].n_chars == len(made[i].text)
    assert any(spans.values())


def test_packing(steps):
    places = {}
    for r in steps[5].collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert sum(n for _, n in p) <= 2048 and [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]
    assert {r.doc_id for r in steps[5].collect()} == {i for i, _ in pairs(steps[4])}


def test_odd_rows_go_through_all_stages(spark, docs):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "word " * 30000), (3, "repeated id"), (4, "twice"), (4, "twice")]
    made = docs(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, made, FOLDER)
        assert k == 4 or out.columns == made.columns
        assert stage(spark, made.limit(0), FOLDER).collect() == []
        made = written(out)
    assert {r.doc_id for r in made.collect()} == {1, 2, 3, 4, None}


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns[0] == "doc_id"
