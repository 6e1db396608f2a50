import random
import zlib

import pytest

from gleaner.llm import toxicity
from gleaner.llm.common import table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


LEXICON = {"idiot": (3.0, 1), "worthless": (2.0, 2), "scum": (5.0, 0), "id*": (1.0, 0), "stupid": (4.0, 1)}


def brute(word):
    ends = [(w, distance(t, word), t) for t, (w, k) in LEXICON.items() if not t.endswith("*") and distance(t, word) <= k]
    best = min(ends, key=lambda x: (x[1], -x[0], x[2]), default=None)
    stem = max([w for t, (w, _) in LEXICON.items() if t.endswith("*") and word.startswith(t[:-1])], default=0)
    return best if best and (best[1] == 0 or not stem) else (stem, -1, "*") if stem else None


def test_automaton_equals_edit_distance(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 300)  # also when states are forgotten
    matcher, rng = toxicity.Matcher(LEXICON), random.Random(1)
    for _ in range(4000):
        word = list(rng.choice([t.rstrip("*") for t in LEXICON]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "i", "t", "s"])
        word = "".join(word) or "x"
        assert matcher.find(word) == brute(word), word


def test_empty_lexicon():
    assert toxicity.Matcher({}).find("word") is None


def test_quotation_is_told_from_abuse():
    matcher = toxicity.Matcher(LEXICON)
    own = lambda t: [m[2] for m in toxicity.meetings(t, matcher, {})]
    assert own("you idiot there") == [0]
    assert own('he wrote "idiot" there') == [1]
    assert own("nothing here") == []


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.01"
    return toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))


def test_held_out_accuracy(spark, model):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    rows = [r for r in toxicity.score(table(spark, folder, "documents"), model).collect() if r.doc_id in labels]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in test) >= 0.9 * len(test)
    assert sum(r.predicted and not labels[r.doc_id] for r in test) <= 0.03 * len(test)


def test_misspelled_terms_count(spark, model, docs):
    rows = {r.doc_id: r.score for r in toxicity.score(docs([(1, "you are so stupdi and worthles"), (2, "a day in the sun"), (3, None), (4, "")]), model).collect()}
    assert rows[1] >= 0.5 > rows[2] == rows[3] == rows[4]


def test_held_out_labels_change_nothing(spark, docs):
    pairs = [(i, f"badword here {i}" if i % 4 == 0 else f"fine text {i}") for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    schema = "doc_id long, toxic int"
    made = [toxicity.train(docs(pairs), spark.createDataFrame(x, schema)) for x in (labels, turned)]
    assert made[0] == made[1] and made[0].lexicon


@pytest.mark.parametrize("kinds", [[], [0], [1]])
def test_labels_of_one_kind_or_none(spark, docs, kinds):
    pairs = [(i, f"text {i}") for i in range(20)] + [(None, "no id"), (3, "repeated id")]
    labels = spark.createDataFrame([(i, k) for i in range(10) for k in kinds] + [(50, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs(pairs), labels)
    rows = toxicity.score(docs(pairs), model).collect()
    assert len(rows) == 22 and {r.predicted for r in rows} == {int(kinds == [1])}


def test_empty_table(docs, model):
    assert toxicity.score(docs([(1, "a")]).limit(0), model).collect() == []
