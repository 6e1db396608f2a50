import hashlib
import random
import re

from gleaner.llm import decontaminate


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(pairs, items, window=10):
    out = []
    for i, t in pairs:
        own, hit, ids = words(t), set(), set()
        for item_id, text in items:
            w = words(text)
            n = min(window, len(w))
            for at in range(len(w) - n + 1) if n else ():
                for s in range(len(own) - n + 1):
                    if own[s : s + n] == w[at : at + n]:
                        hit |= set(range(s, s + n))
                        ids.add(item_id)
        names = sorted(str(x) for x in ids if x is not None)
        out.append((str(i), len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def found(rows):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)


def test_against_brute_force(docs, frame):
    rng = random.Random(2)
    vocabulary = ["the", "of", "A", "Été", "zwei", "x1", "rare", "odd", "b"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(11, 16))) for i in range(5)]
    items += [(5, "only three words"), (6, ""), (7, None), (None, "no id at all"), (3, items[3][1]), (8, "the"), (9, "not in the corpus zzz")]
    pairs = [(k, text(rng.randint(0, 60))) for k in range(40)]
    pairs += [(40 + k, f"{text(7)}. {items[k][1].upper()}! {text(5)} {items[k][1]}") for k in range(5)]
    pairs += [(60, None), (61, ""), (None, "has ONLY, three words? no id"), (40, "repeated id"), (44, pairs[44][1]), (62, "the " * 3000)]
    made = decontaminate.contamination(docs(pairs), frame([(*x, "c") for x in items], "item_id long, text string, term string"))
    assert found(made.collect()) == brute(pairs, items)


def test_shuffled_joins_give_the_same(docs, frame, monkeypatch):
    monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", -1)
    items = [(1, "a b c d e f g h i j k l"), (2, "q r")]
    pairs = [(1, "x a b c d e f g h i j k l y q"), (2, "q r s q r"), (3, "b a")]
    made = decontaminate.contamination(docs(pairs), frame(items, "item_id long, text string"))
    assert found(made.collect()) == brute(pairs, items)


def test_near_matches_allow_words_in_between(spark, docs, frame):
    items = frame([(1, "alpha beta gamma delta eps zeta eta theta iota kappa")], "item_id long, text string")
    corpus = docs(
        [(1, "alpha new beta gamma delta eps zeta eta theta iota kappa"), (2, "alpha " + "beta " * 9 + "kappa gamma delta eps zeta eta theta iota")]
    )
    windows = decontaminate.item_windows(items, 10)
    terms = windows.selectExpr("explode(words) AS term").distinct()
    anchors = decontaminate.anchors_of(windows, decontaminate.corpus_counts(corpus, terms, 1000))
    index = decontaminate.build_index(corpus, terms, 1000)
    assert decontaminate.near_matches(index, anchors, 0).count() == 0
    assert decontaminate.near_matches(index, anchors, 1).count() >= 1


def test_empty_tables(docs, frame):
    none = frame([(1, "a")], "item_id long, text string").limit(0)
    assert decontaminate.contamination(docs([(1, "a b")]), none).first().contaminated is False
    assert decontaminate.contamination(docs([(1, "a")]).limit(0), none).collect() == []
