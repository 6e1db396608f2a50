import random

import numpy as np
import pytest

from gleaner.llm import components, jaccard


def shingles(text, q):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + q]) for i in range(max(1, len(words) - q + 1)))


def brute(pairs, q, percent):
    sets = [shingles(t, q) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(pairs))


def found(rows):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def corpus(seed, n, vocabulary=4000, length=(1, 90), edits=(0, 6)):
    """Families of texts that differ by a few words, some sharing long passages, of many sizes."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(30)]
    pairs = []
    while len(pairs) < n:
        base = [word() for _ in range(rng.randint(*length))]
        if rng.random() < 0.2:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(*edits)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randint(1, 5))]
            pairs.append((len(pairs) * 3 % 1009, " ".join(copy)))
    return pairs


ODD = [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one two"), (2004, "ONE  two"), (None, "one two"), (2005, "É É É"), (2006, "é é é"), (2003, "repeated id here " * 40)]


@pytest.mark.parametrize("q, percent", [(3, 90), (5, 80)])
def test_against_brute_force(docs, q, percent):
    pairs = corpus(1, 260) + ODD
    made = jaccard.jaccard_components(docs(pairs), q, percent)
    assert found(made.collect()) == brute(pairs, q, percent)


@pytest.mark.parametrize("cap", [None, -1])
def test_large_regions(docs, monkeypatch, cap):
    """One big family, joined by many tasks because the limits are tiny."""
    if cap is not None:
        monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", cap)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    pairs = corpus(3, 60) + ODD
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
        pairs.append((5000 + k, " ".join(copy)))
    made = jaccard.jaccard_components(docs(pairs), 3, 90, region_sets=16, region_shingles=3000)
    assert found(made.collect()) == brute(pairs, 3, 90)


@pytest.mark.parametrize("seed", range(30))
def test_region_inside_a_task(seed):
    rng = random.Random(seed)
    base = rng.sample(range(10**6), 60)
    sets = []
    for _ in range(rng.choice([5, 80, 200])):
        s = set(base if rng.random() < 0.7 else rng.sample(range(10**6), 60))
        for _ in range(rng.randint(0, 8)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(10**6))
        sets.append(s)
    region = jaccard.Region([np.array(sorted(s), np.uint64).tobytes() for s in sets], np.arange(len(sets)), 90, 100)
    region.solve(np.arange(len(sets)))
    pairs = [(i, " ".join(f"{x}" for x in sorted(s))) for i, s in enumerate(sets)]
    want = {i: int(c) for (i, _, c) in ((int(a), b, c) for a, b, c in brute(pairs, 1, 90))}
    for i in range(len(sets)):
        for j in range(i):
            assert (region.labels[i] == region.labels[j]) == (want[i] == want[j])


@pytest.mark.parametrize("num", [50, 80, 90])
def test_linked_sets_share_a_signature(num):
    rng = random.Random(num)
    for _ in range(1500):
        a = set(rng.sample(range(10**9), rng.randint(1, 60)))
        b = set(a)
        for _ in range(rng.randint(0, len(a) // 2)):
            if rng.random() < 0.5:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(10**9))
            if not b:
                break
        if b and a != b and 100 * len(a & b) >= num * len(a | b):
            x, y = (set(jaccard.signatures(np.array(sorted(s), np.uint64), num, 100).tolist()) for s in (a, b))
            assert x & y


def test_empty_table(docs):
    assert jaccard.jaccard_components(docs([(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_signature_whatever_is_common(num):
    """What counts as common only changes which parts are left out."""
    rng = random.Random(num)
    for _ in range(400):
        a = set(rng.sample(range(10**9), rng.randint(20, 300)))
        b = set(a)
        for _ in range(rng.randint(0, len(a) // 9)):
            b.discard(rng.choice(sorted(b)))
            b.add(rng.randrange(10**9))
        common = np.array(sorted(rng.sample(sorted(a | b), rng.randint(0, len(a)))), np.uint64)
        if a != b and 100 * len(a & b) >= num * len(a | b):
            x, y = (set(jaccard.signatures(np.array(sorted(s), np.uint64), num, 100, common).tolist()) for s in (a, b))
            assert x & y


def test_shared_passages_make_no_region(docs):
    """Texts that share passages, but a sixth of their words at most, stay in regions of their own."""
    rng = random.Random(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(5)]
    text = lambda: " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(120)), *rng.sample(passages, 2)])
    made = jaccard.coarse_regions(docs([(i, text()) for i in range(400)]), 5, 80, 100)
    assert made.groupBy("region").count().filter("count > 20").collect() == []


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1001 + i) for i in range(200)]
    edges = spark.createDataFrame([*path, *path[:5], *star, (2000, 2000), (2002, 2001)], "a bigint, b bigint").repartition(5)
    made = {r.node: r.root for r in components.components(edges).collect()}
    want = {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1201)}, 2000: 2000, 2001: 2001, 2002: 2001}
    assert made == want
    assert components.components(edges.limit(0)).collect() == []


def test_strangers_share_no_signature():
    """Parts that hold nothing tie nobody; what two sets share decides."""
    rng = np.random.default_rng(9)
    marks = [jaccard.signatures(np.sort(rng.integers(0, 2**63, n, np.uint64)), 80, 100) for n in rng.integers(1, 120, 6000)]
    assert len(np.unique(np.concatenate(marks))) == sum(len(np.unique(m)) for m in marks)


def test_linked_sets_share_a_signature_where_parts_are_empty():
    """Shingles that all fall into the parts in which two linked sets differ, so that they agree on empty parts only."""
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(26, 30)
        parts = next(d + 3 + int(0.3 * d) for low, d in reversed(jaccard.size_classes(99, 80, 100)) if low <= n)
        few = set(rng.sample(range(parts), 3))
        a: set = set()
        while len(a) < n:
            x = rng.randrange(10**15)
            if int(jaccard._mix(np.array([x], np.uint64))[0] >> np.uint64(20)) % parts in few:
                a.add(x)
        b = set(a)
        for x in rng.sample(sorted(a), 3):  # one in each of the parts where possible
            b.discard(x)
        x, y = (set(jaccard.signatures(np.array(sorted(s), np.uint64), 80, 100).tolist()) for s in (a, b))
        assert x & y


@pytest.mark.parametrize("cap", [None, -1])
def test_regions_of_strangers_are_parted(docs, monkeypatch, cap):
    """Texts that share lines with many others, and so hang together, are not compared pair by pair."""

    def no(*_):
        raise AssertionError("a region without links was joined by pivots")

    if cap is not None:
        monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", cap)
    monkeypatch.setattr(jaccard, "_large_regions", no)
    monkeypatch.setattr(jaccard, "SAMPLE_TEXTS", 1)
    rng = random.Random(6)
    lines = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(12)]
    pairs = [(k, " ".join(rng.sample(lines, 2) + [f"w{rng.randrange(10**6)}" for _ in range(12)])) for k in range(240)]
    pairs += [(1000 + k, t + " more") for k, t in pairs[:20]] + ODD
    made = jaccard.jaccard_components(docs(pairs), 5, 80, region_sets=40)
    assert found(made.collect()) == brute(pairs, 5, 80)


def test_one_of_each_where_texts_are_shuffled(docs, monkeypatch):
    """Only documents of groups are shuffled; which rows stay is the same."""
    pairs = [*corpus(12, 150), *ODD, (2001, "")]
    kept = lambda: sorted((str(r.doc_id), str(r.text)) for r in jaccard.one_of_each(docs(pairs)).collect())
    whole = kept()
    monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", 4000)
    assert kept() == whole
    frame = docs(pairs).withColumn("__key", jaccard.text_key("text"))
    few = jaccard.written(frame.filter("doc_id < 60").selectExpr("__key", "doc_id AS __root").distinct())
    made = jaccard._told(frame, few, 5000)
    assert sorted(map(str, made.collect())) == sorted(map(str, frame.join(few, "__key", "left").select(*made.columns).collect()))


@pytest.mark.parametrize("few", [0, 90])
def test_components_in_rounds_and_at_once(spark, monkeypatch, few):
    """All in rounds, and a few rounds before the driver joins the last edges."""
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(few)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    key = lambda x: f"{x:03}".encode()
    edges = spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary")
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    made = {bytes(r.node): bytes(r.root) for r in components.components(edges).collect()}
    assert made == {key(x): key(r) for x, r in root.items()}
