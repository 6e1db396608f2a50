import hashlib
import random
import zlib

import pytest

from gleaner.llm.contraction import subtree_totals
from gleaner.llm.prefix_trie import shared_beginnings


def brute(rows):
    """The trie of the rebuilt conversations, node by node."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = (turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest())
            convs.setdefault(c, []).append((key, (role or "", text or "")))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    made = []
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
        ends = sorted(c for c in members[p] if len(whole[c]) == len(p))
        made.append(
            (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(made, key=str)


NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def result(made):
    return sorted((tuple(r[n] for n in NAMES) for r in made.collect()), key=str)


@pytest.fixture(scope="module")
def turns(frame):
    return lambda rows: frame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, node string, depth int")


def some_conversations():
    rng = random.Random(13)
    rows = []
    for c in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((c * 2 + c % 3, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long text"])))
    rows += [(500, t, "user", f"turn {t}") for t in range(40)] + [(501, t, "user", f"turn {t}") for t in range(40)]
    rows += [(7, None, "user", "first of all"), (7, 0, None, None), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "nobody")]
    rows += [(900 + k, 0, "system", "same") for k in range(300)] + [(1333, 0, "user", "z" * 100_000)]
    return rows


def test_against_brute_force(turns):
    rows = some_conversations()
    assert result(shared_beginnings(turns(rows))) == brute(rows)


def test_hot_conversations_in_slices_and_shuffled_joins(turns, monkeypatch):
    monkeypatch.setattr("gleaner.plans.lookup.BROADCAST_CELLS", 0)
    monkeypatch.setattr("gleaner.llm.prefix_trie.running_totals", _sliced)
    rows = some_conversations()
    assert result(shared_beginnings(turns(rows))) == brute(rows)


def _sliced(df, keys, order, totals):
    from gleaner.plans.ordered import running_totals

    return running_totals(df, keys, order, totals, limit=10)


def test_empty_table(turns):
    assert shared_beginnings(turns([(1, 0, "user", "a")]).limit(0)).collect() == []


def test_totals_of_deep_and_wide_trees(frame):
    rng = random.Random(1)
    parents = {0: None, 1000: None}
    for n in range(1, 120):  # a chain, a star at its end, and random nodes
        parents[n] = n - 1
    for n in range(200, 260):
        parents[n] = 119
    for n in range(300, 380):
        parents[n] = rng.choice([p for p in parents if p < n and p != 1000])
    own = {n: rng.randint(-5, 9) for n in parents}
    totals = dict.fromkeys(parents, 0)
    ones = dict.fromkeys(parents, 0)
    for n in parents:
        at = n
        while at is not None:
            totals[at] += own[n]
            ones[at] += 1
            at = parents[at]
    tree = frame([(n, p, own[n], 1 if n % 2 else None, "x") for n, p in parents.items()], "node int, parent int, a int, b int, kids string")
    made = {r.node: r.a for r in subtree_totals(tree, ["a", "b"]).select("node", "a").collect()}
    assert made == totals
    assert subtree_totals(tree.limit(0), ["a"]).collect() == []
