import random
import zlib
from array import array

import pytest

from gleaner.llm import packing, tokens


def check_plan(histogram, capacity):
    used, sequences = dict.fromkeys(histogram, 0), 0
    for pattern, copies in packing.plan(histogram, capacity):
        assert copies > 0 and sum(n * t for n, t in pattern) <= capacity
        sequences += copies
        for n, t in pattern:
            used[n] += t * copies
    assert used == histogram
    return sequences


@pytest.mark.parametrize("seed", range(40))
def test_plan_uses_every_piece_once_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    made = check_plan(histogram, capacity)
    bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
    assert made >= bound
    assert made <= 2 * bound  # no two sequences of a best-fit packing are both at most half full


def best(pieces, capacity):
    """Fewest sequences, by trying all ways."""
    pieces, low = sorted(pieces, reverse=True), [len(pieces)]

    def go(k, rooms):
        if len(rooms) >= low[0]:
            return
        if k == len(pieces):
            low[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= pieces[k] and rooms[i] not in rooms[:i]:
                go(k + 1, rooms[:i] + [rooms[i] - pieces[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [capacity - pieces[k]])

    go(0, [])
    return low[0]


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_the_best_number(seed):
    rng = random.Random(seed)
    capacity = 12
    pieces = [rng.randint(1, capacity) for _ in range(9)]
    left = [0] * (capacity + 1)
    for p in pieces:
        left[p] += 1
    fixed = packing.reduce_by_dominance(left, capacity)
    rest = [n for n, c in enumerate(left) for _ in range(c)]
    assert sum(c for _, c in fixed) + best(rest, capacity) == best(pieces, capacity)


def test_pieces_and_places(docs):
    encode = tokens.library("byte_bpe_50k.json")
    pairs = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "dog"), (4, "word and more " * 2500), (5, "漢字 <|endoftext|> x")]
    pairs += [(100 + i, "same length here") for i in range(50)]
    rows = packing.pack(docs(pairs), capacity=64).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in whole.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for i, t in pairs:
        ids = array("I", [*encode.encode(t or "", add_special_tokens=False).ids, 0])
        first = len(ids) % 64 or 64
        starts = [0, *range(first, len(ids), 64)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_empty_table(docs):
    assert packing.pack(docs([(1, "a")]).limit(0)).collect() == []
