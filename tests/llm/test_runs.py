import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gleaner.llm import queries, runs


def brute(w):
    """All runs of a list of words, period by period."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for b, length, q in found for i in range(b + q, b + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    made = []
    for k in range(150):
        n, letters = rng.choice([0, 1, 5, 12, 40, 90]), rng.choice(["a", "ab", "abc", "abcdefgh"])
        w = [rng.choice(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 7)
            w = [x if i < a else w[min(a + (i - a) % p, n - 1)] for i, x in enumerate(w)]
        made.append((k, rng.choice([" ", "\n", " \t\x0b", "  "]).join(w)))
    made += [(200, None), (201, ""), (202, "  \n "), (None, "x " * 9), (5, "again again"), (203, "été été " * 8)]
    made += [(204, "a b c d " * 20_000 + "end"), (205, " ".join(f"w{i}" for i in range(30_000)))]
    return made


def test_against_brute_force(docs, pairs):
    made = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs(pairs[:-2])).collect())
    wanted = []
    for i, t in pairs[:-2]:
        w = words(t)
        wanted.append((str(i), len(w), brute(w), collapsed(w, brute(w))))
    assert made == sorted(wanted)


def test_very_long_texts(docs, pairs):
    made = {r.doc_id: r for r in runs.find_runs(docs(pairs[-2:])).collect()}
    assert [tuple(x) for x in made[204].runs] == [(0, 80_000, 4)] and made[204].collapsed == "a b c d end"
    assert made[205].runs == [] and made[205].n_words == 30_000


def test_slices_do_not_change_results(pairs, monkeypatch):
    import pyarrow as pa

    texts = pa.array([t or "" for _, t in pairs[:100]])
    whole = runs._of_batch(texts)
    monkeypatch.setattr(runs, "BATCH_WORDS", 10)
    parts = [runs._of_batch(texts.slice(a, b - a)) for a, b in runs._slices(texts)]
    assert len(parts) > 5 and ([x for p in parts for x in p[0]], [x for p in parts for x in p[1]]) == whole


def test_suffix_array_and_lcp():
    rng = random.Random(3)
    for _ in range(30):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 60))] + [0])
        order, place, lcp = runs.suffix_array(s)
        plain = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert order.tolist() == plain and all(place[i] == k for k, i in enumerate(plain))
        for k in range(1, len(s)):
            a, b, n = plain[k - 1], plain[k], 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert lcp[k] == n


def test_query_makes_documents_periodic(docs, spark, tmp_path, pairs):
    pairs = [(i, t) for i, t in pairs[:-2] if i is not None]
    docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    made = {(r.doc_id, r.runs_sha256, r.collapsed_sha256, r.n_runs, r.exponent_milli) for r in queries.op11(spark, str(tmp_path)).collect()}
    wanted = set()
    for i, t in pairs:
        w, h = words(t), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = brute(w)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        listed = "".join(f"{b},{length},{q}\n" for b, length, q in found)
        wanted.add((i, sha(listed), sha(collapsed(w, found)), len(found), max((1000 * x // q for _, x, q in found), default=None)))
    assert made == wanted


def test_empty_table(docs):
    assert runs.find_runs(docs([(1, "a")]).limit(0)).collect() == []
