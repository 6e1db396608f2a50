import hashlib
import math
import random
import re

import pytest

from gleaner.llm import pii

KINDS = ("email", "ip", "card", "phone", "hint", "term")


def base(text):
    out = [(m.start(), 0, m.end(), m.group().lower()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), ".".join(str(int(p)) for p in m.group().split("."))))
    for k, p, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(p, text):
            d = [int(c) for c in m.group() if c.isdigit()]
            double = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])]
            if low <= len(d) <= high and (k == 3 or sum(double) % 10 == 0):
                out.append((m.start(), k, m.end(), "".join(map(str, d))))
    return sorted(out)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [(m.start(), m.end(), m.group()) for m in re.finditer(r"(?:[a-z]|[^\x00-\x7F]){3,}", low)]


def brute(pairs):
    texts = {t for _, t in pairs if t is not None}
    contexts = {}
    for t in texts:
        found = base(t)
        free = [w for w in words(t) if not any(s < w[1] and w[0] < e for s, _, e, _ in found)]
        for s, k, e, v in found:
            near = [w for a, b, w in free if b <= s][-8:] + [w for a, b, w in free if a >= e][:8]
            contexts.setdefault((k, v), set()).add(frozenset(near))
    share = {}
    for entity, cs in contexts.items():
        for w in set().union(*cs):
            n_te, n_t = sum(w in c for c in cs), sum(any(w == x for _, _, x in words(t)) for t in texts)
            if n_te >= 3 and len(texts) > len(cs):
                share[entity, w] = math.log(n_te * len(texts) / (n_t * len(cs))) / math.log(len(texts) / len(cs))
    out = []
    for i, t in pairs:
        found = base(t or "")
        spans = [f[:3] for f in found]
        for a, b, w in words(t or ""):
            best = max((share.get(((k, v), w), -9) for _, k, _, v in found), default=-9)
            if best >= 0.6 - 1e-9 and not any(s < b and a < e for s, _, e, _ in found):
                spans.append((a, 5 if best >= 0.85 - 1e-9 else 4, b))
        spans.sort()
        label = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
        own = [x for x in spans if x[1] < 4]
        counts = [sum(k == j for _, k, _ in spans) for j in range(4)]
        out.append((str(i), *counts, hashlib.sha256(label(own).encode()).hexdigest(), label(spans)))
    return sorted(out)


def found(rows):
    return sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in rows)


def corpus():
    rng = random.Random(4)
    filler = [f"{a}{b}{c}" for a in "bdfg" for b in ("al", "em", "or") for c in ("ne", "ka", "té")]
    text = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    pairs = [(i, text(rng.randint(0, 40))) for i in range(80)]
    for i in range(8):  # a nickname that only stands beside one address
        pairs.append((100 + i, f"{text(5)} Zorro {text(2)} jane.doe@Mail.example.com {text(6)}"))
    pairs += [(120, f"Zorro {text(9)}"), (121, "again zorro, mail JANE.DOE@mail.example.com")]
    pairs += [(130, None), (131, ""), (None, "call +1 (417) 555-1301 now"), (130, "ip 10.0.0.1 and 10.0.0.256, 1.2.3.4.5")]
    pairs += [(132, "4539 1488 0343 6467 x 4539 1488 0343 6468 " + "long " * 30000 + "é a@b.co")]
    pairs += [(133, "card+phone +4539148803436467 0")] + [(140 + i, "copy zorro jane.doe@mail.example.com") for i in range(20)]
    return pairs


def test_report(docs):
    pairs = corpus()
    want = brute(pairs)
    assert any("term:" in w[-1] or "hint:" in w[-1] for w in want)
    assert found(pii.report(docs(pairs)).collect()) == want


def test_shuffled_joins_give_the_same(docs, monkeypatch):
    monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", -1)
    pairs = corpus()
    assert found(pii.report(docs(pairs)).collect()) == brute(pairs)


def test_sanitise_masks_and_keeps_other_columns(docs):
    made = pii.sanitise(docs(corpus()))
    assert made.columns[:3] == ["doc_id", "text", "lang"] and made.columns[-1] == "words"
    rows = {r.doc_id: r for r in made.collect()}
    assert "jane" not in rows[121].text.lower() and "zorro" not in rows[121].text.lower() and "[EMAIL]" in rows[121].text
    assert "Zorro" in rows[120].text  # mentions nobody
    assert rows[131].text == "" and rows[121].lang == "en" and rows[121].words == "w"
    assert rows[None].text == "call [PHONE] now"


@pytest.mark.parametrize("seed", range(5))
def test_forms(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice("ab@.-+ ()0123456789%É") for _ in range(rng.randint(0, 50)))
        assert pii.find(text) == base(text)


def test_empty_table(docs):
    assert pii.report(docs([(1, "a")]).limit(0)).collect() == []


def brute_whole(pairs):
    """(id, start, kind) of the words that disclose, counted in distinct whole texts."""
    texts = {t for _, t in pairs if t}
    held = {t: {w for *_, w in every(t)} for t in texts}
    entities = {}
    for t in texts:
        for _, k, _, v in base(t):
            wide = (v.split("@")[-1], v.rsplit(".", 1)[0], v[:6], v[:-4])[k]
            for e in ((k, v), (k, "wide", wide)):
                entities.setdefault(e, set()).add(t)
    n, out = len(texts | {t for _, t in pairs if t is not None}), set()
    for i, t in pairs:
        found = base(t or "")
        for a, b, w in every(t or ""):
            shares = []
            for having in entities.values():
                if t in having and len(having) < n:
                    k = sum(w in held[x] for x in having)
                    low = (k + 0.5 - math.sqrt(k * (1 - k / n) + 0.25)) / (1 + 1 / n)
                    shares.append(math.log(low * n / (sum(w in ws for ws in held.values()) * len(having))) / math.log(n / len(having)))
            if shares and max(shares) >= 0.6 - 1e-9 and not any(s < b and a < e for s, _, e, _ in found):
                out.add((str(i), a, "term" if max(shares) >= 0.85 - 1e-9 else "hint"))
    return out


def every(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [(m.start(), m.end(), m.group()) for m in re.finditer(r"(?:[a-z]|[^\x00-\x7F])+", low)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_whole_texts(docs, monkeypatch, shuffled):
    """A nickname 30 words from an address met once, a name of two letters, and a town that goes with a mail domain."""
    if shuffled:
        monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", -1)
    rng = random.Random(9)
    filler = [f"{a}{b}{c}" for a in "bdfg" for b in ("al", "em", "or") for c in ("ne", "ka", "té")]
    text = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    pairs = corpus() + [(1000 + i, text(30)) for i in range(700)]
    pairs += [(2000, f"Quibble {text(30)} only.once@mail.test {text(30)} Xu {'y' * 60}")]
    pairs += [(2010 + i, f"p{'abcdef'[i]}@wide.test {text(20)} Bigtown") for i in range(6)] + [(2020, f"Bigtown {text(5)}")]
    made = {(str(r.doc_id), int(s.split(":")[1]), s.split(":")[0]) for r in pii.report(docs(pairs), whole=True).collect() for s in r.spans.split(",") if s}
    assert {m for m in made if m[2] in KINDS[4:]} == brute_whole(pairs)
    assert {k for i, a, k in made if i == "2000"} >= {"term", "email"} and ("2000", 0, "term") in made
    assert [i for i, a, k in made if i == "2010" and a > 30 and k in KINDS[4:]]


def test_the_query_counts_whole_texts(spark):
    from gleaner.llm import queries

    rows = queries.QUERIES["op5_personal_data"](spark, "/root/testdata/sf0.001").collect()
    assert any("hint:" in r.spans or "term:" in r.spans for r in rows)


def test_empty_table_of_whole_texts(docs):
    assert pii.report(docs([(1, "a")]).limit(0), whole=True).collect() == []
