import random

import pytest

from gleaner.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, rule string"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "bad.org/"), ("block", "om/x"), ("allow", "am/x")]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = lambda s, stops: min([s.find(c) for c in stops if c in s], default=len(s))
    k = ends(rest, "/?#")
    return lower(rest[:k]), rest[k:][: ends(rest[k:], "?#")]


def decide(host, path):
    fit = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit)[3:] if fit else (None, None)


def brute(rows, rounds=12, d=0.85):
    links = {}
    for _, url, page in rows:
        h = split(url)[0]
        for part in (page or "").split('href="')[1:]:
            target = part.split('"')[0]
            if "//" in target and h:
                t = lower(target.split("//", 1)[1].split("/")[0])
                if t and t != h:
                    links[h, t] = links.get((h, t), 0) + 1
    hosts = {split(u)[0] for _, u, _ in rows} | {t for _, t in links}
    score = {}
    for kind, want in ((0, "allow"), (1, "block")):
        seed = {h: (1 - d) * (decide(h, "/")[1] == want) for h in hosts}
        ways = {(a, b) if kind == 0 else (b, a): n for (a, b), n in links.items()}
        total = {}
        for (a, _), n in ways.items():
            total[a] = total.get(a, 0) + n
        s, got = dict(seed), {}
        for _ in range(rounds):
            got = {h: 0.0 for h in hosts}
            for (a, b), n in ways.items():
                got[b] += d * s[a] * n / total[a]
            s = {h: seed[h] + got[h] for h in hosts}
        score[kind] = got
    out = []
    for i, url, _ in rows:
        host, path = split(url)
        rule, verdict = decide(host, path)
        bad = round(score[1][host], 9) >= 0.05 and round(score[1][host], 9) > round(score[0][host], 9)
        out.append((str(i), host, path, str(rule), verdict or ("block" if bad else "allow")))
    return sorted(out)


def found(frame, rows):
    made = url_filter.judge(frame([(*r, "x", "y") for r in rows], SCHEMA), RULES)
    return sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in made.collect())


URLS = [None, "", "no scheme", "http://", "http://a.com", "HTTP://A.Com/x?y#z", "http://www.example.com/en/1", "http://x.example.com/en/", "https://example.com/en", "http://a.net/es/q", "http://net/es/", "x://y://z/p", "http://com/", "http://com?x/", "http://É.COM/É", "http://a.b.om/x", "http://q.am/x1", "http://user@h.io:80/p#f"]


def test_rules_and_links(frame):
    rng = random.Random(6)
    names = [f"h{i}.io" for i in range(12)] + ["bad.org", "worse.bad.org", "good.com", "also.good.com"]
    rows = [(i, u, '<a href="http://bad.org/x">' if i == 13 else None) for i, u in enumerate(URLS)]
    for i in range(120):
        host = rng.choice(names)
        to = rng.choice(["bad.org", "worse.bad.org"]) if host in ("h1.io", "h2.io") else rng.choice(names[3:12] + names[14:])
        rows.append((1000 + i, f"http://{host}/p/{i}", f'<a href="//{to.upper()}/a">x</a> <a class=c href="/local">y</a>'))
    rows += [(1000, None, "<p>"), (None, "http://h1.io/", ""), rows[-1]]
    want = brute(rows)
    assert {w[4] for w in want if w[1] == "h1.io"} == {"block"} and {w[4] for w in want if w[1] == "h5.io"} == {"allow"}
    assert found(frame, rows) == want


def test_shuffled_join_gives_the_same(frame, monkeypatch):
    monkeypatch.setattr("gleaner.llm.common.BROADCAST_BYTES", -1)
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(99, "http://a.com/" + "x" * 100000, "w " * 100000)]
    assert found(frame, rows) == brute(rows)


def test_empty_table(frame):
    assert url_filter.judge(frame([(1, "u", "h", "x", "y")], SCHEMA).limit(0)).collect() == []


def test_registered_rules_block_by_links(frame):
    """A host that links to pages under blocked paths is blocked; one that links beside them is not."""
    pages = [(1, "http://q.net/es/1", ""), (2, "http://q.net/es/2", ""), (3, "http://q.net/en/", "")]
    pages += [(10, "http://feeds.io/a", '<a href="http://q.net/es/1">'), (11, "http://only.io/", "<a href='//seen.net/fr/x?y'>")]
    pages += [(12, "http://fine.io/", '<a href="http://r.net/de/1">'), (13, "http://both.io/", '<a href="//Seen.net/fr/z">')]
    pages += [(20 + i, f"http://t{i}.com/", '<a href="http://both.io/">') for i in range(3)]
    made = url_filter.judge(frame([(*r, "x", "y") for r in pages], SCHEMA))
    got = {r.page_id: (r.rule, r.verdict) for r in made.collect()}
    assert got[1] == got[2] == ("net/es/", "block") and got[3] == (None, "allow")
    assert got[10] == got[11] == (None, "block") and got[12] == got[13] == (None, "allow")


def test_registered_sql_says_the_same_where_links_decide(spark, tmp_path):
    import sys

    sys.path.insert(0, "tests")
    from compare import compare

    import duckdb

    from gleaner.llm import queries

    to = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    rows = [
        (1, "http://farm1.org/a", to("http://bad.net/es/x", "//Bad.net/es/y?q#z", "HTTPS://other.net/fr/1")),
        (2, "http://farm2.org/a", to("http://bad.net/es/x", "http://good.com/")),
        (3, "http://farm2.org/b", to("http://bad.net/es/x")),
        (4, "http://bad.net/es/x", to("http://good.com/a", "/relative")),
        (5, "http://bad.net/other", None),
        (6, "http://good.com/a", to("http://friend.org/", "http://friend.org/b", "http://bad.net/es/x")),
        (7, "http://friend.org/", to("http://farm3.org/")),
        (8, "http://farm3.org/", to("http://bad.net/es/x", "http://bad.net/fr/x")),
        (9, "http://example.com/en/1", to("http://www.example.com/en/2")),
        (10, "http://mixed.org/x", to("http://bad.net/", "http://bad.net/es/1", "http://www.example.com/en/5")),
        (11, None, to("http://bad.net/es/x")),
        (12, "no scheme", None),
        (13, "http://quiet.org/?a", "<p>no links</p>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    status, details, _ = compare(spark, con, str(tmp_path), "op6", queries.QUERIES["op6_url_filter"], queries.ORACLES["op6_url_filter"])
    assert status == "ok", details
    verdicts = {r.page_id: (r.rule, r.verdict) for r in queries.op6(spark, str(tmp_path)).collect()}
    assert verdicts[1] == (None, "block") and verdicts[7] == (None, "allow") and verdicts[13] == (None, "allow")
