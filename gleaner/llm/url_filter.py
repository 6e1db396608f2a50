"""URL filters: rules on hosts and paths, and trust spread over the links between hosts.

A rule judges what it fits. For the rest, personalised PageRank spreads trust along links and distrust against them.
A host starts with as much trust, and as much distrust, as rules allow and block of what is known of it: its pages
and what other hosts link to on it. What reaches a host from others decides: one that links to blocked hosts, and that
trusted ones hardly link to, is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, attach, sized
from gleaner.plans.tables import written

# fixed values: the rules that were given, as (verdict, rule)
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
DAMPING = 0.85
ROUNDS = 12  # the rest of a restart that is not spread yet is 0.85 ** 12
LEAST_DISTRUST = 0.05  # received distrust below this blocks nobody; a seed host has 0.15
WRITE_EVERY = 4  # rounds between written tables
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+[^?#"'\s>]*)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between :// and the next / ? or #, A-Z lower-cased, and what follows up to ? or #; else empty."""
    cut = F.locate("://", url)
    rest = F.when(cut > 0, F.substr(url, cut + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rules_table(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """hosts with `rules`: those that fit the host or a domain above it, longest first, as (rule, path, verdict).

    Of rules of one length the one with the longer host comes first, then the blocking one. Rules are a list of
    the caller's, so their table is broadcast.
    """
    rows = [(verdict, rule, *rule.split("/", 1)) for verdict, rule in rules]
    listed = hosts.sparkSession.createDataFrame([(v, r, h, f"/{p}") for v, r, h, p in rows], "verdict string, rule string, domain string, path string")
    names = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    fits = hosts.select("host", F.explode(domains).alias("domain")).join(F.broadcast(listed), "domain")
    order = F.struct(
        (-F.length("rule")).alias("a"), (-F.length("domain")).alias("b"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("c"), "rule", "path", "verdict"
    )
    best = fits.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("sorted"))
    kept = F.transform("sorted", lambda r: F.struct(r["rule"].alias("rule"), r["path"].alias("path"), r["verdict"].alias("verdict")))
    return hosts.join(best.select("host", kept.alias("rules")), "host", "left")


def first_rule(rules: Column, path: Column) -> Column:
    return F.try_element_at(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(1))


def targets(pages: DataFrame) -> DataFrame:
    """(src, dst, path, links): absolute links from pages to other hosts, counted; pages without a host have none."""
    found = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.filter("host != ''").select(F.col("host").alias("src"), found.alias("target"))
    links = links.select("src", F.regexp_extract("target", "//(.*)$", 1).alias("rest"))
    links = links.select("src", ascii_lower(F.regexp_extract("rest", "^[^/]*", 0)).alias("dst"), F.regexp_extract("rest", "/.*$", 0).alias("path"))
    return links.filter("dst != '' AND dst != src").groupBy("src", "dst", "path").agg(F.count(F.lit(1)).alias("links"))


def seeds_of(pages: DataFrame, linked: DataFrame, ruled: DataFrame) -> DataFrame:
    """(host, trust, distrust): the shares of a host's pages, and of links to it, that a rule allows and blocks.

    A page or a link that no rule fits counts as neither. pages: host and path; linked: as targets() makes it.
    """
    known = pages.select("host", "path", F.lit(1).alias("links")).union(linked.select(F.col("dst").alias("host"), "path", "links"))
    known = known.groupBy("host", "path").agg(F.sum("links").alias("links"))
    judged = known.join(ruled, "host").withColumn("verdict", first_rule(F.col("rules"), F.col("path"))["verdict"])
    part = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("links")).otherwise(0)) / F.sum("links")
    return judged.groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) received from others. seeds: host, trust, distrust, each from 0 to 1.

    Trust goes along links in proportion to a host's links, distrust against them in proportion to the links that
    a host receives; both start anew from the seeds in each round. Scores do not depend on the number of hosts.
    """
    out = links.groupBy("src").agg(F.sum("links").alias("n"))
    into = links.groupBy("dst").agg(F.sum("links").alias("n"))
    ways = links.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("links") / F.col("n")).alias("w"), F.lit(0).alias("way"))
    back = links.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("links") / F.col("n")).alias("w"), F.lit(1).alias("way"))
    ways = written(ways.union(back))
    start = seeds.select("host", F.lit(0).alias("kind"), F.col("trust").alias("seed")).union(
        seeds.select("host", F.lit(1).alias("kind"), F.col("distrust").alias("seed"))
    )
    start = written(start.filter("seed > 0").withColumn("seed", F.col("seed") * (1 - damping)))
    score = start.select("host", "kind", F.col("seed").alias("score"))
    got = start.select("host", "kind", F.lit(0.0).alias("score")).limit(0)
    for k in range(rounds):
        moved = score.join(ways, (F.col("host") == F.col("a")) & (F.col("kind") == F.col("way")))
        got = moved.groupBy(F.col("b").alias("host"), F.col("way").alias("kind")).agg((F.sum(F.col("score") * F.col("w")) * damping).alias("score"))
        if k % WRITE_EVERY == WRITE_EVERY - 1 or k == rounds - 1:
            got = written(got)
        score = got.union(start).groupBy("host", "kind").agg(F.sum("score").alias("score"))
    of = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)), 9)
    return got.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge_hosts(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, rules, verdict) for every host of pages; pages has host, path and html."""
    linked = written(targets(pages))
    links = linked.groupBy("src", "dst").agg(F.sum("links").alias("links"))
    hosts = pages.select("host").union(linked.select("dst")).distinct()
    ruled = written(rules_table(hosts, rules))
    seeds = seeds_of(pages, linked, ruled)
    got = spread(links, seeds)
    bad = (F.col("distrust") >= LEAST_DISTRUST) & (F.col("distrust") > F.col("trust"))
    return ruled.join(got, "host", "left").select("host", "rules", F.when(bad, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id") -> DataFrame:
    """Per row of pages: page_id, host, path, rule (or null), verdict (allow or block).

    A rule `domain/path` fits the domain and all below it, if the URL's path starts with /path; the longest
    decides. A null URL, or one without ://, has an empty host and path, no rule, and is allowed. Repeated rows
    get a row each, and their links count again. Only id_col, url and html are read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), "html")
    hosts, size = sized(judge_hosts(rows, rules).withColumnRenamed("verdict", "by_links"), F.length("host") + F.size(F.coalesce("rules", F.array())) * 60 + 60)
    found = attach(rows.drop("html"), hosts, size, ["host"]).withColumn("found", first_rule(F.col("rules"), F.col("path")))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "by_links").alias("verdict"))
