"""The registered queries on the corpus tables, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import html_text, licenses, pii, toxicity, url_filter
from gleaner.llm.common import LOWER, UPPER, table
from gleaner.llm.decontaminate import contamination
from gleaner.llm.exact_search import top_k
from gleaner.llm.jaccard import jaccard_components
from gleaner.llm.packing import pack
from gleaner.llm.prefix_trie import shared_beginnings
from gleaner.llm.runs import find_runs
from gleaner.llm.secrets import MORE_RULES, report
from gleaner.llm.token_counts import token_counts
from gleaner.plans.tables import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM
  (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g FROM
  (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, item_id, s, n FROM gram JOIN win USING (n, g)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""


@query("op2_benchmark_decontamination", DECONTAMINATE_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """With a cache of its own for each call, so that all distinct texts are encoded; a pipeline passes a lasting one."""
    return token_counts(table(spark, folder, "documents"), f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def sql_spans(rules: list[tuple[str, str, int, str]]) -> str:
    """CTEs d (r, doc_id, t) and span (r, k, kind, s, e): matches, leftmost and not overlapping, that pass a test.

    rules: kind, pattern, group, and the test on that group as `v` and the match as `x`. A match and the gap before
    it are taken together, so places follow from lengths.
    """
    found = " UNION ALL ".join(
        f"""SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '(?s)(.*?)({p})', 1) AS g,
        regexp_extract_all(t, '(?s)(.*?)({p})', 2) AS xs, regexp_extract_all(t, '(?s)(.*?)({p})', {group + 2}) AS vs FROM d"""
        for k, (kind, pattern, group, _) in enumerate(rules)
        for p in [pattern.replace("'", "''")]
    )
    tests = " OR ".join(f"(k = {k} AND {test})" for k, (_, _, _, test) in enumerate(rules))
    return f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (SELECT r, k, kind, g, xs, vs, unnest(range(1, len(xs) + 1)) AS i FROM found WHERE len(xs) > 0),
match AS (SELECT r, k, kind, xs[i] AS x, vs[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda a: length(a)))
  + coalesce(list_sum(list_transform(xs[1:i - 1], lambda a: length(a))), 0) AS BIGINT) AS s FROM placed),
span AS (SELECT r, k, kind, s, s + length(x) AS e FROM match WHERE {tests})"""


def sql_report(kinds: list[str], base: int) -> str:
    """Counts per base kind, the digest of base spans, and all spans, per document."""
    counts = ", ".join(f"coalesce(sum(CASE WHEN kind = '{kind}' THEN 1 END), 0)::BIGINT AS n_{kind}" for kind in kinds[:base])
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce({joined} FILTER (WHERE k < {base}), '')) AS base_sha256, coalesce({joined}, '') AS spans
FROM d LEFT JOIN span USING (r) GROUP BY r"""


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
SECRET_SQL_RULES = [
    ("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 12"),
    ("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 18"),
    ("hex", "[0-9a-f]+", 0, "length(v) >= 16"),
] + [(r.kind, r.pattern, r.group, f"length(v) >= {r.least}") for r in MORE_RULES]


@query("op4_secret_scan", f"WITH {sql_spans(SECRET_SQL_RULES)} {sql_report([r[0] for r in SECRET_SQL_RULES], 3)}")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents"))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op5_personal_data")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"), whole=True)


SEARCH_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op3_exact_top_k_search", SEARCH_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


def _url_sql() -> str:
    """Rules, seeds by shares of pages and links, and rounds of trust as in url_filter, a round per table expression."""
    d, rules = url_filter.DAMPING, url_filter.RULES
    listed = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in rules)
    rounds = ""
    for k in range(1, url_filter.ROUNDS + 1):
        before = "SELECT host, kind, seed AS score FROM start" + (f" UNION ALL SELECT * FROM got{k - 1}" if k > 1 else "")
        rounds += f""",
got{k} AS MATERIALIZED (SELECT w.b AS host, w.kind AS kind, sum(s.score * w.w) * {d} AS score
  FROM (SELECT host, kind, sum(score) AS score FROM ({before}) GROUP BY host, kind) s JOIN ways w ON s.host = w.a AND s.kind = w.kind
  GROUP BY w.b, w.kind)"""
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    link = url_filter.LINK.replace("'", "''")
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, html, coalesce({rest}, '') AS rest FROM pages),
h AS (SELECT r, page_id, html, {low % "regexp_extract(rest, '^[^/?#]*')"} AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
rules(verdict, rule, domain, prefix) AS (VALUES {listed}),
target AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS t FROM h WHERE host <> ''),
pairs AS (SELECT src, regexp_extract(t, '//(.*)$', 1) AS rest FROM target),
linked AS (SELECT src, dst, path, count(*) AS links FROM (SELECT src, {low % "regexp_extract(rest, '^[^/]*')"} AS dst,
  regexp_extract(rest, '/.*$') AS path FROM pairs) WHERE dst <> '' AND dst <> src GROUP BY src, dst, path),
links AS (SELECT src, dst, sum(links) AS links FROM linked GROUP BY src, dst),
known AS (SELECT host, path, sum(links) AS links FROM (SELECT host, path, 1 AS links FROM h UNION ALL SELECT dst, path, links FROM linked) GROUP BY host, path),
judged AS (SELECT host, path, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, length(domain) DESC, verdict DESC) AS k
  FROM known JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)),
shares AS (SELECT host, sum(CASE WHEN verdict = 'allow' THEN links ELSE 0 END) / sum(links) AS trust,
  sum(CASE WHEN verdict = 'block' THEN links ELSE 0 END) / sum(links) AS distrust
  FROM known LEFT JOIN (SELECT * FROM judged WHERE k = 1) USING (host, path) GROUP BY host),
start AS (SELECT host, 0 AS kind, trust * {1 - d} AS seed FROM shares WHERE trust > 0
  UNION ALL SELECT host, 1, distrust * {1 - d} FROM shares WHERE distrust > 0),
ways AS (SELECT src AS a, dst AS b, links / sum(links) OVER (PARTITION BY src) AS w, 0 AS kind FROM links
  UNION ALL SELECT dst, src, links / sum(links) OVER (PARTITION BY dst), 1 FROM links){rounds},
score AS (SELECT host, round(sum(CASE kind WHEN 0 THEN score ELSE 0 END), 9) AS trust,
  round(sum(CASE kind WHEN 1 THEN score ELSE 0 END), 9) AS distrust FROM got{url_filter.ROUNDS} GROUP BY host),
fit AS (SELECT r, rule, verdict FROM (SELECT r, rule, verdict, row_number() OVER
  (PARTITION BY r ORDER BY length(rule) DESC, length(domain) DESC, verdict DESC) AS k
  FROM h JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)) WHERE k = 1)
SELECT page_id, h.host AS host, path, rule, coalesce(verdict, CASE WHEN distrust >= {url_filter.LEAST_DISTRUST}
  AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit USING (r) LEFT JOIN score ON score.host = h.host
"""


@query("op6_url_filter", _url_sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


@query("op7_html_extraction")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def _license_sql() -> str:
    """Every k-gram of a text against every k-gram of the templates; diagonals merged and shares counted as in licenses."""
    templates = [*licenses.PHRASES, *licenses.NOTICES]
    listed = ", ".join(f"({k}, {t.exact}, '{t.label}', '{t.text.replace(chr(39), chr(39) * 2)}')" for k, t in enumerate(templates))
    grams = "array_to_string(w[p + 1 : p + size], ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS w FROM documents),
t AS (SELECT template, exact, label, {_sql_words("text")} AS w FROM (VALUES {listed}) AS x(template, exact, label, text)),
tg AS (SELECT template, exact, n, size, p AS place, {grams} AS gram FROM (SELECT *, unnest(range(0, n - size + 1)) AS p FROM
  (SELECT *, len(w) AS n, least(len(w), {licenses.GRAM}) AS size FROM t))),
dg AS (SELECT r, size, p, {grams} AS gram FROM
  (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM tg) WHERE len(w) >= size)),
hit AS (SELECT r, template, exact, n, size, place, p - place AS diagonal FROM dg JOIN tg USING (size, gram)),
opened AS (SELECT r, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER w > CASE WHEN exact THEN 0 ELSE {licenses.SHIFT} END
  OR lag(diagonal) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM (SELECT DISTINCT r, template, exact, diagonal FROM hit) WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
merged AS (SELECT r, template, diagonal, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM opened),
held AS (SELECT r, template, span, any_value(n) AS n, min(diagonal + place) AS start, list(range(place, place + size)) AS places
  FROM hit JOIN merged USING (r, template, diagonal) GROUP BY r, template, span),
found AS (SELECT r, template, start, round(len(list_distinct(flatten(places))) / n, 6) AS share FROM held),
named AS (SELECT r, template < {len(licenses.PHRASES)} AS base, start, share, label FROM found JOIN t USING (template)),
per AS (SELECT r, count(*) FILTER (WHERE base AND share = 1) AS n_base, min(start) FILTER (WHERE base AND share = 1) AS first_word,
  max(start) FILTER (WHERE base AND share = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND share = 1) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share = 1 AND base OR share >= {licenses.LEAST_SHARE} AND NOT base) AS labels,
  max(share) AS score FROM named GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0) AS score FROM d LEFT JOIN per USING (r)
"""


@query("op12_license_scan", _license_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.report(table(spark, folder, "documents"))


# crc32 by its table of 256 entries, as CTE crc_table and an expression on a text in ASCII
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(%s, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"""

TRIE_SQL = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER
  (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {CRC % "CAST(conv_id AS VARCHAR)"} % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc_table),
heads AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS head FROM convs c LEFT JOIN (SELECT conv_id AS base, n AS n FROM convs) b USING (base)),
r AS (SELECT conv_id, head + place - h AS place, role, text FROM t JOIN heads USING (conv_id) WHERE place > h
  UNION ALL SELECT c.conv_id, place, role, text FROM heads c JOIN t ON t.conv_id = c.base WHERE place <= h),
seq AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY place) AS marks,
  list(strlen(text) ORDER BY place) AS sizes FROM r GROUP BY conv_id),
passed AS (SELECT conv_id, depth, array_to_string(marks[1:depth], ',') AS node, marks[1:depth] AS path, depth = len(marks) AS ends,
  CASE depth WHEN 0 THEN 0 ELSE sizes[depth] END AS bytes
  FROM (SELECT *, unnest(range(0, len(marks) + 1)) AS depth FROM (SELECT conv_id, coalesce(marks, []) AS marks, sizes FROM convs LEFT JOIN seq USING (conv_id)))),
nodes AS (SELECT node, depth, any_value(path) AS path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
  string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM passed GROUP BY node, depth),
linked AS (SELECT *, CASE WHEN depth > 0 THEN array_to_string(path[1:depth - 1], ',') END AS parent FROM nodes),
kids AS (SELECT parent AS node, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent),
below AS (SELECT array_to_string(path[1:a], ',') AS node, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM
  (SELECT path, own, n_children IS NULL AS leaf, unnest(range(0, depth + 1)) AS a FROM nodes LEFT JOIN kids USING (node)) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
  sha256(coalesce(n.ids, '')) AS ends_sha256
FROM linked n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""


@query("op13_conversation_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return shared_beginnings(table(spark, folder, "conversations"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document, by the crc32 of its id, ends in words that repeat.

    With h the crc32 of the decimal id, g = h div 10 and n words, words from a = g mod n on repeat with the period
    1 + (n - a) div (3 + g mod 8), if h mod 10 is 0. Documents without an id or words stay as they are.
    """
    docs = docs.select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen, g = F.col("h") % 10 == 0, F.expr("h div 10")
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    cut = docs.withColumn("words", F.when(chosen, words)).withColumn("g", g).withColumn("n", F.size("words"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def _most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of those that tie."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    more = lambda best, r: best["period"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(kind), lambda best, r: F.when(more(best, r), r).otherwise(best))


RUNS_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w0 AS (SELECT r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  {CRC % "CAST(doc_id AS VARCHAR)"} AS h FROM d, crc_table),
w1 AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w0),
w2 AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM w1),
w3 AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM w2),
one AS (SELECT r, i, w[i + 1] AS word FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM w3)),
gram AS (SELECT r, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS g, lead(word, 2) OVER o IS NOT NULL AS full3
  FROM one WINDOW o AS (PARTITION BY r ORDER BY i)),
pair AS (SELECT x.r AS r, x.i AS i, y.i - x.i AS q FROM gram x JOIN gram y ON x.r = y.r AND x.g = y.g AND y.i > x.i
  JOIN w3 ON w3.r = x.r WHERE x.full3 AND y.full3 AND 4 * (y.i - x.i) <= len(w3.w)),
chain AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT r, q, min(i) AS s, max(i) + 2 + q - min(i) + 1 AS length FROM chain GROUP BY r, q, k),
run AS (SELECT r, s AS start, length, min(q) AS period FROM stretch GROUP BY r, s, length HAVING length >= greatest(6, 4 * min(q))),
said AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM run GROUP BY r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM run) WHERE k = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM one ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w3 LEFT JOIN said USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


@query("op11_periodic_runs", RUNS_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    made = find_runs(made_periodic(table(spark, folder, "documents"))).withColumn("best", _most_repeated(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return made.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
