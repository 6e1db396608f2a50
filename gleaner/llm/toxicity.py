"""Toxicity from a learned lexicon, met also in misspelled form, and from how each meeting is framed.

The lexicon is learned from labelled documents: words and word stems that tell toxic from clean ones. Its trie,
intersected with Levenshtein automata, gives a deterministic automaton (made as words need it) that finds every
term within its number of edits in one walk over a word. Around each meeting a window of words is scored:
quotation marks and words of reporting speak for quotation, learned neighbours for abuse. A logistic model over
these scores gives the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import append, in_batches
from gleaner.plans.tables import written

TRAIN_ROWS = 20_000  # labelled rows, about, that lexicon and model are fitted on
LEXICON_TERMS = 3000  # terms a lexicon has at most; the strongest are taken
LEAST_TOXIC = 5  # toxic training texts that a term must stand in
LEAST_STRENGTH = 1.5  # lower end of a term's log odds
STEMS = (3, 6)  # lengths of word beginnings that may be terms, as "abc*"
WINDOW = 6  # words on either side of a meeting
STATES = 200_000  # automaton states a task remembers
COUNTED = 500_000  # distinct terms a task counts before it hands on
WORD = re.compile(r"[^\W\d_]+")
# fixed values: words of reporting and kinds of quotation mark
REPORTING = frozenset(
    "said says wrote writes quoted quote quotes called calls term word insult insults slur reported heard citing cited".split()
)
QUOTES = frozenset("\"'“”„‘’«»")


def edits_for(length: int) -> int:
    """Misspellings of short words are other words; longer ones may have one or two edits."""
    return 0 if length < 5 else 1 if length < 9 else 2


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- the automaton


class Matcher:
    """The lexicon's trie intersected with Levenshtein automata, as a deterministic automaton made on demand.

    A state is a set of (trie node, edits spent). Reading a letter keeps to the trie, exchanges a letter, or takes
    one that is not there; letters left out are followed beforehand. A stem matches exactly, whatever follows.
    """

    def __init__(self, lexicon: dict[str, tuple[float, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[float, int, str] | None] = [None]  # weight, edits allowed, term
        self.stem: list[float | None] = [None]
        self.most: list[int] = [0]  # edits allowed to the most generous term below
        for term, (weight, k) in lexicon.items():
            letters, k = (term[:-1], 0) if term.endswith("*") else (term, k)
            node = 0
            self.most[0] = max(self.most[0], k)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            if term.endswith("*"):
                self.stem[node] = weight
            else:
                self.word[node] = (weight, k, term)
        self._reset()

    def _reset(self):
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, int, str] | None] = []
        self.stems: list[float] = []
        self.start = self._state({(0, 0)})

    def _state(self, configs: set) -> int:
        todo, least = list(configs), {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] and e > 0 or least.get(node, 99) <= e:
                continue
            least[node] = e
            if e < self.most[node]:
                todo += [(child, e + 1) for child in self.children[node].values()]  # a letter left out
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(self.word[n][0], e, self.word[n][2]) for n, e in key if self.word[n] and e <= self.word[n][1]]
            self.ends.append(min(ends, key=lambda x: (x[1], -x[0], x[2]), default=None))
            self.stems.append(max((self.stem[n] for n, e in key if e == 0 and self.stem[n] is not None), default=0.0))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                to.add((self.children[node][c], e))
            if e < self.most[node]:
                to.add((node, e + 1))  # a letter too many
                to.update((child, e + 1) for child in self.children[node].values())
        nxt = self._state(to) if to else -1
        self.steps[state][c] = nxt
        return nxt

    def find(self, word: str) -> tuple[float, int, str] | None:
        """(weight, edits, term) of the term met, fewest edits first; a stem counts as -1 edits."""
        if len(self.sets) > STATES:
            self._reset()
        state, stem = self.start, 0.0
        for c in word:
            state = self.steps[state].get(c, -2) if self.steps else -2
            if state == -2:
                return self._slow(word)
            if state < 0:
                break
            if self.stems[state] > stem:
                stem = self.stems[state]
        end = self.ends[state] if state >= 0 else None
        if end and (end[1] == 0 or not stem):
            return end
        return (stem, -1, "*") if stem else None

    def _slow(self, word: str):
        """The walk that makes the states it lacks."""
        state = self.start
        for c in word:
            state = self.steps[state][c] if c in self.steps[state] else self._step(state, c)
            if state < 0:
                break
        return self.find(word)


# ---------------------------------------------------------------- framing and features


@dataclass
class Model:
    """What training gives, all of bounded size: terms with weights, neighbours with weights, coefficients."""

    lexicon: dict[str, tuple[float, int]]  # weight and edits allowed
    neighbours: dict[str, float]
    coefficients: list[float]


FEATURES = 8


def meetings(text: str, matcher: Matcher, memory: dict) -> list[tuple]:
    """(weight, edits, quoted, words around) of every word that meets the lexicon; quoted is 0 to 1."""
    low = text.lower()
    found = {}
    for w in set(WORD.findall(low)):
        if w not in memory:
            if len(memory) > COUNTED:
                memory.clear()
            memory[w] = matcher.find(w)
        if memory[w]:
            found[w] = memory[w]
    if not found:
        return []
    tokens = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    out = []
    for i, (w, start, end) in enumerate(tokens):
        if w not in found:
            continue
        around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
        left = low[max(0, start - 40) : start].rstrip(" ")
        right = low[end : end + 40]
        marked = any(c in QUOTES for c in left[-1:] + right[:1]) or (
            any(c in QUOTES for c in left) and any(c in QUOTES for c in right)
        )
        reported = any(t[0] in REPORTING for t in around)
        weight, edits, _ = found[w]
        out.append((weight, edits, (marked + reported) / 2, [t[0] for t in around]))
    return out


def features(found: list[tuple], words: int, neighbours: dict[str, float]) -> list[float]:
    """What the model sees of a text; all zero where nothing was met."""
    if not found:
        return [0.0] * FEATURES
    exact = sum((1 - q) for _, e, q, _ in found if e == 0)
    near = sum((1 - q) for _, e, q, _ in found if e > 0)
    stems = sum((1 - q) for _, e, q, _ in found if e < 0)
    quoted = sum(q for _, _, q, _ in found)
    strongest = max(w * (1 - q) * (0.7 if e > 0 else 1) for w, e, q, _ in found)
    context = max(min(3.0, max(-3.0, sum(neighbours.get(t, 0.0) for t in around))) for _, _, _, around in found)
    share = sum(w * (1 - q) for w, _, q, _ in found) / math.sqrt(max(words, 1))
    return [math.log1p(exact), math.log1p(near), math.log1p(stems), math.log1p(quoted), strongest / 5, context, share / 5, 1.0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> list[float]:
    """Logistic regression by Newton's method with a ridge; the constant comes last and is not held back."""
    x = np.column_stack([x, np.ones(len(x))])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (y - p) - penalty * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


# ---------------------------------------------------------------- training


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic), written: labelled texts that are not held out, each text once; about `rows` of them.

    Where there are more, rows are taken by a hash of their ids, so any two runs take the same.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, usable.count()))
    taken = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.filter(F.col("text").isNotNull()).join(F.broadcast(taken), "doc_id")  # about `rows` rows of 12 bytes
    return written(texts.groupBy("text").agg(F.max("toxic").alias("toxic")))


def _term_counts():
    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def handed():
            keys = list(held)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [held[k] for k in keys]]
            types = [pa.string(), pa.int32(), pa.int64()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["term", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = set(WORD.findall(text.lower()))
                terms = words | {f"{w[:n]}*" for w in words for n in range(STEMS[0], min(STEMS[1], len(w) - 1) + 1)}
                held.update((t, toxic) for t in terms if len(t) < 64)
                if len(held) > COUNTED:
                    yield handed()
        if held:
            yield handed()

    return run


def learn_lexicon(rows: DataFrame) -> dict[str, tuple[float, int]]:
    """Terms that stand in toxic training texts far more often than in clean ones: log odds and edits allowed."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(_term_counts(), "term string, toxic int, n bigint")
    both = counts.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
    )
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (toxic + 1)) - F.log(c / (clean + 1))
    strength = odds - 1.64 * F.sqrt(1 / t + 1 / c)
    strong = both.filter(F.col("t") >= LEAST_TOXIC).select("term", "t", odds.alias("odds"), strength.alias("strength"))
    strong = strong.filter(F.col("strength") >= LEAST_STRENGTH).orderBy(F.desc("strength"), F.desc("t"), "term")
    terms = strong.limit(LEXICON_TERMS).collect()
    return allow_edits(rows, {r["term"]: r["odds"] for r in terms}, {r["term"]: r["strength"] for r in terms})


def _near_terms(lexicon):
    def make():
        matcher = Matcher(lexicon)

        def rows(texts):
            met = [{matcher.find(w) for w in set(WORD.findall(t.lower()))} - {None} for t in texts]
            return [[sorted({term for _, e, term in ms if e > 0}) for ms in met]]

        return rows

    return make


def allow_edits(rows: DataFrame, lexicon: dict[str, float], strength: dict[str, float]) -> dict[str, tuple[float, int]]:
    """The lexicon with the edits that each term may be away from a word.

    A term that clean training texts come near to by chance loses as much strength as if it stood in them; if
    too little is left, it is met in its own spelling only.
    """
    wide = {t: (w, 0 if t.endswith("*") else edits_for(len(t))) for t, w in lexicon.items()}
    clean = rows.filter("toxic = 0").select("text")
    near = in_batches(clean, _near_terms(wide), "terms array<string>").select(F.explode("terms").alias("term"))
    chance = {r["term"]: r["count"] for r in near.groupBy("term").count().collect()}  # no more than the lexicon
    return {t: (w, k if strength[t] - math.log(2 * chance.get(t, 0) + 1) >= 2 * LEAST_STRENGTH else 0) for t, (w, k) in wide.items()}


def _learned(lexicon: dict[str, tuple[float, int]], neighbours: dict[str, float] | None):
    """Features of training texts; without neighbours, the words around meetings instead."""

    def make():
        matcher, memory = Matcher(lexicon), {}

        def rows(texts, toxic):
            met = [meetings(t, matcher, memory) for t in texts]
            if neighbours is None:
                return [[sorted({w for m in ms for w in m[3]}) for ms in met], toxic]
            sizes = [len(WORD.findall(t)) for t in texts]
            x = [features(ms, n, neighbours) for ms, n in zip(met, sizes)]
            # toxic texts once more as if every term were misspelled: they are rare, and mean the same
            bent = [
                features([(w, 1, q, a) for w, _, q, a in ms], n, neighbours) for ms, n, y in zip(met, sizes, toxic) if y and ms
            ]
            return [x + bent, toxic + [1] * len(bent)]

        return rows

    return make


def learn_neighbours(rows: DataFrame, lexicon: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Log odds of words beside meetings in toxic against clean texts; empty where all meetings are in one kind."""
    around = in_batches(rows.select("text", "toxic"), _learned(lexicon, None), "words array<string>, toxic int")
    around = written(around.filter(F.size("words") > 0))
    totals = {r["toxic"]: r["count"] for r in around.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if min(toxic, clean) < LEAST_TOXIC:
        return {}
    t = F.sum("toxic")
    counted = around.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(
        t.alias("t"), (F.count(F.lit(1)) - t).alias("c")
    )
    odds = F.log((F.col("t") + 1) / (toxic + 2)) - F.log((F.col("c") + 1) / (clean + 2))
    told = counted.select("word", odds.alias("odds"), (F.col("t") + F.col("c")).alias("n")).filter("n >= 10 AND abs(odds) >= 0.7")
    return {r["word"]: r["odds"] for r in told.orderBy(F.desc("n"), "word").limit(LEXICON_TERMS).collect()}


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit lexicon, neighbours and coefficients on about `rows` labelled rows that are not held out.

    Without toxic or without clean rows the model gives every text the share of toxic ones, or 0 if there are none.
    """
    known = training_rows(docs, labels, rows)
    lexicon = learn_lexicon(known)
    neighbours = learn_neighbours(known, lexicon) if lexicon else {}
    made = in_batches(known.select("text", "toxic"), _learned(lexicon, neighbours), "x array<double>, toxic int")
    counted = made.groupBy("x", "toxic").count().collect()  # no more than `rows`
    if not counted:
        return Model({}, {}, [0.0] * FEATURES + [-30.0])
    x = np.array([r["x"] for r in counted for _ in range(r["count"])])
    y = np.array([r["toxic"] for r in counted for _ in range(r["count"])], float)
    return Model(lexicon, neighbours, fit(x, y))


# ---------------------------------------------------------------- scoring


def _scorer(model: Model):
    def make():
        matcher, memory = Matcher(model.lexicon), {}
        weights = np.array(model.coefficients)

        def scored(texts):
            x = []
            for text in texts:
                met = meetings(text or "", matcher, memory)
                x.append(features(met, len(WORD.findall(text)) if met else 0, model.neighbours) + [1.0])
            scores = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, FEATURES + 1) @ weights, -30, 30)))
            scores = [round(s, 9) for s in scores.tolist()]
            return scores, [int(s >= 0.5) for s in scores]

        return scored

    return make


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score is 0.5 or more).

    A null or empty text has the score of a text that meets nothing. Only id_col, for held_out, and text are read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), "text")
    return append(rows, ["text"], _scorer(model), "score double, predicted int").drop("text")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not predicted to be toxic."""
    made = append(docs, ["text"], _scorer(model), "__score double, __predicted int")
    return made.filter("__predicted = 0").drop("__score", "__predicted")
