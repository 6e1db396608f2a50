"""Exact self-join of documents by the Jaccard similarity of their word shingles, as a metric-space join.

Jaccard distance is a metric, so pivots, Voronoi regions and windows from the triangle inequality apply: a
document within eps of one whose nearest pivot is p has a distance to p at most 2 eps above its least one.
But unrelated texts share no shingle: nearly all distances are 1, every pivot is equally near, and every
document lies in every window. So texts that cannot be linked are first set apart exactly:

1. Linked sets a, b differ in at most r(|a| + |b|) shingles. Sets are dealt to classes of size, with copies of
   those at a border to the class above. In a class, shingles are dealt by hash to more parts than two linked
   sets can differ in, so linked sets agree on whole parts. Parts of few shingles, or of shingles that many texts
   have, say little: there are more parts by a share, and a set leaves out as many of the weakest. Of the parts that
   two linked sets agree on, the strongest is left out by neither. Which shingles many texts have is told by a sample,
   which affects speed only. Sets that agree on a part are neighbours; components of neighbours are coarse regions,
   and no link leaves one. Parts that hold nothing are agreed on by strangers, so they are weakest and never sent; a set
   with more of them than it leaves out is dealt by its rarest shingles as well, of which linked sets share one.
2. A coarse region above the limits of a task is parted again, by the rarest shingles of its sets alone, where rare is
   what few of its own sets have; so are the regions that this leaves, as long as it parts much.
3. A coarse region is joined by pivots: exact distances to them give links; the rest goes to the region of its
   nearest pivot and, as a copy, to every region in whose window it lies; regions are joined the same way again.
   Documents already connected are not compared, since only components are asked for.
4. A region still above the limits of a task takes its pivot round in Spark; its cells (nearest pivot, ring of
   distance) are cut into blocks, and pairs of blocks that the triangle inequality cannot rule out are tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import common as limits
from gleaner.llm.common import attach, give_back, in_batches, sized, text_key
from gleaner.llm.components import components
from gleaner.plans.tables import forget, let_go, written

REGION_SETS, REGION_SHINGLES = 4000, 2_000_000  # a region above either is joined by many tasks
PIVOTS = 12  # of a region in Spark
SPARE, SPARE_SHARE = 2, 0.3  # parts beyond those needed, and as a share of them; a set leaves out as many
SAMPLE_TEXTS, COMMON_SHINGLES = 10_000, 1_000_000  # texts looked at for shingles that many have, and most of these kept
CLASS_RATIO = 1.6
COUNTED_SHINGLES = 50_000_000  # of large regions, looked at for those that many of their sets have
PARTED = 0.9  # share of sets in large regions above which parting them again is given up
KNOWN_WORDS = 250_000
MARKS_HELD = 500_000  # marks that a task ties at once
SIEVE_BITS = 26  # of a set's number, told apart when shingles are kept of some sets only

# ---------------------------------------------------------------- sets and parts


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finishing steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingler(q: int):
    """A function from a text to the sorted 64-bit hashes of its distinct q-word shingles.

    A-Z are lower-cased, words end at ASCII white space. A text of fewer words, but not none, is one shingle.
    """
    import xxhash

    factors = _mix(np.arange(1, q + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    known: dict[bytes, int] = {}

    def word(w: bytes) -> int:
        h = known.get(w)
        if h is None:
            if len(known) > KNOWN_WORDS:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(word, words), np.uint64, len(words))
        n = len(words) - q + 1
        if n < 1:
            return _mix((h * factors[: len(h)]).sum(dtype=np.uint64, keepdims=True) + factors[q : q + 1] * np.uint64(len(h)))
        total = h[:n] * factors[0]
        for i in range(1, q):
            total += h[i : i + n] * factors[i]
        return np.unique(_mix(total))

    return shingles


def size_classes(limit: int, num: int, den: int) -> list[tuple[int, int]]:
    """(smallest size, most shingles in which linked sets differ) of each class, the larger set being in it."""
    out, low = [], 1
    while low <= limit:
        above = max(low + 1, int(low * CLASS_RATIO))
        out.append((low, 2 * (above - 1) * (den - num) // (den + num)))
        low = above
    return out


def _found(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted array `of` (not empty) where values may stand, and whether they do."""
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return at, of[at] == values


def rarest(codes: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """As many of a set's codes as make linked sets share one: first those with the smallest `often`, then by hash.

    Linked sets share num / den of either at least, so neither leaves out the first of their common codes. often must
    follow from the code alone.
    """
    n = len(codes)
    return codes[np.lexsort((_mix(codes), often))[: n - -(-n * num // den) + 1]]


def signatures(shingles: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of (class, part, content of the part), for the set's class and those above that it borders on.

    Of differ + 1 + spare parts linked sets agree on spare + 1 or more. Each leaves out its spare weakest, in an order
    that follows from a part's content only: the strongest part they agree on has spare weaker ones in both. common
    are sorted shingles that do not count for a part's strength. Parts without content are the weakest and are never
    sent: linked sets that agree on no others have more than spare of them, and share one of their rarest shingles.
    """
    n, out, sparse = len(shingles), [], False
    spread, content = _mix(shingles), _mix(shingles ^ np.uint64(0x9E3779B97F4A7C15))
    telling = np.ones(n)
    if common is not None and len(common):
        telling = 1.0 - _found(shingles, common)[1]
    classes = size_classes(n * den // num + 1, num, den)
    home = max(k for k, (low, _) in enumerate(classes) if low <= n)
    for k in range(home, len(classes)):
        low, differ = classes[k]
        if k > home and n * den < num * low:
            break
        if not differ:
            continue  # linked sets of this class are equal
        spare = SPARE + int(SPARE_SHARE * differ)
        parts = differ + 1 + spare
        part = ((spread >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        sums = np.zeros(parts, np.uint64)
        sums[filled] = np.add.reduceat(content[order], first)
        marks = _mix(sums + _mix(np.uint64(k << 40) + np.arange(parts, dtype=np.uint64)))
        strength = np.bincount(part, weights=telling, minlength=parts)
        empty = np.ones(parts, bool)
        empty[filled] = False
        strength[empty] = -1
        sparse = sparse or parts - len(filled) > spare
        strong = np.lexsort((marks, strength))[spare:]
        out.append(marks[strong[~empty[strong]]])
    if sparse:
        out.append(rarest(_mix(content + np.uint64(1)), 1 - telling, num, den))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _stars(marks: np.ndarray, nodes: np.ndarray):
    """(marks, their smallest nodes) and the edges from other nodes of a mark to it, each once."""
    order = np.lexsort((nodes, marks))
    marks, nodes = marks[order], nodes[order]
    first = np.concatenate([[True], marks[1:] != marks[:-1]])
    hubs = nodes[first][np.cumsum(first) - 1]
    away = nodes != hubs
    a, b = nodes[away], hubs[away]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    return marks[first], nodes[first], a[new], b[new]


def _forest():
    """Function that keeps, of the edges it is given, those that connect what earlier ones did not."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def kept(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = top(x), top(y)
            if x != y:
                above[max(x, y)] = min(x, y)
                keep[i] = True
        return a[keep], b[keep]

    return kept


def _tied(sets: Iterator[tuple[bytes, Callable[[], np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, b) from sets (key, their marks): kind 0, a mark and a set that has it; kind 1, an edge of two sets.

    Sets of one task that share a mark are tied by edges at once, so a mark leaves a task with few sets only, and
    a content that very many sets share costs no more rows than there are tasks. Edges of a task are a forest: fewer
    than its sets.
    """
    kept = _forest()
    marks: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    held, known = 0, set()

    def rows(kind: int, a: np.ndarray, b: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def tied():
        m, h, a, b = _stars(np.concatenate(marks).view(np.int64), np.concatenate(nodes))
        yield rows(0, m, h)
        yield rows(1, *kept(a, b))

    for key, of in sets:
        if key in known:  # a copy
            continue
        known.add(key)
        marks.append(of())
        nodes.append(np.full(len(marks[-1]), _node(key), np.int64))
        held += len(marks[-1])
        if held > MARKS_HELD:
            yield from tied()
            marks, nodes, held = [], [], 0
        if len(known) > KNOWN_WORDS:
            known.clear()
            kept = _forest()
    if held:
        yield from tied()
    marks, nodes = [], []
    give_back()


MARKED = "kind tinyint, a bigint, b bigint"


def _marks(q: int, num: int, den: int, common: Broadcast):
    """Rows of _tied from texts, by the contents of parts."""

    def run(batches):
        shingles = shingler(q)

        def sets():
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    s = shingles(text)
                    if len(s):
                        yield _key(s), lambda s=s: signatures(s, num, den, common.value)

        return _tied(sets())

    return run


def _tie_hubs(batches):
    """Edges between the sets that tasks sent for one mark, as a forest; all rows of a mark are in one partition."""
    marks, hubs, kept = [], [], _forest()
    edges = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    for x in batches:
        kind, a, b = (x.column(n).to_numpy() for n in ("kind", "a", "b"))
        marks.append(a[kind == 0])
        hubs.append(b[kind == 0])
        if (kind == 1).any():
            yield edges(*kept(a[kind == 1], b[kind == 1]))
    if marks and sum(map(len, marks)):
        _, _, a, b = _stars(np.concatenate(marks), np.concatenate(hubs))
        yield edges(*kept(a, b))


def _node(key: bytes) -> int:
    """Half of a set's key; what a set is called until its shingles are compared."""
    return int.from_bytes(key[:8], "big", signed=True)


def _sieve(nodes: DataFrame) -> np.ndarray:
    """A bit for the last SIEVE_BITS bits of every node; whatever the number of nodes, these bits are all that is collected."""
    slot = F.col("node").bitwiseAND(F.lit(2**SIEVE_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63L AS int))")
    words = nodes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(2**SIEVE_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _passes(bits: np.ndarray, node: int) -> bool:
    slot = node & (2**SIEVE_BITS - 1)
    return bool(int(bits[slot >> 6]) >> (slot & 63) & 1)


DESCRIBED = "doc_id bigint, key binary, n_shingles bigint, set_key binary, node bigint, shingles binary"


def _describe(q: int, sieve: Broadcast):
    """A row per document; shingles of a set that the sieve lets through come with the first of its documents in a task."""

    def make():
        shingles = shingler(q)
        known: set[bytes] = set()
        bits = sieve.value

        def rows(doc_ids, keys, texts):
            sizes, set_keys, nodes, blobs = [], [], [], []
            if len(known) > KNOWN_WORDS:
                known.clear()
            for text in texts:
                s = shingles(text)
                key = _key(s) if len(s) else None
                sizes.append(len(s))
                set_keys.append(key)
                nodes.append(_node(key) if key else None)
                wanted = key and key not in known and _passes(bits, nodes[-1])
                blobs.append(s.tobytes() if wanted else None)
                known.add(key)
            return doc_ids, keys, sizes, set_keys, nodes, blobs

        return rows

    return make


# ---------------------------------------------------------------- joining a region inside a task


class Region:
    """Sets of a region, with labels of what is known to be connected."""

    LEAF, PIVOTS = 40, 6

    def __init__(self, blobs: list[bytes], labels: np.ndarray, num: int, den: int):
        arrays = [np.frombuffer(b, np.uint64) for b in blobs]
        self.sizes = np.array([len(a) for a in arrays], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        values, flat = np.unique(np.concatenate(arrays), return_inverse=True)
        self.flat, self.seen = flat, np.zeros(len(values), bool)
        self.labels, self.num, self.den = labels, num, den
        self.eps = 1 - num / den + 1e-9
        self.links: list[tuple[int, int]] = []

    def common(self, i: int, among: np.ndarray) -> np.ndarray:
        """Shingles that set i shares with each of the sets among."""
        own = self.flat[self.ends[i] : self.ends[i + 1]]
        self.seen[own] = True
        sizes = self.sizes[among]
        if len(among) == len(self.sizes):
            held = self.seen[self.flat]
        else:
            starts = np.cumsum(sizes) - sizes
            held = self.seen[self.flat[np.arange(sizes.sum()) + np.repeat(self.ends[among] - starts, sizes)]]
        self.seen[own] = False
        return np.add.reduceat(held.astype(np.int32), np.cumsum(sizes) - sizes)

    def compare(self, i: int, among: np.ndarray) -> np.ndarray:
        """Distances of set i to the sets among; what is linked gets one label."""
        shared = self.common(i, among).astype(np.int64)
        both = self.sizes[i] + self.sizes[among]
        near = among[shared * (self.num + self.den) >= self.num * both]
        for label in np.unique(self.labels[near]):
            if label != self.labels[i]:
                self.links.append((i, int(near[self.labels[near] == label][0])))
                self.labels[self.labels == label] = self.labels[i]
        return 1 - shared / (both - shared)

    def possible(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those among that may be linked with i and are not known to be connected with it."""
        a, b = np.minimum(self.sizes[i], self.sizes[among]), np.maximum(self.sizes[i], self.sizes[among])
        return among[(self.labels[among] != self.labels[i]) & (a * self.den >= self.num * b)]

    def solve(self, among: np.ndarray) -> None:
        """Voronoi regions of a few pivots, joined in turn; directly when small or when windows part nothing."""
        if len(among) < 2 or (self.labels[among] == self.labels[among[0]]).all():
            return
        if len(among) <= self.LEAF:
            return self.directly(among)
        pivots = among[:: -(-len(among) // self.PIVOTS)]
        far = np.stack([self.compare(p, among) for p in pivots])
        least, home = far.min(axis=0), far.argmin(axis=0)
        rest = ~np.isin(among, pivots)
        regions = [
            among[rest & (far[j] - least <= 2 * self.eps)] for j in range(len(pivots)) if (rest & (home == j)).any()
        ]
        if max(map(len, regions), default=0) > 0.7 * len(among):
            return self.directly(among[rest])
        for region in regions:
            self.solve(region)

    def directly(self, among: np.ndarray) -> None:
        """Compare, smallest component first, each set with those of other components not compared yet."""
        waiting = among
        while len(waiting):
            labels, counts = np.unique(self.labels[waiting], return_counts=True)
            if len(labels) < 2:
                return
            i = waiting[self.labels[waiting] == labels[counts.argmin()]][0]
            waiting = waiting[waiting != i]
            others = self.possible(i, waiting)
            if len(others):
                self.compare(i, others)

    def across(self, left: np.ndarray, right: np.ndarray) -> None:
        """All pairs between two blocks."""
        if len(left) > len(right):
            left, right = right, left
        for i in left:
            others = self.possible(i, right)
            if len(others):
                self.compare(i, others)


def _groups(batches, column: str) -> Iterator[dict]:
    """Runs of rows with one value of the column, as lists by column, from batches sorted by it."""
    held: dict | None = None
    for batch in batches:
        rows = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = rows[column]
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            part = {n: v[start:i] for n, v in rows.items()}
            if held is not None and held[column][0] == keys[start]:
                for n in held:
                    held[n] += part[n]
            else:
                if held is not None:
                    yield held
                held = part
            start = i
    if held is not None:
        yield held


LINK = "a binary, b binary"


def _link_batches(pairs: list):
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def _join_groups(num: int, den: int):
    """Links inside groups of sets; a group of two blocks (`side` 0 and 1) is joined across only."""

    def run(batches):
        for g in _groups(batches, "task"):
            first = {k: i for i, k in reversed(list(enumerate(g["set_key"])))}  # several tasks may have sent a set
            if len(first) < 2:
                continue
            g = {n: [v[i] for i in sorted(first.values())] for n, v in g.items()}
            keys = g["set_key"]
            _, labels = np.unique(np.array(g["label"], dtype=object), return_inverse=True)
            region = Region(g["shingles"], labels, num, den)
            side = np.array(g["side"])
            if (side == 1).any():
                region.across(np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            else:
                region.solve(np.arange(len(keys)))
            if region.links:
                yield _link_batches([(keys[i], keys[j]) for i, j in region.links])

    return run


def _joined(groups: DataFrame, num: int, den: int) -> DataFrame:
    """groups: task, side, label, set_key, shingles; tasks are small, so whole ones go to partitions by hash."""
    dealt = groups.select("task", "side", "label", "set_key", "shingles").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_join_groups(num, den), LINK)


# ---------------------------------------------------------------- regions that many tasks join


def _distances(num: int, den: int):
    """Per set of a large region: distances to the region's pivots and the pivots linked with it."""

    def make():
        def rows(keys, regions, pivots, sizes, blobs):
            far, linked = [], []
            for blob, ps in zip(blobs, pivots, strict=True):
                own = np.frombuffer(blob, np.uint64)
                d, near = [], []
                for p in ps:
                    other = np.frombuffer(p["shingles"], np.uint64)
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    both = len(own) + len(other)
                    d.append(1 - shared / (both - shared))
                    if shared * (num + den) >= num * both:
                        near.append(p["set_key"])
                far.append(d)
                linked.append(near)
            return keys, regions, sizes, blobs, far, linked

        return rows

    return make


def _large_regions(members: DataFrame, num: int, den: int, block_sets: int, block_shingles: int) -> DataFrame:
    """Links of regions above the limits. members: region, set_key, n, shingles, one row per set.

    A pivot round: PIVOTS sets of each region, those with the smallest hashes, are compared with all its sets.
    Sets linked with a pivot are labelled by the pivots' components. Cells (label, nearest pivot, ring) are put
    together, or cut by hash, into blocks within about twice the limits. Two blocks are joined unless they hold one label only or, for some
    pivot, their distances to it are more than eps apart.
    """
    eps = (den - num) / den + 1e-9
    ids = members.select("region", "set_key", F.xxhash64("set_key").alias("h"))
    # PIVOTS of each share of a region first, so no list grows with the region
    some = ids.groupBy("region", F.pmod(F.col("h"), F.lit(1024)).alias("share")).agg(F.min(F.struct("h", "set_key")).alias("x"))
    chosen = some.groupBy("region").agg(F.slice(F.array_sort(F.collect_list("x")), 1, PIVOTS).alias("xs"))
    chosen = chosen.select("region", F.explode("xs.set_key").alias("set_key"))
    pivots, pivots_size = sized(
        chosen.join(members, ["region", "set_key"]).groupBy("region").agg(
            F.array_sort(F.collect_list(F.struct("set_key", "shingles"))).alias("pivots")
        ),
        F.aggregate("pivots", F.lit(0), lambda t, p: t + F.length(p["shingles"]) + 32),
    )
    paired = attach(members, pivots, pivots_size, ["region"], "inner").select("set_key", "region", "pivots", "n", "shingles")
    near = written(
        in_batches(
            paired,
            _distances(num, den),
            "set_key binary, region bigint, n bigint, shingles binary, far array<double>, linked array<binary>",
        )
    )
    links = near.select(F.col("set_key").alias("a"), F.explode("linked").alias("b")).filter(F.col("a") != F.col("b"))
    links = written(links)
    # a few pivots per region and what connects them through sets linked with two of them
    ties = near.filter(F.size("linked") > 1).select(
        F.col("linked")[0].alias("a"), F.explode(F.slice("linked", 2, PIVOTS)).alias("b")
    )
    tied = components(ties.distinct())
    label = near.withColumn("pivot", F.try_element_at("linked", F.lit(1))).join(
        tied.select(F.col("node").alias("pivot"), "root"), "pivot", "left"
    )
    label = label.withColumn("label", F.coalesce("root", "pivot", "set_key"))
    least = F.array_min("far")
    cells = label.withColumn("home", F.array_position("far", least)).withColumn("ring", F.floor(least / F.lit(eps)))
    free = F.col("pivot").isNull()
    cells = cells.withColumn("of", F.when(free, F.lit(b"").cast("binary")).otherwise(F.col("label")))
    cell = ["region", "of", "home", "ring"]
    weight = cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    load = F.greatest(F.col("sets") / block_sets, F.col("total") / block_shingles)
    before = Window.partitionBy("region", "of").orderBy("home", "ring").rowsBetween(Window.unboundedPreceding, -1)
    # neighbouring cells of one label share a block, as far as they fit; a larger cell has blocks of its own
    weight = weight.withColumn("load", load).withColumn("cuts", F.ceil("load"))
    weight = weight.withColumn("pack", F.floor(F.coalesce(F.sum(F.when(F.col("cuts") < 2, F.col("load"))).over(before), F.lit(0.0))))
    weight, weight_size = sized(weight.select(*cell, "cuts", "pack"), 80)
    blocks = attach(cells, weight, weight_size, cell, "inner").withColumn("cut", F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("cuts")))
    alone = F.when(F.col("cuts") > 1, F.xxhash64("home", "ring", "cut")).otherwise(F.lit(0).cast("bigint"))
    blocks = blocks.withColumn("block", F.xxhash64("region", "of", F.when(F.col("cuts") > 1, F.lit(-1)).otherwise(F.col("pack")), alone))
    blocks = written(blocks.select("region", "block", "of", "label", "set_key", "n", "shingles", "far"))

    ends = blocks.groupBy("region", "block", "of").agg(
        F.count(F.lit(1)).alias("sets"),
        F.array(*[F.min(F.try_element_at("far", F.lit(k + 1))) for k in range(PIVOTS)]).alias("low"),
        F.array(*[F.max(F.try_element_at("far", F.lit(k + 1))) for k in range(PIVOTS)]).alias("high"),
    )
    ends = written(ends)
    other = ends.select("region", *[F.col(c).alias(f"o_{c}") for c in ("block", "of", "sets", "low", "high")])
    apart = F.exists(
        F.arrays_zip("low", "high", "o_low", "o_high"),
        lambda x: (x["low"] - x["o_high"] > eps) | (x["o_low"] - x["high"] > eps),
    )
    one_label = (F.col("of") == F.col("o_of")) & (F.length("of") > 0)
    pairs = ends.join(other, "region").filter((F.col("block") <= F.col("o_block")) & ~F.coalesce(apart, F.lit(False)) & ~one_label)
    pairs = pairs.filter((F.col("block") < F.col("o_block")) | (F.col("sets") > 1))
    pairs = pairs.select("region", F.xxhash64("region", "block", "o_block").alias("task"), "block", "o_block")
    roles = F.array(
        F.struct(F.col("block").alias("block"), F.lit(0).alias("side")),
        F.struct(F.col("o_block").alias("block"), F.lit(1).alias("side")),
    )
    roles = F.when(F.col("block") == F.col("o_block"), F.slice(roles, 1, 1)).otherwise(roles)
    dealt, dealt_size = sized(pairs.select("region", "task", F.explode(roles).alias("r")).select("region", "task", "r.*"), 60)
    groups = attach(blocks, dealt, dealt_size, ["region", "block"], "inner")
    return links.union(_joined(groups, num, den))


# ---------------------------------------------------------------- the join


def common_shingles(docs: DataFrame, q: int) -> np.ndarray:
    """Sorted shingles that at least two texts of a sample have, at most COMMON_SHINGLES, the most frequent first."""

    def run(batches):
        shingles = shingler(q)
        for batch in batches:
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["s"])

    share = max(1, docs.count() // SAMPLE_TEXTS)
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counts = some.mapInArrow(run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "s").limit(COMMON_SHINGLES).select("s").toArrow().column("s").to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def coarse_regions(docs: DataFrame, q: int, num: int, den: int) -> DataFrame:
    """(node, region): components of sets that agree on a part; sets that agree with no other are left out.

    Marks go from one pass over the texts straight into one shuffle; they are stored nowhere else.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, q))
    return _regions(docs.select("text").mapInArrow(_marks(q, num, den, common), MARKED))


def _regions(marked: DataFrame) -> DataFrame:
    """(node, region): components of sets that share a mark."""
    tied = marked.repartition("a").mapInArrow(_tie_hubs, "a bigint, b bigint").distinct()
    return components(tied).withColumnRenamed("root", "region")


def _codes(region: int, blob: bytes) -> np.ndarray:
    """A set's shingles as those of its region: equal ones of two regions differ."""
    return _mix(np.frombuffer(blob, np.uint64) ^ _mix(np.array([region], np.int64).view(np.uint64)))


def parted(members: DataFrame, num: int, den: int) -> DataFrame:
    """members (region, set_key, node, n, shingles; one row per set) with regions inside of theirs, which no link leaves.

    Sets stay together that share one of their rarest shingles, those first that the fewest sets of the region have.
    Of very large regions a share of the sets is counted, and COMMON_SHINGLES counts are kept, which affects speed
    only: what has no count passes for rare. Sets that share none with another are left out, as no link is theirs.
    """

    def codes(batches):
        for batch in batches:
            found = [_codes(r, b) for r, b in zip(batch.column("region").to_pylist(), batch.column("shingles").to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["s"])

    def marks(batches):
        values, counts = often.value

        def code(region, blob):
            mine = _codes(region, blob)
            if not len(values):
                return rarest(mine, np.zeros(len(mine)), num, den)
            at, there = _found(mine, values)
            return rarest(mine, np.where(there, counts[at], 0), num, den)

        def sets():
            for batch in batches:
                for region, key, blob in zip(*[batch.column(c).to_pylist() for c in ("region", "set_key", "shingles")]):
                    yield key, lambda r=region, b=blob: code(r, b)

        return _tied(sets())

    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(1, total // COUNTED_SHINGLES)
    some = members.filter(F.pmod(F.xxhash64("set_key", F.lit(3)), F.lit(share)) == 0).select("region", "shingles")
    counted = some.mapInArrow(codes, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counted.orderBy(F.desc("n"), "s").limit(COMMON_SHINGLES).toArrow()
    values = top.column("s").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    often = members.sparkSession.sparkContext.broadcast((values[order], top.column("n").to_numpy()[order]))
    regions, regions_size = sized(_regions(members.select("region", "set_key", "shingles").mapInArrow(marks, MARKED)), 40)
    out = written(attach(members.drop("region"), regions, regions_size, ["node"], "inner").select(*members.columns))
    let_go(members.sparkSession)
    return out


def _by_size(members: DataFrame, region_sets: int, region_shingles: int) -> tuple[DataFrame, DataFrame, int]:
    """Groups for _joined of the regions that a task can join, the members of larger ones, and the sets in these."""
    weight = members.select("region", "set_key", "n").distinct().groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    large = (F.col("sets") > region_sets) | (F.col("total") > region_shingles)
    weight, weight_size = sized(weight.filter("sets > 1").select("region", "sets", large.alias("large")), 40)
    weighed = attach(members, weight, weight_size, ["region"], "inner")
    small = weighed.filter(~F.col("large")).select(
        F.col("region").alias("task"), F.lit(0).alias("side"), F.col("set_key").alias("label"), "set_key", "shingles"
    )
    held = weight.filter("large").agg(F.coalesce(F.sum("sets"), F.lit(0))).first()[0]
    return small, weighed.filter("large").select(*members.columns), held


def set_components(docs: DataFrame, q: int, percent: int, region_sets: int, region_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key of the text, n_shingles, set_key), and (set_key, root, component_id) of every set."""
    num, den = percent, 100
    regions, regions_size = sized(coarse_regions(docs, q, num, den), 40)
    let_go(docs.sparkSession)  # of the marks
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(regions))
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    placed = attach(in_batches(texts, _describe(q, sieve), DESCRIBED), regions, regions_size, ["node"])
    # shingles are kept of the sets in regions only
    rows = written(placed.withColumn("shingles", F.when(F.col("region").isNotNull(), F.col("shingles"))))
    sent = rows.filter(F.col("shingles").isNotNull()).select("region", "set_key", "node", F.col("n_shingles").alias("n"), "shingles")

    small, large, held = _by_size(sent, region_sets, region_shingles)
    links = _joined(small, num, den)
    if held:
        links = written(links)
        rest = written(large.groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("region", "node", "n", "shingles")]))
    while held:
        finer = parted(rest, num, den)
        forget(rest)
        small, large, left = _by_size(finer, region_sets, region_shingles)
        links = links.union(written(_joined(small, num, den)))
        if left > PARTED * held:
            links = links.union(_large_regions(written(large), num, den, region_sets, region_shingles * 3 // 4))
            break
        rest, held = written(large), left
        forget(finer)
    roots = components(written(links))

    firsts = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    named = firsts.join(roots, firsts.set_key == roots.node, "left").select("set_key", "first", F.coalesce("root", "set_key").alias("root"))
    named = written(named)
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "key", "n_shingles", "set_key"), named.join(lowest, "root").select("set_key", "root", "component_id")


def _told(docs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """docs with what a written table says of some texts (by __key). Where it is too large to be broadcast, only those
    documents are shuffled whose digest has a hash that is among its own, as far as these can be broadcast."""
    if size > limits.BROADCAST_BYTES:
        hashes, hashes_size = sized(texts.select(F.xxhash64("__key").alias("__hash")).distinct(), 32)
        if hashes_size <= limits.BROADCAST_BYTES:
            docs = docs.withColumn("__hash", F.xxhash64("__key"))
            here = attach(docs, hashes, hashes_size, ["__hash"], "left_semi").drop("__hash")
            away = attach(docs, hashes, hashes_size, ["__hash"], "left_anti").drop("__hash")
            return attach(here, texts, size, ["__key"]).unionByName(away, allowMissingColumns=True)
    return attach(docs, texts, size, ["__key"])


def jaccard_components(
    docs: DataFrame,
    q: int = 3,
    percent: int = 90,
    id_col: str = "doc_id",
    region_sets: int = REGION_SETS,
    region_shingles: int = REGION_SHINGLES,
) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id.

    Two documents are linked when 100 * shared shingles >= percent * shingles of either. component_id is the
    smallest id reachable by links. A text without words, or null, has no shingles and no link: it is its own
    component. Copies and rows with repeated ids are joined like any others; a null id names no component
    unless it is the only kind of id there. Shingles are compared by 64-bit hashes. Only id_col and text are read.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text"))
    rows, sets = set_components(docs, q, percent, region_sets, region_shingles)
    known, known_size = sized(sets.select("set_key", "component_id"), 50)
    out = attach(rows.select("doc_id", "n_shingles", "set_key"), known, known_size, ["set_key"])
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, q: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component, all columns kept: the one of the smallest id that is not null.

    Of rows with that id the smallest text digest decides, and of rows equal in both any one. Texts without words
    all stay.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text"))
    rows, sets = set_components(ids, q, percent, REGION_SETS, REGION_SHINGLES)
    known, known_size = sized(sets.select("set_key", "root"), 60)
    placed = attach(rows.filter("n_shingles > 0"), known, known_size, ["set_key"], "inner")
    mine = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "key")
    placed = placed.groupBy("root", "key", mine.alias("mine")).agg(F.count(F.lit(1)).alias("n"))
    best = placed.groupBy("root").agg(F.min("mine").alias("best"), F.sum("n").alias("rows")).filter("rows > 1")
    grouped = written(placed.join(best, "root").select("root", "key", "mine", "best", "n"))
    texts, size = sized(grouped.select(F.col("key").alias("__key"), F.col("root").alias("__root"), F.col("best").alias("__best")).distinct(), 120)
    joined = _told(docs.withColumn("__key", text_key(F.col("text"))), texts, size)
    own = F.struct(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.col("__key").alias("key"))
    kept = joined.filter(F.col("__best").isNull() | (own == F.col("__best")))
    # rows that repeat in id and text are told apart by nothing, so one of them is taken
    twice, twice_size = sized(grouped.filter("mine = best AND n > 1").select(F.col("root").alias("__root")).distinct(), 32)
    if twice_size:
        single = attach(kept, twice, twice_size, ["__root"], "left_anti")
        kept = single.unionByName(attach(kept, twice, twice_size, ["__root"], "left_semi").dropDuplicates(["__root"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
