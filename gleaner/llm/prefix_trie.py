"""The trie of all prefixes of conversations: what shared beginnings save, and totals of every subtree.

A turn is known by a digest of role and text, a prefix by running sums of position-bound hashes of its turns (128 bits
together). So a node's key and its parent's follow from a row alone, texts are read once and never shuffled, and a very
long conversation is summed in slices. Totals over subtrees come from parallel tree contraction.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.contraction import subtree_totals
from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import running_totals
from gleaner.plans.tables import written

FRAGMENT_BITS = 8  # ids that agree but for so many bits are joined to one piece of text before hashing
PARTS = 4  # of 32 bits, that make the key of a prefix


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, mark, n_bytes) of conversations (conv_id, turn, role, text), written.

    Places follow turn, null first; turns that tie are ordered by role, then MD5 of the text. A null role or text is empty. mark
    is a digest of both, n_bytes the UTF-8 bytes of the text. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.md5(text).alias("rank_text"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("mark"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("rank_text").asc()]
    placed = running_totals(rows, ["conv_id"], order, {"place": F.lit(1).cast("bigint")})
    return written(placed.select("conv_id", "place", "mark", "n_bytes"))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as their family's first one does: (turns, conversations with n_turns).

    Conversation c gets the first h turns of conversation c - c % family (all if fewer, none if there is none) and
    then its own turns after its first h, with h the unsigned crc32 of the decimal c, modulo most.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", base.alias("base"), taken.alias("h"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.withColumn("n_turns", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = lookup(turns, convs.select("conv_id", "h", "head"), ["conv_id"], stored=False).filter(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("head") + F.col("place") - F.col("h")).alias("place"), "mark", "n_bytes")
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    head = convs.select("base", "conv_id", "h").join(first, "base").filter(F.col("place") <= F.col("h"))
    return own.unionByName(head.select("conv_id", "place", "mark", "n_bytes")), convs.select("conv_id", "n_turns")


def _hash_parts() -> list[Column]:
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    return [
        part
        for seed in range(PARTS // 2)
        for x in [F.xxhash64(F.lit(seed), F.col("place"), F.col("mark"))]
        for part in (low(x), low(F.shiftright(x, 32)))
    ]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_bytes): the node that each conversation passes at each depth from 1."""
    parts = {f"s{k}": p for k, p in enumerate(_hash_parts())}
    summed = running_totals(turns, ["conv_id"], [F.col("place").asc()], parts)
    sums, before = [F.col(s) for s in parts], [F.col(s) - p for s, p in parts.items()]
    return summed.select(
        "conv_id", F.col("place").alias("depth"), _key(F.col("place"), sums).alias("node"),
        _key(F.col("place") - 1, before).alias("parent"), "n_bytes",
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id): SHA-256 of a node's ids, ascending, joined by commas.

    SHA-256 can only be fed in order. Neighbouring ids are joined to pieces first, in parallel; a task then streams a
    node's pieces through the hash and holds none of them, so a node may hold any number of conversations.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("node", F.shiftright("conv_id", FRAGMENT_BITS).alias("piece")).agg(joined.alias("ids"))

    def stream(batches):
        node, state = None, None
        for batch in batches:
            nodes, out = batch.column("node").to_pylist(), ([], [])
            for key, ids in zip(nodes, batch.column("ids").to_pylist()):
                if key != node:
                    if node is not None:
                        out[0].append(node)
                        out[1].append(state.hexdigest())
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(stream, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of turns (conv_id, place, mark, n_bytes) of convs (conv_id, n_turns).

    Columns: node and parent (16 bytes; the root's parent is null), conv_id (smallest member), depth (0: the textless
    root, of which all conversations are members), parent_conv_id, n_convs, n_children, n_leaves (childless nodes in
    the subtree, itself included), saved_tokens (over the subtree, members beyond the first times bytes of the node's
    last text) and ends_sha256 (see ends_digest; the empty string's where no conversation ends).

    Places of a conversation are 1, 2, ... Conversations that are equal end in one node. Empty tables give no rows; a
    conversation without turns is a member of the root only. Other columns are not looked at.
    """
    root = _key(F.lit(0), [F.lit(0)] * PARTS)
    none = F.lit(None).cast("binary")
    tops = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), root.alias("node"), none.alias("parent"), F.lit(0).cast("bigint").alias("n_bytes"))
    passed = written(prefixes(turns).unionByName(tops))
    nodes = written(
        passed.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
            F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        )
    )
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = lookup(passed.select("conv_id", "depth", "node"), convs, ["conv_id"]).filter(F.col("depth") == F.col("n_turns"))
    tree = nodes.join(children, "node", "left").select(
        "node", "parent", F.col("n_children").isNull().cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    made = nodes.join(children, "node", "left").join(totals, "node").join(ends_digest(ends.select("node", "conv_id")), "node", "left")
    made = made.join(above, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return made.select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def shared_beginnings(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), rebuilt by families; without the nodes' keys.

    Null turns come first, a null role or text is empty, rows without a conv_id are left out; ties and repeated rows
    are turns of their own, ordered by role and MD5 of the text. Very long conversations are ordered and summed in slices, very
    long texts are read once. An empty table gives no rows. Other columns are not looked at.
    """
    turns, convs = rebuilt(ordered_turns(conversations))
    return prefix_trie(turns, convs).drop("node", "parent")
