"""Prefix trie of conversations by collapsing whole sequences.

Turns are numbered, each conversation is rebuilt (its first turns replaced by those of a donor), and identical rebuilt conversations
become one weighted sequence; the list of conversations that end at a sequence is kept as rows.  A sequence that is a proper prefix of
another is found by an anti-join and is no leaf.  Only the prefixes of the distinct sequences are then spelled out, once each, and added up
with the weights.

A prefix is known by its depth and 128 bits: the exclusive or, over its turns, of two hashes of (role, text, position).  What a prefix has before
it and after it comes from running sums along its sequence, so sums over subtrees need no walk along the tree: with w copies of a
sequence, the turns from depth d on count w times, less once for every node, and a node is counted by the sequence with the smallest
conversation through it, which owns all nodes from some depth on.

Hot groups: turns are dealt by ranges of (conversation, turn), so a conversation with a third of all turns lies in many pieces whose running
values are shifted by those before; nothing is gathered by prefix but sums; lists of ends are hashed as a stream of joined stretches.

Cases: rows without a conversation take no part; turns come in order of their number (null first), equal numbers in order of role and
text; null role and text count as empty; repeated rows are turns of their own; other columns are ignored; an empty table has no node.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.llm.rows import quoted
from graftline.plans.lineage import cut

KEY = ["depth", "a", "b"]
STRETCH = 1 << 16
_IN_PARTITION = (1 << 33) - 1


class Trie(NamedTuple):
    """nodes: depth, a, b, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; ends: conv_id, depth, a, b of the node
    at which each conversation ends; turns: conv_id, depth, a, b, chars of every rebuilt turn."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, part, pos, c1, c2, chars) of every turn; part is the range of rows it lies in, pos its place in the conversation from 1."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranged.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("inside"),
                             F.xxhash64(F.lit(1), "role", "text").alias("c1"), F.xxhash64(F.lit(2), "text", "role").alias("c2"), F.length("text").cast("long").alias("chars")))
    pieces = rows.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("inside").alias("lo"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("conv", "part", (before - F.col("lo") + 1).alias("shift"))
    return rows.join(pieces, ["conv", "part"]).select("conv", "part", (F.col("inside") + F.col("shift")).alias("pos"), "c1", "c2", "chars")


def rebuilt(turns: DataFrame, donor: Callable[[Column], Column], taken: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, their rebuilt turns).

    Conversation c starts with the first taken(c) (at most `most`) turns of conversation donor(c), or all it has, and goes on with its
    own turns after its first taken(c)."""
    own = cut(_numbered(turns))
    size = own.groupBy("conv").agg(F.count("*").alias("n"))
    convs = size.select("conv", donor(F.col("conv")).alias("donor"), taken(F.col("conv")).alias("h"))
    kept = size.select(F.col("conv").alias("donor"), "n")
    convs = cut(convs.join(kept, "donor", "left").select("conv", "donor", "h", F.least(F.coalesce("n", F.lit(0)), "h").alias("k")))
    heads = own.where(F.col("pos") <= most).select(F.col("conv").alias("donor"), "pos", "c1", "c2", "chars").join(convs.where("k > 0"), "donor").where(F.col("pos") <= F.col("h"))
    # pieces are few; joined to them first, a long conversation's turns meet its numbers piece by piece
    pieces = own.select("conv", "part").distinct().join(convs, "conv")
    rest = own.join(pieces, ["conv", "part"]).where(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    shown = ["conv", "part", "pos", "c1", "c2", "chars"]
    return convs.select("conv"), heads.withColumn("part", F.lit(-1)).select(*shown).unionByName(rest.select(*shown))


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, chars, before): each turn as the end of a prefix, the prefix one turn shorter, and the code points before."""
    lanes = rows.select("conv", "part", F.col("pos").alias("depth"), "chars", F.xxhash64("c1", "pos").alias("xa"), F.xxhash64("c2", "pos").alias("xb"))
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lanes = cut(lanes.withColumns({"ra": F.bit_xor("xa").over(so_far), "rb": F.bit_xor("xb").over(so_far), "rc": F.sum("chars").over(so_far)}))
    pieces = lanes.groupBy("conv", "part").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("chars").alias("c"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv", "part", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(n) for f, c, n in ((F.bit_xor, "xa", "oa"), (F.bit_xor, "xb", "ob"), (F.sum, "c", "oc"))])
    a, b = F.col("ra").bitwiseXOR(F.col("oa")), F.col("rb").bitwiseXOR(F.col("ob"))
    return lanes.join(pieces, ["conv", "part"]).select("conv", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("xa")).alias("pa"), b.bitwiseXOR(F.col("xb")).alias("pb"), "chars", (F.col("rc") + F.col("oc") - F.col("chars")).alias("before"))


def prefix_trie(turns: DataFrame, donor: Callable[[Column], Column] = lambda c: c, taken: Callable[[Column], Column] = lambda c: F.lit(0), most: int = 0, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Trie:
    """The trie of all rebuilt conversations; by default each is its own."""
    empty = F.lit("")
    turns = turns.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col), empty).alias("role"), F.coalesce(quoted(text_col), empty).alias("text")).where("conv IS NOT NULL")
    convs, rows = rebuilt(turns, donor, taken, most)
    prefixes = cut(_prefixes(rows))
    last = prefixes.groupBy("conv").agg(F.max(F.struct("depth", "a", "b", (F.col("before") + F.col("chars")).alias("total"))).alias("l")).select("conv", "l.*")
    zero = F.lit(0).cast("long")
    ends = cut(convs.join(last, "conv", "left").select(F.col("conv").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in [*KEY, "total"]]))

    # whole sequences, and which of them no longer one begins with
    sequences = cut(ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv"), F.first("total").alias("total")))
    root = sequences.select("conv", *[zero.alias(c) for c in ("depth", "a", "b", "pa", "pb", "chars", "before")])
    size = sequences.select("conv", "weight", "total", F.col("depth").alias("whole"))
    spelled = cut(root.unionByName(prefixes.join(sequences.select("conv"), "conv", "left_semi")).join(size, "conv"))
    leaves = sequences.join(spelled.where("depth < whole").select(*KEY).distinct(), KEY, "left_anti").select("conv", F.lit(1).alias("leaf"))

    # weighted prefixes
    counted = spelled.join(leaves, "conv", "left").groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id"), F.count("leaf").alias("n_leaves"), *[F.first(c).alias(c) for c in ("pa", "pb", "before")])
    counted = cut(counted)
    owned = counted.groupBy(F.col("conv_id").alias("conv")).agg(F.min("before").alias("from"))  # code points before the first node a sequence owns
    rest = F.col("weight") * (F.col("total") - F.col("before")) - F.when(F.col("from").isNotNull(), F.col("total") - F.greatest("before", "from")).otherwise(0)
    saved = spelled.join(owned, "conv", "left").groupBy(*KEY).agg(F.sum(rest).alias("saved_tokens"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    below = counted.where("depth > 0")
    children = below.select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    parents = counted.select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    parent = below.select(*KEY, (F.col("depth") - 1).alias("pd"), "pa", "pb").join(parents, ["pd", "pa", "pb"]).select(*KEY, "parent_conv_id")
    nodes = (counted.select(*KEY, "conv_id", "n_convs", "n_leaves").join(saved, KEY).join(children, KEY, "left").join(parent, KEY, "left")
             .select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens"))
    return Trie(nodes, ends.drop("total"), prefixes.select(F.col("conv").alias("conv_id"), *KEY, "chars"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined to stretches of STRETCH letters where ranges of (node, id) lie; a node's stretches are hashed one after the other as
    they stream by, so no list is held."""
    names = [*KEY, "at", "ids"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in node], pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names)

        for batch in batches:
            for depth, a, b, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != (depth, a, b) or size > STRETCH:
                    if ids:
                        yield send()
                    node, ids, size = (depth, a, b), [], 0
                ids.append(i)
                size += len(str(i)) + 1
        if ids:
            yield send()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def send(nodes: list, digests: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([n[k] for n in nodes], pa.int64()) for k in range(3)], pa.array(digests, pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            nodes, digests = [], []
            for depth, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if node == (depth, a, b):
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = (depth, a, b), hashlib.sha256(ids.encode())
            yield send(nodes, digests)
        if node is not None:
            yield send([node], [state.hexdigest()])

    ranged = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = ranged.mapInArrow(join, "depth long, a long, b long, at long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")
