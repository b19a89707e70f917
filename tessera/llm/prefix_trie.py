"""Prefix trie of conversations: nodes are shared beginnings, with counts and totals over their subtrees.

A node is known by the sum of hashes of (place, turn) over its turns, a running sum that is cut into bands of turns and so never
needs a conversation in one task. Totals over subtrees go by depth bands: a node is exploded to its ancestors within its band
only, the totals of band roots form a tree that is HEIGHT times lower and is solved in the same way, and then flow into the
band above. A tree of depth D takes log(D) / log(HEIGHT) levels, and no node is exploded to more than HEIGHT ancestors in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions, stored

#: Turns of a band.
HEIGHT = 16
LOW = 0xFFFFFFFF
#: First turns that a rebuilt conversation takes from another one: fewer than this.
BORROWED = 6
KEY = ["k1", "k2"]


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, p, n, digest, points) of all turns, n from 1 in the order of turns, and (conv_id, p, before, total).

    Turns are ordered by turn, null first, then by SHA-256 of role and text. They are range-partitioned in that order; a turn's number
    is its number within the range and the conversation, plus what the ranges before hold of the conversation (`before`).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.length(text).cast("long").alias("points")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = stored(turns.repartitionByRange(partitions(conversations.sparkSession), F.col("conv_id"), *order).withColumn("p", F.spark_partition_id()), "turns")
    held = ranged.groupBy("conv_id", "p").agg(F.count("*").alias("held"))
    whole = Window.partitionBy("conv_id")
    before = held.select("conv_id", "p", (F.sum("held").over(whole.orderBy("p")) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("total"))
    own = ranged.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "p").orderBy(*order)))
    own = own.join(before.select("conv_id", "p", "before"), ["conv_id", "p"])
    return own.select("conv_id", "p", (F.col("n") + F.col("before")).alias("n"), "digest", "points"), before


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, points, last) of all turns of the rebuilt conversations, and a row of depth 0 for each.

    Conversation c takes the first h turns of conversation c - c % 100, then its own after the first h, h = crc32(c) % 6. Rows
    without conv_id are left out.
    """
    turns, before = numbered(conversations)
    turns = stored(turns, "numbered")
    sizes = before.select("conv_id", F.col("total").alias("own")).distinct()
    convs = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % BORROWED).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("there", F.lit(0).cast("long")))).withColumn("turns", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "h", "k", "turns"), "convs")
    # by (conversation, range), so that a conversation of many turns isn't joined in one task
    per_range = before.select("conv_id", "p").join(convs, "conv_id")
    own = turns.join(per_range, ["conv_id", "p"]).filter("n > h").select("conv_id", (F.col("k") + F.col("n") - F.col("h")).alias("depth"), "digest", "points", "turns")
    lent = turns.filter(F.col("n") < BORROWED).select(F.col("conv_id").alias("base"), F.col("n").alias("depth"), "digest", "points")
    lent = convs.join(lent, "base").filter("depth <= k").select("conv_id", "depth", "digest", "points", "turns")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("points"), "turns")
    return own.unionByName(lent).unionByName(root).select("conv_id", "depth", "digest", "points", (F.col("depth") == F.col("turns")).alias("last"))


def _half(high: Column, low: Column) -> Column:
    """64 of a node's 128 bits, of two sums of 32-bit halves."""
    return F.shiftleft(high.bitwiseAND(LOW), 32).bitwiseOR(low.bitwiseAND(LOW))


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, points, last): the node each turn leads to and the node it comes from (null at the root)."""
    parts = []
    for seed in (1, 2):
        h = F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(F.lit(0).cast("long"))
        parts += [F.shiftrightunsigned(h, 32).alias(f"high{seed}"), h.bitwiseAND(LOW).alias(f"low{seed}")]
    names = ["high1", "low1", "high2", "low2"]
    hashed = rows.select("conv_id", "depth", F.floor(F.col("depth") / HEIGHT).alias("band"), "points", "last", *parts)
    inside = Window.partitionBy("conv_id", "band").orderBy("depth")
    across = Window.partitionBy("conv_id").orderBy("band")
    carried = hashed.groupBy("conv_id", "band").agg(*(F.sum(c).alias(c) for c in names)).select("conv_id", "band", *((F.sum(c).over(across) - F.col(c)).alias(f"{c}_before") for c in names))
    summed = hashed.select("*", *(F.sum(c).over(inside).alias(f"{c}_sum") for c in names)).join(carried, ["conv_id", "band"])
    here = {c: F.col(f"{c}_sum") + F.col(f"{c}_before") for c in names}
    above = {c: here[c] - F.col(c) for c in names}
    inner = F.col("depth") > 0
    return summed.select(
        "conv_id", "depth", "points", "last", *(_half(here[f"high{s}"], here[f"low{s}"]).alias(f"k{s}") for s in (1, 2)),
        *(F.when(inner, _half(above[f"high{s}"], above[f"low{s}"])).alias(f"p{s}") for s in (1, 2)),
    )


def subtree_totals(nodes: DataFrame, ways: DataFrame, values: list[str], deepest: int, height: int = HEIGHT, stride: int = 1) -> DataFrame:
    """(k1, k2, *values): `values` of nodes (k1, k2, conv_id of a member, depth, *values), summed over subtrees.

    ways (conv_id, depth, k1, k2) has the nodes on the way of each member. Only depths that `stride` divides exist.
    """
    band = F.floor(F.col("depth") / (stride * height))
    own = nodes.withColumn("band", band)
    on_way = ways.select("conv_id", F.col("depth").alias("at"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.floor(F.col("depth") / (stride * height)).alias("band"))
    sums = [F.sum(v).alias(v) for v in values]
    if deepest >= stride * height:
        # band roots, with what their bands hold: a tree of its own
        tops = on_way.filter(F.col("at") % (stride * height) == 0)
        held = own.join(tops, ["conv_id", "band"]).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*sums)
        roots = nodes.filter(F.col("depth") % (stride * height) == 0).select(*KEY, "conv_id", "depth")
        whole = subtree_totals(stored(roots.join(held, KEY), "band_roots"), ways.filter(F.col("depth") % (stride * height) == 0), values, deepest, height, stride * height)
        # their totals enter the band above at the node before them
        entered = roots.filter("depth > 0").join(whole, KEY).withColumn("at", F.col("depth") - stride).drop(*KEY)
        entered = entered.join(ways.select("conv_id", F.col("depth").alias("at"), *KEY), ["conv_id", "at"]).groupBy(*KEY).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        own = own.join(entered, KEY, "left").select(*KEY, "conv_id", "depth", "band", *((F.col(v) + F.coalesce(F.col(f"{v}_below"), F.lit(0))).alias(v) for v in values))
    reached = own.drop(*KEY).join(on_way, ["conv_id", "band"]).filter(F.col("at") <= F.col("depth"))
    return stored(reached.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*sums), "totals")


def _ends(ways: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of nodes at which conversations end. Ids stream in order through a hash, so none are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k1, k2) != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield _hashes(out)
        if at:
            yield _hashes([(*at, digest.hexdigest())])

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

    dealt = ways.filter("last").select(*KEY, "conv_id").repartition(partitions(ways.sparkSession), *KEY).sortWithinPartitions(*KEY, "conv_id")
    return dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie_nodes(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Null roles and texts are empty; rows without conv_id are left out; columns other than conv_id, turn, role and text are ignored;
    without conversations there are no nodes. Rows that repeat a turn are turns of their own. The ids that end at a node are hashed
    in order by one task, as the digest asks for it; they stream, and are one row for each conversation.
    """
    ways = stored(paths(rebuilt(conversations)), "ways")
    nodes = ways.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    nodes = stored(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "with_children")
    deepest, first = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)), F.min("conv_id")).first()
    valued = nodes.select(*KEY, "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"))
    totals = subtree_totals(valued, ways.select("conv_id", "depth", *KEY), ["n_leaves", "saved_tokens"], deepest, height)
    # the root is the parent of all first turns, and its smallest member is known
    parents = nodes.filter("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    own = nodes.withColumn("p1", F.when(F.col("depth") > 1, F.col("p1")).otherwise(F.col("k1"))).withColumn("inner", F.col("depth") > 1)
    own = own.join(parents.withColumn("inner", F.lit(True)), ["p1", "p2", "inner"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(first).cast("long")).otherwise(F.col("above"))
    return own.join(totals, KEY).join(_ends(ways), KEY, "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
