"""N-gram Jaccard join by vertical partitioning.

N-grams have a global order, that of their hashes, which is cut into fragments. Overlaps are counted fragment by fragment,
each on its own, and summed:

1. Per class: the first part of a class's order (its head) is dealt out by fragment; each fragment counts the n-grams that
   other classes' heads also hold. Summed per class, too few mean that no link is possible; most classes end here.
2. Per pair: of the classes left, those that share one of their rarest n-grams are candidates, as far as lengths, places in
   the order and signatures allow a link.
3. Candidate pairs' sets are cut into fragments; partial overlaps are counted per fragment and summed per pair, which
   decides the link exactly.

Classes are equal n-gram sets. A component needs a spanning set of links, not all pairs: candidates first go to one leader
of each posting list, twice, and only classes that are still apart are then paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Tables, hash_test, partitions, stored, text_or_empty
from tessera.llm.components import connected_components
from tessera.llm.shingles import binary_column, shingle_sets, slices

#: Classes whose heads travel together, and n-grams of one fragment of the heads (8 bytes each).
BLOCK_CLASSES, FRAGMENT_GRAMS = 2000, 2 << 20
#: A head is longer than a link needs by one n-gram in so many, all of which a partner must share.
EXTRA = 10
#: Fragments in which candidate pairs are counted.
PAIR_FRAGMENTS = 4
#: Bits of the parity signature: two sets differ by at least as many n-grams as their signatures differ by bits.
SIGNATURE_BITS = 1024


def _ceil(x, num: int, den: int):
    """ceil(x * num / den) of whole numbers."""
    return (x * num + den - 1) // den


def _surplus(n, num: int, den: int):
    """How many n-grams heads of sets of n or more must have in common, if they are linked."""
    need = _ceil(n, num, den)
    return np.maximum(1, np.minimum(need, _ceil(need, 1, EXTRA)))


def head_length(n, num: int, den: int):
    """N-grams of a set's head. Of two linked sets, the first k common n-grams lie within n - ceil(n num / den) + k of either."""
    return np.minimum(n, n - _ceil(n, num, den) + np.maximum(1, _ceil(n, 1, EXTRA)))


def _described(words: int, num: int, den: int):
    """(id, n, key, head) of each document; key is the digest of its set, so equal sets share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                grams, n = shingle_sets(data, offsets, words)
                ends = np.cumsum(n)
                raw = memoryview(grams).cast("B") if len(grams) else b""
                keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * z]) for a, z in zip((ends - n).tolist(), ends.tolist())]
                size = head_length(n, num, den)
                inside = np.arange(len(grams)) - np.repeat(ends - n, n) < np.repeat(size, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), binary_column(grams[inside], size)],
                    names=["id", "n", "key", "head"],
                )

    return run


def _dealt(fragments: int, width: int):
    """Classes with their heads -> for each block of classes and fragment one row: which of its classes have n-grams there, how many, and these.

    A block is named by its first class and has fewer than 65 536; the row of fragment 0 carries the block's classes and their sizes.
    """

    def emit(c: list[np.ndarray], n: list[np.ndarray], heads: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        c, n, grams, size = (np.concatenate(x) for x in (c, n, heads, sizes))
        f = np.minimum(grams // np.uint64(width), np.uint64(fragments - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(c)), size)
        order = np.argsort(f, kind="stable")
        edges = np.searchsorted(f[order], np.arange(fragments + 1))
        rows = []
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
            if z > a or i == 0:
                who, counts = np.unique(owner[order[a:z]], return_counts=True)
                head = (c.astype(np.int64).tobytes(), n.astype(np.int64).tobytes()) if i == 0 else (None, None)
                rows.append((i, int(c[0]), who.astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes(), grams[order[a:z]].tobytes(), *head))
        return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_DEALT.names), _DEALT, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, ...] = ([], [], [], [])
        held = 0
        for batch in batches:
            heads = batch.column("head")
            for lo in range(0, len(batch), BLOCK_CLASSES):
                part = heads.slice(lo, BLOCK_CLASSES)
                offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
                own = (
                    batch.column("c").slice(lo, BLOCK_CLASSES).to_numpy(zero_copy_only=False),
                    batch.column("n").slice(lo, BLOCK_CLASSES).to_numpy(zero_copy_only=False),
                    np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64),
                    np.diff(offsets) // 8,
                )
                for x, y in zip(parts, own):
                    x.append(y)
                held += len(part)
                if held >= BLOCK_CLASSES:
                    yield emit(*parts)
                    parts, held = ([], [], [], []), 0
        if held:
            yield emit(*parts)

    return run


_DEALT = pa.schema([("f", pa.int32()), ("block", pa.int64()), *((k, pa.binary()) for k in ("who", "counts", "grams", "c", "n"))])


def _partial(pdf: pd.DataFrame) -> pd.DataFrame:
    """A fragment -> for each block: how many n-grams of which of its classes some other class also has."""
    counts = [np.frombuffer(x, np.uint32) for x in pdf["counts"]]
    grams = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["grams"]])
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twin = np.zeros(len(grams), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    ends = np.cumsum(np.concatenate(counts))
    before = np.r_[0, np.cumsum(twin)]
    sums = before[ends] - before[np.r_[0, ends]][:-1]
    cut = np.cumsum([len(x) for x in counts])[:-1]
    found = [(np.frombuffer(w, np.uint16)[x > 0].tobytes(), x[x > 0].astype(np.uint32).tobytes()) for w, x in zip(pdf["who"], np.split(sums, cut))]
    return pd.DataFrame({"block": pdf["block"], "who": [w for w, _ in found], "found": [x for _, x in found], "c": pdf["c"], "n": pdf["n"]})


def _summed(num: int, den: int):
    """A block's counts of all fragments, added up -> its classes that may have a partner."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (c,), (n,) = ([np.frombuffer(x, np.int64) for x in pdf[k] if x is not None] for k in ("c", "n"))
        who, some = (np.concatenate([np.frombuffer(x, t) for x in pdf[k]]) for k, t in (("who", np.uint16), ("found", np.uint32)))
        found = np.bincount(who, some, len(c))
        kept = found >= _surplus(n, num, den)
        return pd.DataFrame({"c": c[kept], "n": n[kept]})

    return run


def _sets(words: int):
    """(c, key, n, grams, sig) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                grams, n = shingle_sets(data, offsets, words)
                ends = np.cumsum(n)
                raw = memoryview(grams).cast("B") if len(grams) else b""
                keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * z]) for a, z in zip((ends - n).tolist(), ends.tolist())]
                starts = np.r_[0, ends].astype(np.int32)
                bit = ((grams >> np.uint64(20)) % np.uint64(SIGNATURE_BITS)).astype(np.int64)
                bits = np.bincount(np.repeat(np.arange(len(n)), n) * SIGNATURE_BITS + bit, minlength=len(n) * SIGNATURE_BITS) & 1
                sig = np.packbits(bits.astype(np.uint8)).view(np.int64)
                step = SIGNATURE_BITS // 64
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("c").slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(grams.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) + 1, step, dtype=np.int32)), pa.array(sig)),
                    ],
                    names=["c", "key", "n", "grams", "sig"],
                )

    return run


def _overlap_needed(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap of linked sets of a and b n-grams."""
    return F.ceil((a + b) * num / (num + den) - 1e-9)


def _may_link(pairs: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that lengths and signatures leave possible."""
    both = pairs.join(signed.select(F.col("c").alias("x"), F.col("n").alias("nx"), F.col("sig").alias("sx")), "x")
    both = both.join(signed.select(F.col("c").alias("y"), F.col("n").alias("ny"), F.col("sig").alias("sy")), "y")
    return both.filter(_signatures_agree(F.col("nx"), F.col("ny"), F.col("sx"), F.col("sy"), num, den)).select("x", "y")


def _signatures_agree(n1: Column, n2: Column, s1: Column, s2: Column, num: int, den: int) -> Column:
    apart = sum(F.bit_count(s1[i].bitwiseXOR(s2[i])) for i in range(SIGNATURE_BITS // 64))
    return apart <= n1 + n2 - 2 * _overlap_needed(n1, n2, num, den)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose overlap, counted per fragment and summed, reaches num / den of their union. pairs is read several times."""
    shift = 64 - (PAIR_FRAGMENTS.bit_length() - 1)

    def cut(side: str, n: str, grams: str) -> DataFrame:
        own = hash_test(sets, [F.col("c")], pairs.select(side)).select("c", "n", F.explode(F.sequence(F.lit(0), F.lit(PAIR_FRAGMENTS - 1))).alias("f"), "grams")
        return own.select(F.col("c").alias(side), F.col("n").alias(n), "f", F.expr(f"filter(grams, g -> shiftrightunsigned(g, {shift}) = f)").alias(grams))

    both = pairs.join(cut("x", "nx", "a"), "x").join(cut("y", "ny", "b"), ["y", "f"])
    parts = both.select("x", "y", "nx", "ny", F.size(F.array_intersect("a", "b")).alias("part"))
    summed = parts.groupBy("x", "y", "nx", "ny").agg(F.sum("part").alias("common"))
    return summed.filter(F.col("common") * den >= (F.col("nx") + F.col("ny") - F.col("common")) * num).select(F.col("x").alias("u"), F.col("y").alias("v"))


def _postings(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(g, c, n, rest) of each class's rarest n-grams, of which linked classes share one: rest n-grams of its order are left from g on.

    N-grams of one class only come first in that order and find nobody, so they are left out.
    """
    grams = sets.select("c", "n", F.explode("grams").alias("g"))
    frequent = grams.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    order = Window.partitionBy("c").orderBy(F.desc("df"), F.desc("g"))
    return grams.join(frequent, "g").withColumn("rest", F.row_number().over(order)).filter(F.col("rest") * den >= F.col("n") * num).select("g", "c", "n", "rest")


def _starred(posted: DataFrame, tables: Tables, num: int, den: int, largest: bool) -> DataFrame:
    """(x, y): each member of a posting list with the list's leader, its smallest set (or its largest)."""
    # of two linked sets, the smaller one has a common n-gram among so few of its rarest
    short = F.col("rest") * (num + den) >= F.col("n") * (2 * num)
    choose, wanted = (F.max, posted) if largest else (F.min, posted.filter(short))
    leader = wanted.groupBy("g").agg(choose(F.struct("n", "c", "rest", "comp")).alias("lead"))
    small, large = (F.col("n"), F.col("lead.n")) if largest else (F.col("lead.n"), F.col("n"))
    fits = (
        (F.col("comp") != F.col("lead.comp"))
        & (small <= large)
        & (large * num <= small * den)
        & (F.least("rest", "lead.rest") >= _overlap_needed(small, large, num, den))
    )
    rows = posted.filter(short) if largest else posted
    return rows.join(tables.stored(leader, "leaders"), "g").filter(fits).select(F.least("c", "lead.c").alias("x"), F.greatest("c", "lead.c").alias("y")).distinct()


def _paired(posted: DataFrame, signed: DataFrame, tables: Tables, num: int, den: int) -> DataFrame:
    """(x, y): all members of posting lists that are still apart, as far as lengths, places and signatures allow a link."""
    mixed = tables.stored(posted.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("g"), "mixed")
    rows = posted.join(mixed, "g").join(signed.select("c", "sig"), "c")
    a = rows.filter(F.col("rest") * (num + den) >= F.col("n") * (2 * num)).select("g", *(F.col(k).alias(f"a_{k}") for k in ("c", "n", "rest", "comp", "sig")))
    b = rows.select("g", *(F.col(k).alias(f"b_{k}") for k in ("c", "n", "rest", "comp", "sig")))
    later = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_c") != F.col("b_c")))
    fits = (
        (F.col("a_comp") != F.col("b_comp"))
        & later
        & (F.col("b_n") * num <= F.col("a_n") * den)
        & (F.least("a_rest", "b_rest") >= _overlap_needed(F.col("a_n"), F.col("b_n"), num, den))
        & _signatures_agree(F.col("a_n"), F.col("b_n"), F.col("a_sig"), F.col("b_sig"), num, den)
    )
    return a.join(b, (a["g"] == b["g"]) & fits).select(F.least("a_c", "b_c").alias("x"), F.greatest("a_c", "b_c").alias("y")).distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id: groups of documents linked by Jaccard similarity >= num / den of their shingle sets.

    Documents without words have no shingles and link with nothing (nor with each other). component_id is the smallest id
    that links reach. Equal sets are one class; no class is paired with another unless a shared rare n-gram, their lengths
    and their signatures allow a link, and no cap is set on partners. Null text counts as empty. Every row gives one row; rows
    without id link with nothing and have no component_id. Of rows that repeat an id with different texts, the one with the
    smallest digest links, the others take over its component_id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    described = tables.stored(rows.mapInArrow(_described(words, num, den), "id long, n long, key binary, head binary"), "described")
    keys = tables.stored(described.select("id", "n", "key"), "keys")
    ids = keys.filter("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("key", "n")).alias("s"), F.count("*").alias("rows"))
    ids = tables.stored(ids.select("id", "s.key", "s.n", "rows"), "ids")
    classes = tables.stored(ids.groupBy("key").agg(F.min("id").alias("c"), F.first("n").alias("n")), "classes")
    facts = classes.agg(F.sum("n").alias("grams")).crossJoin(ids.agg(F.max("rows").alias("rows"))).first()
    repeated = (facts["rows"] or 0) > 1
    # 1. what every class's head shares with others, fragment by fragment
    share = (den - num) / den + 1 / EXTRA
    fragments = max(4, partitions(spark), int((facts["grams"] or 0) * share) // FRAGMENT_GRAMS + 1)
    width = int(min(1.0, share * fragments / (fragments - 1)) * (1 << 64)) // fragments
    heads = described.filter("n > 0 and id is not null").select(F.col("id").alias("c"), "n", "key", "head")
    first = classes.select("c", "key")
    if repeated:
        heads = heads.join(first, ["c", "key"], "left_semi").dropDuplicates(["c"])
    else:
        copies = tables.stored(ids.select(F.col("id").alias("c"), "key").join(first, ["c", "key"], "left_anti").select("c"), "copies")
        heads = hash_test(heads, [F.col("c")], copies, "left_anti").unionByName(hash_test(heads, [F.col("c")], copies).join(copies, "c", "left_anti"))
    heads = heads.select("c", "n", "head").sortWithinPartitions("c")  # a retried task must deal the same blocks
    dealt = heads.mapInArrow(_dealt(fragments, width), "f int, block long, who binary, counts binary, grams binary, c binary, n binary")
    partial = dealt.groupBy("f").applyInPandas(_partial, "block long, who binary, found binary, c binary, n binary")
    left = tables.stored(partial.groupBy("block").applyInPandas(_summed(num, den), "c long, n long").distinct(), "left")
    tables.remove("described")
    # 2. the sets of the classes left
    kept = left.select("c").join(classes.select("c", "key"), "c")
    texts = hash_test(rows, [F.col("id")], left.select("c")).join(kept, F.col("id") == F.col("c")).select("c", "text", F.col("key").alias("own"))
    sets = texts.select("c", "text").mapInArrow(_sets(words), "c long, key binary, n long, grams array<long>, sig array<long>")
    if repeated:
        sets = sets.join(kept, ["c", "key"], "left_semi").dropDuplicates(["c"])
    sets = tables.stored(sets.select("c", "n", "grams", "sig"), "sets")
    signed = sets.select("c", "n", "sig")
    posted = tables.stored(_postings(sets, num, den), "postings")
    # 3. each posting list's members with one leader, then those still apart with the next one, then with each other
    links = None
    for step in range(3):
        last = step == 2
        if links is None:
            known = posted.withColumn("comp", F.col("c"))
        else:
            names = connected_components(links, None if last else 1).withColumnRenamed("node", "c")
            known = posted.join(names, "c", "left").select("g", "c", "n", "rest", F.coalesce("component", "c").alias("comp"))
        pairs = _paired(known, signed, tables, num, den) if last else _may_link(_starred(known, tables, num, den, largest=step == 1), signed, num, den)
        found = tables.stored(_verified(tables.stored(pairs, "candidates"), sets, num, den), "pairs")
        links = found if links is None else links.unionByName(found)
    # names hold the links of the first two steps, all settled; what the last step found joins some of them
    component = names if found.isEmpty() else connected_components(names.select(F.col("c").alias("u"), F.col("component").alias("v")).unionByName(found))
    component = component.toDF("node", "component")
    # one row per document
    named = ids.select("id", "key").join(classes.select("key", "c"), "key").join(component, F.col("c") == F.col("node"), "left")
    named = named.select(F.col("id").alias("_id"), F.coalesce("component", "c").alias("component"))
    wordy = keys.filter("n > 0 and id is not null").select("id", "n").join(named, F.col("id") == F.col("_id"))
    rest = keys.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    out = wordy.select("id", "n", "component").unionByName(rest)
    # the result is small; written, it leaves nothing that still reads the sets and postings
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "groups")
    tables.remove()
    return out
