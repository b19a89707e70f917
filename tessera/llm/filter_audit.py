"""Which of five text filters removes what, in every order they can be applied in.

A filter sees whole texts: A too few words, B too few different words, C too many capitals, D signs of markup, E a copy of a text
with a smaller id. A to D follow from a row's own text. E comes from radix tries: texts are dealt out by ranges of adaptive
prefixes, every range inserts its texts into a compressed trie that holds the smallest id at each terminal, and a traversal flags
all rows with larger ids. What is left of a document is a mask of failures; all counts of all orders are sums over masks.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: A trie takes about this many bytes of text, in a block of rows as in a range of texts.
TRIE_BYTES = 8 << 20
#: Bounds of the sample of prefixes on the driver; rows and code points of each.
SAMPLE_ROWS, PREFIX = 65536, 256
SAMPLES_PER_RANGE = 8
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))
ROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int8()), ("n", pa.int64()), ("range_id", pa.int64()), ("text", pa.binary())])
ROW_TYPE = "doc_id long, part string, mask byte, n long, range_id long, text binary"

LABEL, KIDS, VALUE = range(3)


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many leading bytes a has in common with b from `at` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Compressed trie over byte strings; a node is [label of the edge to it, children by first byte, value of its terminal]."""

    def __init__(self):
        self.root = [b"", {}, None]
        self.bytes = 0

    def node(self, text: bytes) -> list:
        """The node of a text, made where it is missing; its value is None where no text ended so far."""
        node, at, size = self.root, 0, len(text)
        self.bytes += size
        while at < size:
            child = node[KIDS].get(text[at])
            if child is None:
                node[KIDS][text[at]] = child = [text[at:], {}, None]
                return child
            label = child[LABEL]
            if not text.startswith(label, at):
                k = shared(label, text, at)
                node[KIDS][text[at]] = upper = [label[:k], {label[k]: child}, None]
                child[LABEL] = label[k:]
                child, label = upper, upper[LABEL]
            node, at = child, at + len(label)
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """(text, value) of every terminal, in no order."""
        todo = [(b"", self.root)]
        while todo:
            above, node = todo.pop()
            text = above + node[LABEL]
            if node[VALUE] is not None:
                yield text, node[VALUE]
            todo += [(text, child) for child in node[KIDS].values()]


def own_failures(text: bytes) -> int:
    """Mask of A to D of a UTF-8 text."""
    words = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    n, points = len(words), len(text.translate(None, CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (SIGNS.search(text) is not None) << 3


@dataclass(frozen=True)
class Splitters:
    """cuts: the prefixes at which ranges begin; parts: into how many a range is cut by a hash of the whole text."""

    cuts: tuple[bytes, ...]
    parts: tuple[int, ...]

    def range_id(self, text: bytes) -> int:
        i = bisect.bisect_right(self.cuts, text)
        return (i << 32) + zlib.crc32(text) % self.parts[i]


def splitters(sample: list[tuple[bytes, int]], total: int, target: int) -> Splitters:
    """Ranges of about `target` of `total` bytes, from sampled (prefix, bytes of its text).

    Ranges begin at the shortest prefix that tells two neighbours of the sample apart, so that prefixes are as long as texts
    require. Where the sample can't be cut further (many texts with the same beginning), a hash of the whole text does it.
    """
    sample = sorted(sample)
    scale = total / max(1, sum(w for _, w in sample))
    cuts, weights, before = [], [0.0], None
    for text, weight in sample:
        if weights[-1] >= target and text != before:
            cuts.append(text[: shared(before, text) + 1])
            weights.append(0.0)
        weights[-1] += weight * scale
        before = text
    return Splitters(tuple(cuts), tuple(max(1, round(w / target)) for w in weights))


def _sampled(rows: DataFrame) -> Splitters:
    n = rows.count()
    at_most = max(1024, min(SAMPLE_ROWS, n // 64))
    drawn = rows.filter(F.rand(29) < at_most / max(1, n)).limit(2 * at_most).select(F.encode(F.substring("text", 1, PREFIX), "utf-8"), F.octet_length("text") + 64)
    sample = [(bytes(p), w) for p, w in drawn.toLocalIterator()]
    total = sum(w for _, w in sample) * n / max(1, len(sample))
    return splitters(sample, round(total), max(TRIE_BYTES // 2, round(total * SAMPLES_PER_RANGE / max(1, len(sample)))) if total > TRIE_BYTES else TRIE_BYTES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW)], schema=ROW)


def _settled(trie: RadixTrie, cuts: Splitters | None) -> Iterator[pa.RecordBatch]:
    """Rows of a trie, whose values are [smallest id, rows (id, part, mask, n)].

    Rows above the smallest id are copies and need their text no longer. The others go on with it (with `cuts`), one for each part;
    without, they are the first of their text.
    """
    out, size = [], 0
    for text, (least, rows) in trie.terminals():
        first: dict[tuple, int] = {}
        for i, part, mask, n in rows:
            if i > least:
                out.append((i, part, mask | COPY, n, -1 - len(out) % 4096, None))
            else:
                first[part, mask] = first.get((part, mask), 0) + n
        for (part, mask), n in first.items():
            out.append((least, part, mask, n, cuts.range_id(text), text) if cuts else (least, part, mask, n, 0, None))
            size += len(text) if cuts else 0
        if size > TRIE_BYTES or len(out) > 50_000:
            yield _batch(out)
            out, size = [], 0
    yield _batch(out)


def failure_masks(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i), n (so many rows alike) for all rows of docs.

    Null texts and parts are empty. A row fails E if a row with a smaller id has its very text; rows without id neither are copies
    nor make any; rows that repeat id and text are no copies of each other. Columns other than these three are ignored; an empty
    table gives an empty result. Each task first inserts blocks of rows into tries of their own, so that of a text that many rows
    hold, one row a block is dealt out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = _sampled(rows)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for batch in batches:
            out = []
            for i, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = text.as_py()
                mask = own_failures(text)
                if i is None:
                    out.append((None, part, mask, 1, -1 - len(out) % 4096, None))
                    continue
                node = trie.node(text)
                if node[VALUE] is None:
                    node[VALUE] = [i, []]
                node[VALUE][0] = min(i, node[VALUE][0])
                node[VALUE][1].append((i, part, mask, 1))
                if trie.bytes > TRIE_BYTES:
                    yield from _settled(trie, cuts)
                    trie = RadixTrie()
            yield _batch(out)
        yield from _settled(trie, cuts)

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = RadixTrie(), None
        for batch in batches:
            out = []
            for i, part, mask, n, where, text in zip(*(batch.column(c).to_pylist() for c in ROW.names)):
                if text is None:
                    out.append((i, part, mask, n, 0, None))
                    continue
                if where != at:
                    yield from _settled(trie, None)
                    trie, at = RadixTrie(), where
                node = trie.node(text)
                if node[VALUE] is None:
                    node[VALUE] = [i, []]
                node[VALUE][0] = min(i, node[VALUE][0])
                node[VALUE][1].append((i, part, mask, n))
            yield _batch(out)
        yield from _settled(trie, None)

    tasks = max(partitions(docs.sparkSession), min(4 * partitions(docs.sparkSession), sum(cuts.parts)))
    dealt = rows.mapInArrow(by_block, ROW_TYPE).repartition(tasks, "range_id").sortWithinPartitions("range_id")
    return dealt.mapInArrow(by_range, ROW_TYPE).select("doc_id", "part", "mask", "n")


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, its filter's bit, bits of the filters before it) of all orders."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part of docs.

    Labels of an id that is labelled twice count if one of them does; labels without document and null ids are ignored.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.withColumn("spread", F.lit(0))
    masks = failure_masks(docs, part_col).withColumn("spread", F.when(F.col("doc_id").isNull(), (F.rand(7) * 1024).cast("int")).otherwise(0))
    judged = masks.join(known, (masks["doc_id"] == known["lid"]) & (masks["spread"] == known["spread"]), "left")
    n = F.col("n")
    counted = judged.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))
    # one row a part: its masks' counts
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    # one literal for all steps: thousands of them are slow to plan
    steps = F.split(F.lit(" ".join(f"{o},{s},{b},{p}" for o, s, b, p in _orders())), " ")
    at = F.split("at", ",")
    each = parts.select("part", "counts", F.explode(steps).alias("at")).select("part", "counts", at[0].alias("filter_order"), *(at[i].cast("int").alias(c) for i, c in ((1, "step"), (2, "bit"), (3, "before"))))

    def total(of: str, test) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(c["mask"].cast("int")), c[of]).otherwise(F.lit(0)))

    bit, before = F.col("bit"), F.col("before")
    gone = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    out = each.select(
        "part", "filter_order", "step", "bit", total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("n", gone).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
