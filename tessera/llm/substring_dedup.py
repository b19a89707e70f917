"""Removal of byte strings that an earlier document also has, by suffix sorting.

Sorting all suffixes of a corpus is out of proportion to what repeats, so suffixes are first narrowed down, exactly:

1. Winnowing anchors: every string of `length` bytes belongs to the smallest gram in it, its anchor, and equal strings belong
   to anchors of equal hash. The hashes are counted in fragments of the hash order; only anchors that two different texts
   share go on.
2. Each such anchor sends its context - the bytes of the strings that belong to it - to the bucket of its hash. Of the equal
   contexts of a block of texts only the one of the smallest document goes there; the others are repeats as they stand.
3. An anchor's contexts are narrowed to what can agree with another of them; a bucket sorts the suffixes of what is left
   (lyndon.suffix_array). Neighbours in that order with `length` equal bytes form a group; the group's smallest document
   tells which of its strings are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, partitions, stored, text_or_empty
from tessera.llm.lyndon import suffix_array
from tessera.llm.shingles import mixed, slices, text_bytes

GRAM = 16
#: Bytes of text whose anchors are worked out together; longer texts come in pieces.
SLICE_BYTES = 1 << 18
#: Bytes of text that travel together, and contexts' bytes sorted together (an anchor's contexts are never parted).
BLOCK_BYTES = 8 << 20
SORT_BYTES = 128 << 10
#: Bytes of distinct texts for each fragment of the anchors' count and for each bucket of contexts.
COUNTED_BYTES, SORTED_BYTES = 64 << 20, 16 << 20

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x9E3779B97F4A7C15


def _grams(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings of the last axis (GRAM is a power of two), by joining halves."""
    h, step, size = _BYTES[b], _STEP, 1
    while size < GRAM:
        h = h[..., :-size] * np.uint64(step) + h[..., size:]
        step, size = step * step % (1 << 64), 2 * size
    return mixed(h)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, place, name, start, end) of the anchors of texts that follow each other in data: the strings that belong to an
    anchor make up data[start:end], and the anchor is the first of the smallest grams of each.

    In runs of one repeated gram (lines of one sign, say) every place would be an anchor: as few are kept as leave no string
    without, and these span all strings that hold them.
    """
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, none
    h = _grams(data)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
    begin = np.flatnonzero(np.arange(len(key)) + length <= offsets[text + 1])
    if len(begin) == 0:
        return none, none, none.astype(np.uint64), none, none
    at, text = (key[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64), text[begin]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    start, end = begin[first], begin[np.append(first[1:], len(at)) - 1] + length
    at, text = at[first], text[first]
    tied = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (np.diff(at) < width) & (text[1:] == text[:-1]))
    if len(tied):
        keep = np.ones(len(at), bool)
        spread = np.zeros(len(at), bool)
        edges = np.r_[0, np.flatnonzero(np.diff(tied) > 1) + 1, len(tied)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            i, last = int(tied[lo]), int(tied[hi - 1]) + 1
            keep[i + 1 : last] = False
            spread[i : last + 1] = True
            while i < last:
                j = min(int(np.searchsorted(at, at[i] + width, side="right")) - 1, last)
                i = max(j, i + 1)
                keep[i] = True
        start = np.where(spread, np.maximum(offsets[text], at - (length - GRAM)), start)
        end = np.where(spread, np.minimum(offsets[text + 1], at + length), end)
        at, text, start, end = at[keep], text[keep], start[keep], end[keep]
    return text, at, mixed(h[at]), start, end  # anchors have small hashes, and buckets need even ones


def _runs_of(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """(first row, end row, base, bytes, offsets, runs) of slices of a text column; a long text comes in pieces that begin at base."""
    for lo, hi, data, offsets in slices(column, SLICE_BYTES):
        if len(data) <= 2 * SLICE_BYTES:
            yield lo, hi, 0, data, offsets, anchor_runs(data, offsets, length)
            continue
        for base in range(0, len(data) - length + 1, SLICE_BYTES):
            piece = data[base : base + SLICE_BYTES + length - 1]
            edges = np.array([0, len(piece)])
            yield lo, hi, base, piece, edges, anchor_runs(piece, edges, length)


def _key8(data) -> int:
    return int(hashlib.sha256(data).hexdigest()[:15], 16)


def _counted(length: int, bits: int):
    """Blocks of texts -> for each fragment one row: keys of the texts that have anchors in it, counts and anchors' hashes (32 bits below
    the fragment's). Without counts there is a key for each anchor. No more than 12 bytes an anchor, whatever the number of fragments.
    """

    def emit(keys: np.ndarray, h: np.ndarray, owner: np.ndarray):
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[once], owner[once]
        f = (h >> np.uint64(64 - bits)).astype(np.int64)
        low = ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(f, kind="stable")
        f, low, owner = f[order], low[order], owner[order]
        edges = np.searchsorted(f, np.arange((1 << bits) + 1))
        for i in range(1 << bits):
            a, b = edges[i], edges[i + 1]
            if b > a:
                # owners that have anchors here, with their number; or one owner an anchor where that is shorter
                first = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
                if 12 * len(first) < 8 * (b - a):
                    counts = np.diff(np.r_[first, b - a]).astype(np.uint32)
                    yield i, keys[owner[a + first]].tobytes(), counts.tobytes(), low[a:b].tobytes()
                else:
                    yield i, keys[owner[a:b]].tobytes(), b"", low[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, int] = {}  # key of a text -> its number in the block
        hashes, owners, size = [], [], 0

        def block() -> pa.RecordBatch:
            rows = pd.DataFrame(emit(np.array(list(keys), np.int64), np.concatenate(hashes), np.concatenate(owners)), columns=_COUNTED.names)
            return pa.RecordBatch.from_pandas(rows, _COUNTED, preserve_index=False)

        for batch in batches:
            for lo, hi, base, data, offsets, (text, _, h, _, _) in _runs_of(batch.column("text"), length):
                if base == 0:
                    if size > BLOCK_BYTES:
                        yield block()
                        keys, hashes, owners, size = {}, [], [], 0
                    whole = batch.column("text").slice(lo, hi - lo).fill_null("")
                    names = [_key8(x.as_buffer()) for x in whole]
                    number = np.array([-1 if x in keys else keys.setdefault(x, len(keys)) for x in names])  # a copy in the block counts once
                own = number[text]
                hashes.append(h[own >= 0])
                owners.append(own[own >= 0])
                size += len(data)
        if hashes:
            yield block()

    return run


_COUNTED = pa.schema([("f", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """(text key, hash) of the anchors of a fragment that another text also has."""
    grams = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["grams"]])
    owner = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(c, np.uint32)) if c else np.frombuffer(k, np.int64) for k, c in zip(pdf["keys"], pdf["counts"])])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
    kept = np.repeat(several, np.diff(np.r_[starts, len(grams)]))
    return pd.DataFrame({"key8": owner[kept], "gram": (np.int64(pdf["f"].iloc[0]) << 32) | grams[kept].astype(np.int64)})


def _void(*columns: np.ndarray) -> np.ndarray:
    """Rows of bytes, side by side, as one column that can be sorted."""
    joined = np.ascontiguousarray(np.concatenate(columns, axis=1))
    return joined.view(f"V{joined.shape[1]}").ravel()


def _big_endian(h: np.ndarray) -> np.ndarray:
    return h.astype(">u8")[:, None].view(np.uint8).reshape(len(h), 8)


def _contexts(length: int, counted_bits: int, bits: int):
    """Texts with their shared anchors -> for each bucket one row: hashes, ids, starts, sizes, places and packed context bytes.

    Contexts that equal one of a smaller document in the same block are repeats already. They follow in rows with f beyond
    the buckets, without bytes.
    """
    width = 2 * length - GRAM

    def emit(parts: list[tuple], number: int):
        h, ids, start, size, off = (np.concatenate([p[i] for p in parts]) for i in range(5))
        rows = np.concatenate([p[5] for p in parts])
        kind = _void(_big_endian(h), size[:, None], off[:, None], rows)
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(kind[order], kind="stable")]
        h, ids, start, size, off, rows, kind = (x[order] for x in (h, ids, start, size, off, rows, kind))
        new = np.ones(len(h), bool)
        new[1:] = kind[1:] != kind[:-1]
        least = ids[new][np.cumsum(new) - 1]
        again = (ids > least) & (size >= length)
        pack = zstandard.ZstdCompressor(level=3).compress
        if again.any():
            yield (1 << bits) + number % (1 << bits), b"", ids[again].tobytes(), start[again].tobytes(), size[again].tobytes(), b"", b""
        kept = np.flatnonzero(~again)  # in order of hash: contexts of one anchor follow each other and pack well
        edges = np.searchsorted((h[kept] >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        for i in range(1 << bits):
            own = kept[edges[i] : edges[i + 1]]
            if len(own):
                yield i, h[own].tobytes(), ids[own].tobytes(), start[own].tobytes(), size[own].tobytes(), off[own].tobytes(), pack(rows[own].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, TaskContext.get().partitionId()  # spreads the tasks' repeats
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("grams")
            edges = np.asarray(lists.offsets)
            wanted = lists.values.to_numpy(zero_copy_only=False)
            for lo, hi, base, data, offsets, (text, at, h, begin, end) in _runs_of(batch.column("text"), length):
                # the text's number in the slice above the anchor's name
                known = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1])) << 46 | wanted[edges[lo] : edges[hi]]
                known.sort()
                name = text << 46 | (h >> np.uint64(32 - counted_bits)).astype(np.int64)
                place = np.minimum(np.searchsorted(known, name), len(known) - 1)
                own = np.flatnonzero(known[place] == name) if len(known) else np.zeros(0, np.int64)
                if len(own) == 0:
                    continue
                text, at, h, begin, end = (x[own] for x in (text, at, h, begin, end))
                place = begin[:, None] + np.arange(width)
                rows = np.where(place < end[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)
                parts.append((h, ids[lo:hi][text], begin - offsets[text] + base, (end - begin).astype(np.uint8), (at - begin).astype(np.uint8), rows))
                held += rows.size
                if held > BLOCK_BYTES:
                    yield _packed(emit(parts, number))
                    parts, held, number = [], 0, number + 1
        if parts:
            yield _packed(emit(parts, number))

    return run


_CONTEXTS = pa.schema([("f", pa.int32()), *((k, pa.binary()) for k in ("h", "ids", "start", "size", "off", "bytes"))])


def _packed(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_CONTEXTS.names), _CONTEXTS, preserve_index=False)


def smallest_owner(contexts: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest owner of the `length` bytes at each place of the joined contexts; each context's first place and number of strings."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    # separators sort below all bytes; suffixes that would cross one have too few bytes left and take no part
    symbols = text.astype(np.int64) + 1
    symbols[ends] = 0
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    owner_at = np.searchsorted(ends, order, side="left")
    whole = order + length <= ends[owner_at]
    order, owner_at = order[whole], owner_at[whole]
    flat = np.full(len(text), np.iinfo(np.int64).max)
    if len(order):
        windows = np.lib.stride_tricks.sliding_window_view(text, length)
        same = np.zeros(len(order), bool)
        for a in range(1, len(order), 65536):
            z = min(a + 65536, len(order))
            same[a:z] = (windows[order[a:z]] == windows[order[a - 1 : z - 1]]).all(axis=1)
        groups = np.flatnonzero(~same)
        flat[order] = np.repeat(np.minimum.reduceat(owners[owner_at], groups), np.diff(np.append(groups, len(order))))
    return flat, ends - sizes, np.maximum(0, sizes - length + 1)


def _agreement(h: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """How many bytes each row of sides has in common, from its start, with the row of equal h that agrees longest."""
    joined = np.concatenate([_big_endian(h), sides], axis=1)
    order = np.argsort(_void(joined), kind="stable")
    ranked = joined[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), joined.shape[1]) - 8
    best = np.maximum(np.r_[0, common], np.r_[common, 0])
    out = np.empty(len(h), np.int64)
    out[order] = np.maximum(best, 0)
    return out


def _recurs(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a context holds its anchor's gram more than once."""
    out = np.zeros(len(h), bool)
    for a in range(0, len(h), 4096):
        out[a : a + 4096] = (mixed(_grams(rows[a : a + 4096])) == h[a : a + 4096, None]).sum(axis=1) > 1
    return out


def narrowed(h: np.ndarray, off: np.ndarray, size: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The part [start, end) of each context that can agree with another one of its anchor.

    A string that holds the gram once can only match a context at the gram; it then lies within the longest agreement to the
    left and to the right. Contexts with the gram more than once are taken whole.
    """
    side = length - GRAM
    step = np.arange(side)
    right = off[:, None] + GRAM + step
    right = np.where(right < size[:, None], np.take_along_axis(rows, np.minimum(right, rows.shape[1] - 1), axis=1), 0)
    left = off[:, None] - 1 - step
    left = np.where(left >= 0, np.take_along_axis(rows, np.maximum(left, 0), axis=1), 0)
    a = off - np.minimum(off, _agreement(h, left.astype(np.uint8)))
    z = np.minimum(size, off + GRAM + _agreement(h, right.astype(np.uint8)))
    whole = _recurs(h, rows)
    return np.where(whole, 0, a), np.where(whole, size, z)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count times, for each entry, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _repeats(length: int, buckets: int):
    """A bucket's contexts -> (id, start, end) of bytes that a document with a smaller id also has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, ids, start = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("h", np.uint64), ("ids", np.int64), ("start", np.int64)))
        size = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["size"]]).astype(np.int64)
        if pdf["f"].iloc[0] >= buckets:  # repeats already
            return pd.DataFrame({"id": ids, "start": start, "end": start + size})
        off = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["off"]]).astype(np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        rows = np.concatenate([np.frombuffer(unpack(x), np.uint8).reshape(-1, 2 * length - GRAM) for x in pdf["bytes"]])
        small = np.stack([size, off], axis=1).astype(np.uint8)
        kinds, first, number = np.unique(_void(_big_endian(h), small, rows), return_index=True, return_inverse=True)
        n_kinds = len(kinds)
        del kinds
        least = np.full(n_kinds, np.iinfo(np.int64).max)
        np.minimum.at(least, number, ids)
        later = (ids > least[number]) & (size >= length)  # the whole context is in an earlier document
        out = [(ids[later], start[later], start[later] + size[later])]
        # kinds are sorted by hash: an anchor's contexts lie side by side, and one alone has nothing to be sorted against
        new = np.ones(n_kinds, bool)
        new[1:] = h[first][1:] != h[first][:-1]
        group = np.cumsum(new) - 1
        own = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(own):
            at = first[own]
            a, z = narrowed(h[at], off[at], size[at], rows[at], length)
            fits = z - a >= length
            own, a, z = own[fits], a[fits], z[fits]
            firsts = np.flatnonzero(ids == least[number])
            firsts = firsts[np.argsort(number[firsts], kind="stable")]
            texts = [rows[first[k], i:j].tobytes() for k, i, j in zip(own.tolist(), a.tolist(), z.tolist())]
            for x, lo, hi in _sorted_groups(group[own], texts, least[own], length):
                b, e = (np.searchsorted(number[firsts], own[x], side=side) for side in ("left", "right"))
                i = firsts[_spread(b, e - b)]
                lo, hi = (np.repeat(a[x] + v, e - b) for v in (lo, hi))
                out.append((ids[i], start[i] + lo, start[i] + hi))
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("id", "start", "end"))})

    return run


def _sorted_groups(group: np.ndarray, texts: list[bytes], owners: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, starts, ends) of the strings of texts that a smaller owner also has; a group is sorted together.

    Equal texts of a group are one for the sorting, with their smallest owner; if they are all the group has, there is nothing
    to sort.
    """
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    batch: list[bytes] = []  # distinct texts
    least: list[int] = []
    members: list[int] = []
    kinds: list[int] = []  # of each member
    alone: list[tuple[int, int]] = []
    held = 0

    def sort() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, first, count = smallest_owner(batch, np.array(least), length)
        x, kind = np.array(members), np.array(kinds)
        n = count[kind]
        member = np.repeat(np.arange(len(x)), n)
        hit = flat[_spread(first[kind], n)] < np.repeat(owners[x], n)
        place = _spread(np.zeros(len(x), np.int64), n)
        joined = hit[1:] & hit[:-1] & (member[1:] == member[:-1])
        begin = np.flatnonzero(hit & ~np.append(False, joined))
        end = np.flatnonzero(hit & ~np.append(joined, False))
        return x[member[begin]], place[begin], place[end] + length

    for lo, hi in zip(edges[:-1], edges[1:]):
        own: dict[bytes, list[int]] = {}
        for x in range(lo, hi):
            own.setdefault(texts[x], []).append(x)
        if len(own) == 1 and hi - lo > 1:
            best = min(owners[x] for x in range(lo, hi))
            alone += [(x, len(texts[x])) for x in range(lo, hi) if owners[x] > best]
        if len(own) < 2:
            continue
        for text, same in own.items():
            least.append(min(owners[x] for x in same))
            members += same
            kinds += [len(batch)] * len(same)
            batch.append(text)
            held += len(text)
        if held > SORT_BYTES:
            yield sort()
            batch, least, members, kinds, held = [], [], [], [], 0
    if batch:
        yield sort()
    if alone:
        x, n = np.array(alone).T
        yield x, np.zeros(len(x), np.int64), n


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    a, z = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, a[1:] > z[:-1]])
    return a[new], z[np.r_[new[1:] - 1, len(a) - 1]]


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(described, spans, known): (id, n_bytes, sha, rep) of each row, (id, start, end) of repeats in first copies, (id, text) of what takes part.

    A byte of a document is a repeat if a string of `length` bytes over it also starts in a document with a smaller id;
    strings are judged on the input. rep is the smallest id with the same text: a document with id > rep repeats it whole if
    it has `length` bytes, and has no rows in spans. Spans may overlap. Null text is empty. Rows without id take no part, and
    of rows that repeat an id with different texts only those with the smallest SHA-256 do; the others have no rep.
    """
    if length < GRAM + 1 or 2 * length - GRAM > 255:
        raise ValueError("length must lie between 17 and 135")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    described = stored(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "described")
    known = rows.filter(F.col("id").isNotNull())
    chosen = described.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("sha").alias("sha"), F.max("sha").alias("other"), F.first("n_bytes").alias("n"))
    if not chosen.filter("sha != other").isEmpty():
        known = known.withColumn("sha", F.sha2("text", 256)).join(chosen, ["id", "sha"], "left_semi").select("id", "text")
        described = described.join(chosen.select("id", "sha", F.lit(True).alias("part")), ["id", "sha"], "left")
    else:
        described = described.withColumn("part", F.col("id").isNotNull())
    taking = described.filter("part")
    classes = taking.groupBy("sha").agg(F.min("id").alias("rep"), F.max("n_bytes").alias("n"))
    classes = stored(classes, "classes")  # a table of its own, so that a hot text is dealt out again
    size = classes.agg(F.sum("n")).first()[0] or 0
    counted_bits = max(4, partitions(spark).bit_length() - 1, (size // COUNTED_BYTES).bit_length())
    bits = max(counted_bits + 2, (size // SORTED_BYTES).bit_length())
    counted = known.select("text").mapInArrow(_counted(length, counted_bits), "f int, keys binary, counts binary, grams binary")
    shared = counted.groupBy("f").applyInPandas(_shared, "key8 long, gram long")
    flags = shared.groupBy("key8").agg(F.collect_list("gram").alias("grams"))
    key8 = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    flagged = flags.join(classes.withColumn("key8", key8), "key8").select(F.col("rep").alias("id"), "grams")
    firsts = known.join(flagged, "id").select("id", "text", "grams").sortWithinPartitions("id")  # a retried task must deal the same blocks
    contexts = firsts.mapInArrow(_contexts(length, counted_bits, bits), "f int, h binary, ids binary, start binary, size binary, off binary, bytes binary")
    spans = contexts.groupBy("f").applyInPandas(_repeats(length, 1 << bits), "id long, start long, end long")
    described = described.join(classes.drop("n"), "sha", "left").withColumn("rep", F.when(F.col("part"), F.col("rep"))).drop("part")
    return described, stored(spans, "spans"), known


def _merged(starts: pa.Array, ends: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of two list columns, the maximal runs of its spans."""
    edges = np.asarray(starts.offsets)
    a, z = starts.values.to_numpy(zero_copy_only=False), ends.values.to_numpy(zero_copy_only=False)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield merge_spans(a[lo:hi], z[lo:hi])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out = []
        for i, (a, z) in enumerate(_merged(batch.column("starts"), batch.column("ends"))):
            digest, at, end = hashlib.sha256(), int(offsets[i]), int(offsets[i + 1])
            for lo, hi in zip((a + at).tolist(), (z + at).tolist()):
                digest.update(data[at:lo])
                at = hi
            digest.update(data[at:end])
            out.append((int((z - a).sum()), len(a), digest.hexdigest()))
        removed, spans, kept = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["id", "removed", "spans", "kept"])


def repeat_digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each document without its repeats (see repeated_spans).

    Every row gives one row. Rows without id, and rows that repeat an id with another text, lose nothing. An empty table gives
    an empty result.
    """
    described, spans, known = repeated_spans(docs, length, id_col, text_col)
    by_doc = spans.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    cut = known.join(by_doc, "id").mapInArrow(_cut, "id long, removed long, spans long, kept string").dropDuplicates(["id"])
    whole = (F.col("id") > F.col("rep")) & (F.col("n_bytes") >= length)
    joined = described.join(cut.withColumnRenamed("id", "cut_id"), (F.col("id") == F.col("cut_id")) & F.col("rep").isNotNull(), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _trim(data: bytes | np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """The span less what it holds of code points that stick out of it."""
    while lo < hi and data[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeats (see repeated_spans) cut out of their texts; all rows and columns stay.

    A code point of which only part is a repeat stays. A text that is a repeat as a whole becomes empty. Null texts, rows
    without id and rows that repeat an id with another text stay as they are.
    """
    described, spans, _ = repeated_spans(docs, length, id_col, text_col)
    copies = described.filter((F.col("id") > F.col("rep")) & (F.col("n_bytes") >= length)).distinct()
    spans = spans.unionByName(copies.select("id", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    starts, ends, span_id, span_sha = (free_name(f"repeat_{x}", docs.columns) for x in ("starts", "ends", "id", "sha"))
    by_doc = spans.groupBy("id").agg(F.collect_list("start").alias(starts), F.collect_list("end").alias(ends))
    own = described.filter(F.col("rep").isNotNull()).select("id", "sha").distinct()
    by_doc = by_doc.join(own, "id").select(F.col("id").alias(span_id), F.col("sha").alias(span_sha), starts, ends)
    same = (F.col(id_col).cast("long") == F.col(span_id)) & (F.sha2(text_or_empty(text_col), 256) == F.col(span_sha))
    joined = docs.join(by_doc, same, "left").drop(span_id, span_sha)
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            data, offsets = text_bytes(column)
            out: list[bytes | None] = []
            for i, (a, z) in enumerate(_merged(batch.column(starts), batch.column(ends))):
                at, end = int(offsets[i]), int(offsets[i + 1])
                kept = []
                for lo, hi in zip((a + offsets[i]).tolist(), (z + offsets[i]).tolist()):
                    lo, hi = _trim(data[:end], lo, hi)
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:end])
                out.append(b"".join(kept) if column[i].is_valid else None)
            text = pa.array(out, pa.binary()).cast(column.type)
            yield batch.select(fields).set_column(fields.index(text_col), batch.schema.field(text_col), text)

    return joined.mapInArrow(run, docs.schema)
