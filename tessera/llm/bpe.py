"""Byte-level BPE by merge replay over a block's distinct words, with an inverted index from token pair to word positions.

A block is the run of documents a task holds at a time. Its words (matches of the split pattern) are counted once; the
merges then run in rank order over all distinct words together. For each rank the index gives the places where its pair
stands; only the pairs left and right of a merged place are entered anew. Nothing is shuffled, collected or broadcast but
the rank table.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

#: A block ends once it holds this many characters; a longer text is a block of its own.
BLOCK_CHARS = 12 << 20
GONE = -1
#: So few places are looked up one by one, which beats array calls.
FEW = 12


@dataclass(frozen=True)
class Merges:
    """tokens: bytes by id. left/right/made: ids of every merge in rank order. byte_ids: id of each single byte."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    byte_ids: np.ndarray


def read_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    """Ranks from lines of base64 token and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> Merges:
    """The two parts of each token: what replaying all lower ranks leaves of its bytes."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    left, right, made = [], [], []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            left.append(ranks[parts[0]])
            right.append(ranks[parts[1]])
            made.append(rank)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return Merges(tokens, np.array(left, np.int32), np.array(right, np.int32), np.array(made, np.int32), byte_ids)


class _Index:
    """Places by rank of the pair that starts there: each layer is sorted by rank once, later layers hold what merges add."""

    def __init__(self, n_ranks: int):
        self.added: list[list[np.ndarray | int]] = [[] for _ in range(n_ranks)]

    def enter(self, ranks: np.ndarray, places: np.ndarray) -> None:
        if len(places) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for r, part in zip(ranks[starts].tolist(), np.split(places, cuts)):
            self.added[r].append(part)

    def take(self, rank: int) -> np.ndarray | None:
        parts, self.added[rank] = self.added[rank], []
        if not parts:
            return None
        single = [x for x in parts if type(x) is int]
        if not single:
            return parts[0] if len(parts) == 1 else np.concatenate(parts)
        return np.concatenate([np.array(single, np.int32), *(x for x in parts if type(x) is not int)])


def encode_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words laid end to end, and where each word's ids begin (one more at the end)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.append(merges.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.int32(GONE))
    n = len(ids) - 1  # the last place stands for "none"
    ends = np.cumsum(lengths)
    if n == 0:
        return ids[:0], np.zeros(len(words) + 1, np.int64)
    after = np.arange(1, n + 1, dtype=np.int32)  # the next place of the same word, n: none
    after[ends[lengths > 0] - 1] = n
    before = np.arange(-1, n - 1, dtype=np.int32)
    starts = (ends - lengths)[lengths > 0]
    before[starts] = -1
    size = len(merges.tokens)
    keys = merges.left.astype(np.int64) * size + merges.right
    by_key = np.argsort(keys)
    sorted_keys = keys[by_key]

    def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in the order of merges, or GONE."""
        key = a.astype(np.int64) * size + b
        at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == key, by_key[at], GONE)

    index = _Index(len(keys))

    pair_rank = dict(zip(keys.tolist(), range(len(keys))))
    added = index.added

    def enter(places: np.ndarray) -> None:
        if len(places) <= FEW:
            for place in places.tolist():
                r = pair_rank.get(int(ids[place]) * size + int(ids[after[place]]))
                if r is not None:
                    added[r].append(place)
            return
        found = rank_of(ids[places], ids[after[places]])
        index.enter(found[found >= 0], places[found >= 0])

    # the first layer in slices, as the look-up needs several times its size
    first = np.flatnonzero(after < n)
    for s in range(0, len(first), 1 << 20):
        enter(first[s : s + (1 << 20)])
    for r in range(len(keys)):
        places = index.take(r)
        if places is None:
            continue
        a, b, made = int(merges.left[r]), int(merges.right[r]), int(merges.made[r])
        nexts = after[places]  # of a place gone, any
        live = (ids[places] == a) & (ids[nexts] == b)
        places, nexts = places[live], nexts[live]
        if len(places) > 1:
            places, keep = np.unique(places, return_index=True)
            nexts = nexts[keep]
            if a == b:  # of a run of the same token, every other place from its start
                follows = np.r_[False, places[1:] == nexts[:-1]]
                run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
                even = (np.arange(len(places)) - run) % 2 == 0
                places, nexts = places[even], nexts[even]
        if len(places) == 0:
            continue
        ids[places], ids[nexts] = made, GONE
        beyond = after[nexts]
        after[places] = beyond
        inside = beyond < n
        before[beyond[inside]] = places[inside]
        left = before[places]
        touched = np.concatenate([left[left >= 0], places[inside]])
        if len(touched) < 40 or a != b:
            enter(touched)
        else:
            enter(np.unique(touched))
    ids = ids[:n]
    kept = ids >= 0
    begins = np.r_[0, np.cumsum(kept)][np.r_[0, ends]]
    return ids[kept], begins


#: Blocks of texts -> rows; a worker process builds the tables once.
_TABLES: dict[str, Merges] = {}


def _tables(key: str, lines: list[bytes]) -> Merges:
    if key not in _TABLES:
        _TABLES[key] = merges_of(read_ranks(iter(lines)))
    return _TABLES[key]


@dataclass
class Encoded:
    """A block's words: for each document the numbers of its words; for each word its ids."""

    documents: list[np.ndarray]
    ids: np.ndarray
    begins: np.ndarray

    def of_word(self, w: int) -> np.ndarray:
        return self.ids[self.begins[w] : self.begins[w + 1]]


def encode_block(texts: list[str], merges: Merges, pattern: str) -> Encoded:
    split = regex.compile(pattern).findall
    number: defaultdict[str, int] = defaultdict(count().__next__)
    documents = []
    for text in texts:
        words = split(text)
        documents.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    ids, begins = encode_words([w.encode("utf-8", "surrogatepass") for w in number], merges)
    return Encoded(documents, ids, begins)


def _blocks(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple[list, list[str]]]:
    names, texts, size = [], [], 0
    for pdf in batches:
        for name, text in zip(pdf["id"], pdf["text"]):
            names.append(name)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield names, texts
                names, texts, size = [], [], 0
    if names:
        yield names, texts


def _rows(encoded: Encoded, merges: Merges) -> Iterator[tuple[int, str, str]]:
    """(number of ids, digest of their decimals, digest of the decoded bytes) of each document."""
    decimal = np.array([str(i) for i in range(len(merges.tokens))], object)[encoded.ids].tolist()
    pieces = np.array([*merges.tokens, b""], object)[encoded.ids].tolist()
    begins = encoded.begins.tolist()
    said = [" ".join(decimal[a:b]) for a, b in zip(begins, begins[1:])]
    decoded = [b"".join(pieces[a:b]) for a, b in zip(begins, begins[1:])]
    lengths = np.diff(encoded.begins)
    for words in encoded.documents:
        own = words.tolist()
        yield (
            int(lengths[words].sum()),
            hashlib.sha256(" ".join(map(said.__getitem__, own)).encode()).hexdigest(),
            hashlib.sha256(b"".join(map(decoded.__getitem__, own))).hexdigest(),
        )


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, ids array<int>: each match of the pattern encoded separately, without special tokens.

    Null text: no ids. Repeated rows are encoded each; ids may be null; other columns are ignored. A text longer than a block
    is encoded whole. An empty table gives an empty result.
    """
    lines = _lines(docs.sparkSession, ranks_path)

    def run(batches):
        merges = _tables(ranks_path, lines.value)
        for names, texts in _blocks(batches, block_chars):
            e = encode_block(texts, merges, pattern)
            rows = [np.concatenate([e.of_word(w) for w in words]) if len(words) else np.zeros(0, np.int32) for words in e.documents]
            yield pd.DataFrame({id_col: pd.array(names, "Int64"), "ids": rows})

    return _inputs(docs, id_col, text_col).mapInPandas(run, f"{id_col} long, ids array<int>")


def decode(ids: np.ndarray, merges: Merges) -> bytes:
    return b"".join(merges.tokens[i] for i in ids)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: the digests of tokenize()'s ids and of the bytes they decode to.

    The same blocks and rules as tokenize(); a null text has no ids and the digests of nothing.
    """
    lines = _lines(docs.sparkSession, ranks_path)

    def run(batches):
        merges = _tables(ranks_path, lines.value)
        for names, texts in _blocks(batches, block_chars):
            rows = list(_rows(encode_block(texts, merges, pattern), merges))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, pd.array(names, "Int64"))
            yield out

    return _inputs(docs, id_col, text_col).mapInPandas(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))


def _lines(spark: SparkSession, path: str):
    """The rank table's lines, broadcast: a vocabulary file has a fixed size (under 1 MB), whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read().splitlines())
