"""Packing along a space-filling curve.

Documents become hashed token vectors of a few dimensions, the vectors a Hilbert key; the key orders the corpus, and the
ordered token stream is cut every `length` tokens. Neighbours on the curve share sequences, and only the very last sequence
has padding.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_block, merges_of
from tessera.llm.common import partitions, stored, text_or_empty
from tessera.llm.ranges import MAX_RANGES, sampled_ranges

DIMENSIONS = 4
BITS = 15
#: Tokens of a range; a range is what one task orders and packs.
RANGE_TOKENS = 4 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows, dimensions), each coordinate below 2**bits (Skilling's transpose form)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(vocabulary: int, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """One vector of signed hashes for each token id."""
    return np.random.default_rng(seed).standard_normal((vocabulary, dimensions)).astype(np.float32)


def place(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A document's point: the sum of its tokens' vectors, each token counted by the root of its count, as unit vector.

    A document without tokens lies at the origin.
    """
    if len(ids) == 0:
        return np.zeros(table.shape[1])
    token, n = np.unique(ids, return_counts=True)
    v = np.sqrt(n) @ table[token]
    return v / (np.linalg.norm(v) or 1.0)


def _grid(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.clip(((points + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file: strings that are one token wherever a text holds them."""
    with open(json_path, encoding="utf-8") as f:
        listed = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in listed if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens that take their surroundings into account: {odd}")
    return {t["content"]: t["id"] for t in listed}


class Tokens:
    """Token ids of the given vocabulary and its added tokens; a text on which the fast encoder gives up goes through merge replay.

    The encoder is quicker with an added token than without any, as it then searches for that one rather than at every place.
    """

    def __init__(self, ranks: bytes, pattern: str, added: dict[str, int]):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=added)
        self.table, self.pattern, self.added = table, pattern, added
        self.vocabulary = max([*table.values(), *added.values()]) + 1
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except (ValueError, RuntimeError):  # its pattern engine runs out of stack on very long runs
            return self.replayed(text)

    def replayed(self, text: str) -> np.ndarray:
        out, at = [np.zeros(0, np.int64)], 0
        for found in [*(self.cut.finditer(text) if self.cut else ()), None]:
            block = encode_block([text[at : found.start() if found else len(text)]], merges_of(self.table), self.pattern)
            out += [block.of_word(w) for w in block.documents[0]]
            if found:
                out.append(np.array([self.added[found[0]]]))
                at = found.end()
        return np.concatenate(out).astype(np.uint32)


def _tokenized(batches: Iterator[pd.DataFrame], ranks, pattern: str, added: dict[str, int], end_id: int) -> Iterator[pd.DataFrame]:
    tokens = Tokens(ranks.value, pattern, added)
    table = projection(tokens.vocabulary)
    for pdf in batches:
        ids, points, counts = [], [], []
        for text in pdf["text"]:
            own = tokens(text)
            points.append(place(own, table))
            own = np.append(own, np.uint32(end_id))
            counts.append(len(own))
            ids.append(own.astype("<u4" if own.max() > 65535 else "<u2").tobytes())
        if counts:
            yield pd.DataFrame({"named": pdf["named"], "k2": pdf["k2"], "k1": hilbert_key(_grid(np.array(points))), "w": counts, "ids": ids})


def _pack(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, at = None, 0
        for pdf in batches:
            out = []
            names = np.where(pdf["named"], pdf["k2"].astype(object), None)
            for range_id, before, doc, n, blob in zip(pdf["range_id"], pdf["weight_before"], names, pdf["w"], pdf["ids"]):
                if range_id != current:
                    current, at = range_id, before
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at, length)
                    take = min(n - start, length - offset)
                    out.append((doc, start, take, zlib.crc32(ids[start : start + take].tobytes()), n, sequence, offset))
                    start, at = start + take, at + take
            if out:
                rows = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                yield rows.assign(doc_id=rows["doc_id"].astype("Int64"))

    return run


def pack_along_curve(
    docs: DataFrame, ranks_path: str, pattern: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", range_tokens: int = RANGE_TOKENS,
    json_path: str | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Ids are those of the tokenizer file json_path, whose added tokens are found in texts (none without it), without special tokens
    around them.
    Each document's ids and end_id lie in exactly one piece each; a sequence's pieces fill it from offset 0 without gaps, and
    only the last sequence is padded. Null text counts as empty (one id). Copies share a key and are told apart by id, so a
    range may cut through a group of copies. Rows are read with their id as number and must have distinct ids for the pieces
    to be told apart; repeated rows are packed each, and so are rows without id, whose pieces have no doc_id. An empty table
    gives no pieces.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file: under 1 MB, whatever the corpus
    added = added_tokens(json_path) if json_path else {}
    own = F.col(id_col).cast("long")
    rows = docs.select(own.isNotNull().alias("named"), F.coalesce(own, F.monotonically_increasing_id()).alias("k2"), text_or_empty(text_col).alias("text"))
    tokens = rows.mapInPandas(lambda it: _tokenized(it, ranks, pattern, added, end_id), "named boolean, k2 long, k1 long, w long, ids binary")
    tokens = stored(tokens, "tokens")
    total = tokens.agg(F.sum("w")).first()[0] or 0
    parts = min(MAX_RANGES, max(1, -(-total // range_tokens), min(4 * spark.sparkContext.defaultParallelism, total // 65536)))
    ranges = sampled_ranges(tokens, parts)
    ordered = (
        ranges.rows.join(F.broadcast(ranges.before.select("range_id", "weight_before")), "range_id")
        .repartition(max(partitions(spark), parts), "range_id")
        .sortWithinPartitions("range_id", "k1", "k2")
    )
    return ordered.mapInPandas(_pack(length), PIECES)
