"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come by document; tokens are labelled from them: a token of a toxic document is toxic if its word or a beginning of it
stands in toxic documents far oftener than in clean ones (a likelihood-ratio test on whole texts of labelled documents), and every
token of a clean document is clean. The field has two states, features of a word and of its neighbours, and is fitted to
sentences of labelled documents. Forward-backward passes give every token of every document its marginal; the largest one and
their sum, calibrated on labelled documents that the field has not seen, are a document's score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_draw, stored, text_or_empty

#: Documented bounds of the fit: labelled rows of each label, sentences drawn from one, signs of toxicity.
LABELLED_ROWS = 3000
SENTENCES = 8
SIGNS = 20_000
#: A sign stands in so many times more of the toxic than of the clean rows, and is so unlikely by chance (G statistic).
TIMES, SURPRISE = 8.0, 24.0
#: A chain is a sentence; longer ones are cut after so many tokens.
CHAIN = 128
WEIGHTS = 1 << 18
SLICE = 500
MEMORY = 1 << 19
STEPS = 80
# Thai and Lao, Burmese, Khmer, kana, Han: written without spaces, a token each.
LONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{LONE}]")
PLAIN = re.compile(r"\w+|[.!?\n]")
MIXED = re.compile(rf"[{LONE}]|(?:(?![{LONE}])\w)+|[.!?\n。！？]")
ENDS = {".", "!", "?", "\n", "。", "！", "？"}


def pattern_of(text: str) -> re.Pattern:
    return MIXED if not text.isascii() and UNSPACED.search(text) else PLAIN


def beginnings(word: str) -> list[str]:
    """The word and its first 3 to 6 characters, told apart."""
    return [f"={word}", *(word[:k] for k in range(3, min(7, len(word))))]


def features(word: str) -> tuple[list[int], list[int], list[int]]:
    """Hashed features: what a word says of itself, of the word after it and of the word before it."""
    b, crc = word.encode("utf-8", "surrogatepass"), zlib.crc32
    n, mask = len(b), WEIGHTS - 1
    own = [min(n, 12), crc(b, 1) & mask, crc(b[-3:], 2) & mask]
    if n > 3:
        own += [crc(b[:k], 3) & mask for k in range(3, min(7, n))]
    begin = b[:4]
    return own, [crc(b, 4) & mask, crc(begin, 5) & mask], [crc(b, 6) & mask, crc(begin, 7) & mask]


@dataclass(frozen=True)
class Field:
    """weights: of the toxic state against the clean one, by hashed feature; moves[i, j]: of going from state i to j; first: of a
    chain's first state."""

    weights: np.ndarray
    moves: np.ndarray
    first: float


class Words(dict):
    """Word -> place in `own`, `after`, `before`, its shares of the emissions of itself and its neighbours; forgets all when full."""

    def __init__(self, field: Field):
        super().__init__()
        self.weights = field.weights.tolist()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update(dict.fromkeys(ENDS, 0))
        self.own, self.after, self.before = (array("d", [0.0]) for _ in range(3))

    def full(self, tokens: int) -> bool:
        """Whether so many more might be too many."""
        return len(self.own) + tokens > MEMORY

    def shares(self) -> np.ndarray:
        return np.stack([self.own, self.after, self.before])

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self.own)
        w, (own, (a, b), (c, d)) = self.weights, features(word)
        self.own.append(sum([w[i] for i in own]))
        self.after.append(w[a] + w[b])
        self.before.append(w[c] + w[d])
        return at


def chains(rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the chains of a run of tokens; row 0 ends a sentence, `ends` are the ends of documents."""
    stop = rows == 0
    cut = np.flatnonzero(stop) + 1
    edges = np.unique(np.r_[0, cut, ends, len(rows)])
    starts, lengths = edges[:-1], np.diff(edges)
    lengths = lengths - stop[starts + lengths - 1]
    starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    pieces = -(-lengths // CHAIN)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + inner * CHAIN, np.minimum(CHAIN, np.repeat(lengths, pieces) - inner * CHAIN)


def emissions(shares: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic state at every token, without the chain."""
    own, after, before = shares[:, rows]
    first, last = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    first[starts], last[starts + lengths - 1] = True, True
    own[1:] += np.where(first[1:], 0, after[:-1])
    own[:-1] += np.where(last[:-1], 0, before[1:])
    return own


def log_odds(field: Field, emitted: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of the toxic state, in step over all chains; their sum is the marginal's."""
    (stay, leave_clean), (leave_toxic, toxic) = np.exp(field.moves)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    forward, backward = np.zeros(len(emitted)), np.zeros(len(emitted))
    forward[starts] = emitted[starts] + field.first
    longest = lengths[0] if len(lengths) else 0
    upto = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # chains of at least so many tokens
    for t in range(1, longest):
        at = starts[: upto[t]] + t
        x = np.exp(np.clip(forward[at - 1], -30, 30))
        forward[at] = emitted[at] + np.log((leave_clean + toxic * x) / (stay + leave_toxic * x))
    for t in range(longest - 1, 0, -1):
        at = starts[: upto[t]] + t
        x = np.exp(np.clip(emitted[at] + backward[at], -30, 30))
        backward[at - 1] = np.log((leave_toxic + toxic * x) / (stay + leave_clean * x))
    return forward, backward


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_field(sentences: list[tuple[list[str], list[int]]], steps: int = STEPS, ridge: float = 1e-5) -> Field:
    """Maximum likelihood by adaptive gradient steps over all sentences (words, labels of words)."""
    known: dict[str, int] = {}
    rows, labels, sizes = [], [], []
    for words, toxic in sentences:
        rows += [known.setdefault(w, len(known)) for w in words]
        labels += toxic
        sizes.append(len(words))
    rows, y, lengths = np.array(rows, np.int64), np.array(labels, float), np.array(sizes, np.int64)
    starts = np.cumsum(lengths) - lengths
    # per role: features of all distinct words, end to end
    roles = []
    for role in range(3):
        lists = [features(w)[role] for w in known]
        roles.append((np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)))
    first, last = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    first[starts], last[starts + lengths - 1] = True, True
    weights, moves, begin = np.zeros(WEIGHTS), np.zeros((2, 2)), 0.0
    seen_w, seen_m, seen_b = np.full(WEIGHTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    inner, outer = np.flatnonzero(~first), np.flatnonzero(~last)
    true_moves = np.zeros((2, 2))
    np.add.at(true_moves, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    n = max(1, len(rows))
    for _ in range(steps):
        shares = np.stack([np.bincount(who, weights[what], len(known)) for who, what in roles])
        emitted = emissions(shares, rows, starts, lengths)
        field = Field(weights, moves, begin)
        forward, backward = log_odds(field, emitted, starts, lengths)
        p = _sigmoid(forward + backward)
        off = (p - y) / n
        # each token's error goes to itself and to its neighbours' shares
        errors = np.stack([np.bincount(rows, off, len(known)), np.bincount(rows[outer], off[outer + 1], len(known)), np.bincount(rows[inner], off[inner - 1], len(known))])
        grad = sum(np.bincount(what, e[who], WEIGHTS) for e, (who, what) in zip(errors, roles)) + ridge * weights
        # pairwise marginals of neighbours
        a, b = forward[inner - 1], emitted[inner] + backward[inner]
        joint = np.stack([np.zeros_like(a), b, a, a + b]) + moves.reshape(4, 1)
        joint = np.exp(joint - joint.max(axis=0))
        step_m = ((joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) - true_moves) / n + ridge * moves
        step_b = float((p[starts] - y[starts]).sum()) / n
        seen_w, seen_m, seen_b = seen_w + grad * grad, seen_m + step_m * step_m, seen_b + step_b * step_b
        weights, moves, begin = weights - 0.3 * grad / np.sqrt(seen_w), moves - 0.3 * step_m / np.sqrt(seen_m), begin - 0.3 * step_b / np.sqrt(seen_b)
    return Field(weights, moves, begin)


@dataclass(frozen=True)
class Model:
    """joint: of the largest marginal's log-odds, of the logarithm of their sum, and of one."""

    field: Field
    joint: tuple[float, float, float]

    def score(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.joint
        return _sigmoid(a * top + b * total + c)


def calibrated(top: np.ndarray, total: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Weighted logistic regression of y on both, by Newton steps with a weak pull towards rising weights."""
    x = np.stack([top, total, np.ones(len(top))], axis=1)
    towards = np.array([0.5, 0.5, 0.0])
    w = towards.copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * (w - towards)), -1, 1)
    return float(max(0.0, w[0])), float(max(0.0, w[1])), float(w[2])


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            part = batch.slice(start, SLICE)
            yield part, part.column(column).to_pylist()


def _summaries(field: Field, words: Words, texts: list[str], spans: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """(log-odds of the largest marginal, logarithm of their sum) by text, and its spans of tokens at 1/2 or more."""
    top, total, found = np.full(len(texts), -30.0), np.full(len(texts), -30.0), [[] for _ in texts]
    group, size = [], 0

    def flush():
        rows = np.concatenate([r for _, r in group])
        ends = np.cumsum([len(r) for _, r in group])
        starts, lengths = chains(rows, ends)
        forward, backward = log_odds(field, emissions(words.shares(), rows, starts, lengths), starts, lengths)
        z = np.where(rows == 0, -30.0, np.clip(forward + backward, -30, 30))
        for (i, r), end in zip(group, ends):
            own = z[end - len(r) : end]
            if len(own):
                top[i], total[i] = own.max(), np.log(_sigmoid(own).sum())
                if spans and top[i] >= 0:
                    found[i] = _spans(texts[i], own)

    for i, text in enumerate(texts):
        tokens = pattern_of(text).findall(text.lower())
        if group and (size + len(tokens) > 200_000 or words.full(len(tokens))):
            flush()
            group, size = [], 0
        if not group and words.full(len(tokens)):
            words.clear()
        group.append((i, np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))))
        size += len(tokens)
    if group:
        flush()
    return top, total, found


def _spans(text: str, z: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, largest marginal) of runs of tokens at 1/2 or more, in code points of the text."""
    if len(text.lower()) != len(text):  # a letter whose small form is longer: tokens of the text itself, each made small
        at = [m.span() for m in pattern_of(text).finditer(text)]
    else:
        at = [m.span() for m in pattern_of(text).finditer(text.lower())]
    out: list[list] = []
    for k in np.flatnonzero(z >= 0):
        if k >= len(at):
            break
        if out and out[-1][3] == k - 1:
            out[-1][1:] = [at[k][1], max(out[-1][2], float(z[k])), k]
        else:
            out.append([*at[k], float(z[k]), k])
    return [(a, b, float(_sigmoid(v))) for a, b, v, _ in out]


def _signs(rows: DataFrame, toxic: int, clean: int) -> set[str]:
    """Words and beginnings of words that tell toxic rows (text, label) from clean ones, counted over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for part, texts in _texts(batches, "text"):
            for text, label in zip(texts, part.column("label").to_pylist()):
                words = set(pattern_of(text).findall(text.lower())) - ENDS
                seen[label].update({b for w in words for b in beginnings(w) if len(b) < 64})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield tell(seen)
                seen = Counter(), Counter()
        yield tell(seen)

    def tell(seen):
        names = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][w] for w in names], pa.int64()) for k in (1, 0))], names=["sign", "t", "c"])

    t, c = F.col("t"), F.col("c")
    share = toxic / (toxic + clean)

    def surprise(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (surprise(t, (t + c) * share) + surprise(c, (t + c) * (1 - share)))
    counted = rows.mapInArrow(count, "sign string, t long, c long").groupBy("sign").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    telling = counted.filter((t * clean > TIMES * c * toxic) & (g >= SURPRISE)).select("sign", g.alias("g")).orderBy(F.desc("g"), "sign").limit(SIGNS)
    return {r[0] for r in telling.collect()}


def _sentences(rows: DataFrame, signs: set[str]) -> list[tuple[list[str], list[int]]]:
    """At most SENTENCES sentences a row, drawn by hash: of clean rows any, of toxic rows those that hold a toxic token."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, "text"):
            out = []
            for text, label in zip(texts, part.column("label").to_pylist()):
                found, words = [], []
                for w in [*pattern_of(text).findall(text.lower()), "."]:
                    if w not in ENDS:
                        words.append(w[:64])
                    if words and (w in ENDS or len(words) == CHAIN):
                        found.append(words)
                        words = []
                tagged = [(s, [int(label and any(b in signs for b in beginnings(w))) for w in s]) for s in found]
                tagged = [x for x in tagged if any(x[1])] if label else tagged
                out += sorted(tagged, key=lambda x: zlib.crc32(" ".join(x[0]).encode("utf-8", "surrogatepass")))[:SENTENCES]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.list_(pa.string())), pa.array([t for _, t in out], pa.list_(pa.int8()))], names=["words", "toxic"])

    drawn = rows.mapInArrow(draw, "words array<string>, toxic array<tinyint>")
    return sorted((list(r[0]), list(r[1])) for r in drawn.toLocalIterator())


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED_ROWS) -> Model | None:
    """Fit on at most `labelled` rows of either label whose fold isn't 0, drawn by hash of the id; None if a label has no such row.

    Signs are sought in folds 1 to 3 and the field is fitted there; fold 4 calibrates (all of them, if it lacks a label). Labels
    other than 0 and 1, null ids and labels without document are ignored; of an id labelled twice the larger counts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.withColumn("fold", fold("id")).filter("fold != 0")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    there = stored(rows.select("id").filter("id is not null").distinct().join(known, "id"), "labelled")
    sizes = {r[0]: r[1] for r in there.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    drawn = stored(bounded_draw(there.filter("label = 0"), "id", labelled, 31).union(bounded_draw(there.filter("label = 1"), "id", labelled, 31)), "drawn")
    # one text for an id that comes with several
    own = stored(rows.join(F.broadcast(drawn), "id").groupBy("id", "label", "fold").agg(F.min("text").alias("text")), "learnt")
    learnt = own.filter("fold != 4")
    counts = {r[0]: r[1] for r in learnt.groupBy("label").count().collect()}
    learnt, counts = (learnt, counts) if len(counts) == 2 else (own, {r[0]: r[1] for r in own.groupBy("label").count().collect()})
    field = fit_field(_sentences(learnt, _signs(learnt, counts[1], counts[0])))
    judged = _marginals(own.filter("fold = 4"), field, ["label"], False).toPandas()
    if judged["label"].nunique() < 2:
        judged = _marginals(own, field, ["label"], False).toPandas()
    judged = judged.sort_values(["top", "total", "label"])
    y = judged["label"].to_numpy(float)
    # rows of a label weigh as many as there are of it in the table
    weight = np.where(y > 0.5, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return Model(field, calibrated(judged["top"].to_numpy(float), judged["total"].to_numpy(float), y, weight * len(y) / weight.sum()))


SPANS = "array<struct<start:int,end:int,marginal:double>>"


def _marginals(rows: DataFrame, field: Field, keep: list[str], spans: bool, text_col: str = "text") -> DataFrame:
    """Columns `keep` of rows with top and total, and the spans if asked for."""
    asked = rows.select(*keep, text_or_empty(text_col).alias("tessera_text"))
    schema = asked.select(*keep, F.lit(0.0).alias("top"), F.lit(0.0).alias("total"), *([F.lit(None).cast(SPANS).alias("spans")] if spans else [])).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(field)
        for part, texts in _texts(batches, "tessera_text"):
            top, total, found = _summaries(field, words, texts, spans)
            own = [pa.array([[dict(zip(("start", "end", "marginal"), s)) for s in f] for f in found], kind)] if spans else []
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(top), pa.array(total), *own], names=[*keep, "top", "total", *["spans"] * spans])

    return asked.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, spans (start, end, marginal) of every document, from its whole text.

    Spans are runs of tokens that are toxic with a marginal of 1/2 or more, in code points; a text whose small letters are more
    code points than its capitals keeps its own offsets. Null text is scored as empty. Ids may be null (held_out: false) and repeat.
    An empty table gives an empty result; other columns are ignored. Without a model (no labels of both kinds) nothing is toxic.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("tessera_own"))
    held = F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out")
    if model is None:
        return rows.select(id_col, held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast(SPANS).alias("spans"))
    a, b, c = model.joint
    z = F.col("top") * a + F.col("total") * b + c
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return _marginals(rows, model.field, [id_col], True, "tessera_own").select(id_col, held, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "spans")
