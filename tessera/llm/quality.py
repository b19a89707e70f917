"""Quality classifier by co-training of two views.

The content view reads the text (words, signs, repetition), the metadata view reads what else a row says (source, language,
length). Both start from the labelled rows; in each round each view judges all other documents and hands some of those it is
sure of, with its label, to the other. Their calibrated probabilities are then joined by a third, small model, and every
document is scored. What the views see of the texts is written as sparse rows, which the rounds read, and the scores too,
except where documents are filtered: these are read again, so that no copy of their texts is written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import bounded_draw, stored, text_or_empty

#: Documented bound of the fit: labelled rows.
LABELLED_ROWS = 3000
ROUNDS = 4
#: A round hands this many different texts from a view to the other, drawn from all documents it is at least so sure of.
HANDED_TEXTS, SURE = 200, 0.98
BUCKETS = 1 << 11
META_BUCKETS = 64
# The signs that are counted one by one.
SIGNS = "!?.,;:|*#$%&=_-/\\<>()[]{}\"'@+~^0123456789"
# Thai and Lao, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
CONTENT_DIM = BUCKETS + len(SIGNS) + 14
META_DIM = 2 * META_BUCKETS + 4
#: Columns that described() adds.
HASH, VIEW = "tessera_text_hash", "tessera_view"
LOGITS = "tessera_content", "tessera_meta"
#: Rows that are handed to and from Python at a time.
SLICE = 1000
VIEW_TYPE = "struct<at: array<smallint>, value: array<float>>"


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def terms(words: list[str], text: str) -> list[str]:
    """The words; runs of scripts that are written without spaces are cut into pairs of characters."""
    if text.isascii() or not UNSPACED.search(text):
        return words
    out = []
    for word in words:
        at = 0
        for m in UNSPACED.finditer(word):
            run = m[0]
            out += [word[at : m.start()]] if at < m.start() else []
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            at = m.end()
        out += [word[at:]] if at < len(word) else []
    return out


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = b = _bucket(word, BUCKETS)
        return b


def statistics(text: str, words: list[str]) -> list[float]:
    """How a text is built, from all of it."""
    n, w = max(1, len(text)), max(1, len(words))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)] + [0, 0, 0]
    lines = text.split("\n")
    known = Counter(lines)
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text)) / n
    plain = sum(map(str.isalpha, words)) / w
    return [
        1.0, np.log1p(w) / 10, len(counts) / w, top[0] / w, sum(top[:3]) / w, sum(c for c in counts.values() if c > 1) / w, len(known) / len(lines),
        known.most_common(1)[0][1] / len(lines), np.log1p(n / len(lines)) / 10, letters / w / 10, min(1.0, max(map(len, words), default=0) / 100), upper, plain,
        len(counts) / w * np.log1p(w) / 10,
    ]


def content_features(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Sparse (columns, values): words' shares by bucket, signs' shares, statistics."""
    words = text.split()
    if words:
        own = terms(words, text)
        at, n = np.unique(np.fromiter(map(buckets.__getitem__, own), np.int64, len(own)), return_counts=True)
        share = np.sqrt(n / len(own))
    else:
        at, share = np.zeros(0, np.int64), np.zeros(0)
    length = max(1, len(text))
    signs = np.array([np.sqrt(text.count(s) / length) for s in SIGNS])
    rest = np.array([*signs, *statistics(text, words)])
    return np.r_[at, BUCKETS + np.arange(len(rest))], np.r_[share, rest]


def meta_features(source, lang, n_chars) -> np.ndarray:
    out = np.zeros(META_DIM)
    out[_bucket(f"s:{source}", META_BUCKETS)] = 1
    out[META_BUCKETS + _bucket(f"l:{lang}", META_BUCKETS)] = 1
    known = n_chars is not None and n_chars == n_chars
    size = np.log1p(max(0.0, float(n_chars))) / 10 if known else 0.0
    out[-4:] = 1.0, size, size * size, float(known)
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights of a ridge logistic regression, by accelerated gradient steps."""
    x, weight, y = (a.astype(np.float32, copy=False) for a in (x, weight, y))
    n = weight.sum()
    rate = np.float32(4 / max(1e-9, float(weight @ np.einsum("ij,ij->i", x, x)) / n))
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(1, steps + 1):
        grad = x.T @ (weight * (_sigmoid(x @ v) - y)) / n + np.float32(ridge) * v
        new = v - rate * grad
        v = new + np.float32((k - 1) / (k + 2)) * (new - w)
        w = new
    return w.astype(np.float64)


def fit_scale(z: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Platt calibration: probability = sigmoid(a z + b), by Newton steps."""
    x = np.stack([z, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (w - [1, 0])), -1, 1)
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class Model:
    """handed: for each round, how many texts the content view and the metadata view handed over."""

    content: np.ndarray
    meta: np.ndarray
    content_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    joint: tuple[float, float, float]
    threshold: float
    handed: tuple[tuple[int, int], ...]

    def score(self, content_logit: np.ndarray, meta_logit: np.ndarray) -> np.ndarray:
        a, b, c = self.joint
        first = self.content_scale[0] * content_logit + self.content_scale[1]
        second = self.meta_scale[0] * meta_logit + self.meta_scale[1]
        return _sigmoid(a * first + b * second + c)


#: (round, content weights, metadata weights, texts to hand over by label) -> what each view hands over: dense rows, labels
Pick = Callable[[int, np.ndarray, np.ndarray, tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]


def co_train(x: np.ndarray, y: np.ndarray, pick: Pick, rounds: int = ROUNDS, handed_texts: int = HANDED_TEXTS, keep_good: float = 0.995) -> Model:
    """Fit both views with exchanged pseudo-labels; a fifth of the labelled rows is held back for calibration.

    Labels are handed over in the labelled rows' proportion. threshold: the lowest score that at least keep_good of the
    held-back good rows reach, at most 1/2, so that rejecting below it spares good documents.
    """
    held = np.arange(len(y)) % 5 == 4
    held = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    fit = ~held if (~held).any() and 0 < y[~held].sum() < (~held).sum() else np.ones(len(y), bool)
    base = max(0.02, min(0.98, float(y[fit].mean())))
    good = round(handed_texts * base)
    views = slice(0, CONTENT_DIM), slice(CONTENT_DIM, None)
    # what each view may learn from: its own copy of the labelled rows, and what the other view hands over
    taught = [(x[fit, v], y[fit], np.ones(fit.sum())) for v in views]
    handed = []
    for turn in range(rounds + 1):
        weights = [fit_logistic(rows, to, np.where(to > 0.5, 0.5 / base, 0.5 / (1 - base)) * weight) for rows, to, weight in taught]
        if turn == rounds:
            break
        given = pick(turn, weights[0], weights[1], (handed_texts - good, good))
        for (rows, to), other in zip(given, (1, 0)):
            old = taught[other]
            taught[other] = np.concatenate([old[0], rows[:, views[other]]]), np.r_[old[1], to], np.r_[old[2], np.full(len(to), 0.3)]
        handed.append(tuple(len(to) for _, to in given))
    z = [x[held, v] @ w for v, w in zip(views, weights)]
    scale = [fit_scale(v, y[held]) for v in z]
    first, second = (a * v + b for v, (a, b) in zip(z, scale))
    w = fit_logistic(np.stack([first, second, np.ones(len(first))], axis=1), y[held], np.ones(held.sum()), ridge=1e-3)
    model = Model(weights[0], weights[1], scale[0], scale[1], tuple(w.tolist()), 0.5, tuple(handed))
    ranked = np.sort(model.score(z[0], z[1])[y[held] > 0.5])
    # less a hair, as tasks add in another order
    cut = float(min(0.5, ranked[int((1 - keep_good) * len(ranked))] - 1e-6)) if len(ranked) else 0.0
    return Model(**{**model.__dict__, "threshold": cut})


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            yield batch.slice(start, SLICE)


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *arrays]).astype(kind)))


def _asked(docs: DataFrame, text_col: str, keep_text: bool) -> tuple[DataFrame, list[str], StructType]:
    """What the views read, the columns of docs among it that stay, and the columns of described rows."""

    def column(name, kind):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(f"tessera_{name}")

    own = [c for c in docs.columns if keep_text or c != text_col]
    asked = docs.select(
        *(F.col(f"`{c}`") for c in own), F.xxhash64(text_or_empty(text_col)).alias(HASH), text_or_empty(text_col).alias("tessera_text"),
        column("source", "string"), column("lang", "string"), column("n_chars", "double"),
    )
    schema = asked.select(*(F.col(f"`{c}`") for c in own), HASH, F.lit(None).cast(VIEW_TYPE).alias(VIEW)).schema
    return asked, own, schema


def _views(own: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in _slices(batches):
            at, value = [], []
            for t, *known in zip(*(batch.column(f"tessera_{c}").to_pylist() for c in ("text", "source", "lang", "n_chars"))):
                columns, share = content_features(t, buckets)
                meta = meta_features(*known)
                place = meta.nonzero()[0]
                at.append(np.r_[columns, CONTENT_DIM + place])
                value.append(np.r_[share, meta[place]])
            view = pa.StructArray.from_arrays([_lists(at, np.int16), _lists(value, np.float32)], names=["at", "value"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*own, HASH)), view], names=[*own, HASH, VIEW])

    return run


def described(docs: DataFrame, text_col: str = "text", keep_text: bool = True, store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """docs, a hash of each text and what the views see of each row, written; docs that are described already as they are."""
    if VIEW in docs.columns:
        return docs
    asked, own, schema = _asked(docs, text_col, keep_text)
    return store(asked.mapInArrow(_views(own), schema), "described")


def _weighed(own: list[str], content: np.ndarray, meta: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    both = np.r_[content, np.zeros(META_DIM)], np.r_[np.zeros(CONTENT_DIM), meta]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            view = batch.column(VIEW)
            at, value = view.field("at"), view.field("value")
            row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            columns, values = at.flatten().to_numpy(), value.flatten().to_numpy()
            sums = [pa.array(np.bincount(row, w[columns] * values, len(at))) for w in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *sums], names=[*own, *LOGITS])

    return run


def _logits(rows: DataFrame, content: np.ndarray, meta: np.ndarray, text_col: str = "text") -> DataFrame:
    """Rows with both views' weighted sums, as two columns in place of VIEW; rows that aren't described yet are so on the way."""
    steps = []
    if VIEW not in rows.columns:
        rows, own, schema = _asked(rows, text_col, True)
        steps.append(_views(own))
    else:
        schema = rows.schema
    own = [f for f in schema if f.name != VIEW]
    steps.append(_weighed([f.name for f in own], content, meta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return rows.mapInArrow(run, StructType([*own, *(StructField(c, DoubleType()) for c in LOGITS)]))


def _dense(table: pa.Table) -> np.ndarray:
    """A dense row of each of table's sparse ones."""
    out, row = np.zeros((len(table), CONTENT_DIM + META_DIM), np.float32), 0
    for batch in table.select(["at", "value"]).to_batches(100):
        at, value = batch.column("at"), batch.column("value")
        lengths = np.diff(at.offsets.to_numpy())
        out[row + np.repeat(np.arange(len(at)), lengths), at.flatten().to_numpy()] = value.flatten().to_numpy()
        row += len(batch)
    return out


def _one_each(rows: DataFrame, *by: str) -> tuple[pd.DataFrame, np.ndarray]:
    """For each value of `by` one row, whatever the number of copies: `by` and the text's hash, and what the views see, dense.

    Callers bound the number of values. It comes as Arrow columns, as rows of Python objects take the driver many times the memory.
    """
    found = rows.groupBy(*by).agg(F.max(F.struct(HASH, VIEW)).alias("v")).select(*by, F.col(f"v.{HASH}").alias("text"), f"v.{VIEW}.at", f"v.{VIEW}.value").toArrow()
    return found.select([*by, "text"]).to_pandas(), _dense(found)


def _hashes(spark: SparkSession, values: set) -> DataFrame:
    return spark.createDataFrame([(int(h),) for h in sorted(values)], f"{HASH} long")


def _picker(rows: DataFrame) -> Pick:
    """Hands over texts of `rows`: all rows are judged, and of those a view is sure of, some texts are drawn by hash.

    A round reads the written views twice, to judge and to fetch the drawn; about twice HANDED_TEXTS hashes reach the driver.
    """
    spark, taken = rows.sparkSession, {"content": set(), "meta": set()}
    span = 1 << 30

    def pick(turn: int, content: np.ndarray, meta: np.ndarray, sizes: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        z = _logits(rows.select(HASH, VIEW), content, meta).toDF(HASH, "content", "meta")
        sure = float(np.log(SURE / (1 - SURE)))
        judged = stored(z.filter((F.abs("content") >= sure) | (F.abs("meta") >= sure)), "judged")
        groups = [(name, label, F.col(name) >= sure if label else F.col(name) <= -sure) for name in taken for label in (0, 1)]
        texts = judged.agg(*(F.approx_count_distinct(F.when(test, F.col(HASH))).alias(f"{name}{label}") for name, label, test in groups)).first()
        draw = F.pmod(F.xxhash64(F.col(HASH), F.lit(turn)), F.lit(span))

        def within(name, label, test):
            wanted = 2 * sizes[label] + len(taken[name]) + 50
            return F.when(test & (draw < int(min(1.0, wanted / max(1, texts[f"{name}{label}"])) * span)), F.lit(label))

        drawn = judged.select(HASH, draw.alias("draw"), *(F.coalesce(*(within(*g) for g in groups if g[0] == name)).alias(name) for name in taken))
        drawn = drawn.filter("content is not null or meta is not null").distinct().toPandas().sort_values(["draw", HASH])
        chosen = {}
        for name, known in taken.items():
            new = drawn[drawn[name].notna() & ~drawn[HASH].isin(known)].drop_duplicates(HASH)
            chosen[name] = pd.concat([new[new[name] == label].head(sizes[label]) for label in (0, 1)])
            known.update(chosen[name][HASH].tolist())
        wanted = _hashes(spark, {h for c in chosen.values() for h in c[HASH]})
        found, x = _one_each(rows.join(F.broadcast(wanted), HASH), HASH)
        place = {h: i for i, h in enumerate(found[HASH])}
        return [(x[[place[h] for h in c[HASH]]], c[name].to_numpy(float)) for name, c in chosen.items()]

    return pick


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED_ROWS) -> Model | None:
    """Fit on at most `labelled` labelled rows, drawn by hash of the id; None if a class has no label.

    All documents whose text isn't among those rows may get pseudo-labels. Labels other than 0 and 1, null ids and labels
    without document are ignored; of an id labelled twice, the larger counts; of an id with several texts, one is learnt.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("lid")).agg(F.max(label_col).cast("double").alias("label"))
    rows = described(docs, text_col, keep_text=False).select(F.col(id_col).cast("long").alias("id"), HASH, VIEW)
    ids = rows.select("id").filter("id is not null").distinct()
    # the drawn ids first: views are read for them only
    drawn = stored(bounded_draw(ids.join(known, ids["id"] == known["lid"]).select("id", "label"), "id", labelled, 23), "drawn")
    sample, x = _one_each(rows.join(F.broadcast(drawn), "id"), "id", "label")
    # in the order of the draw, so that what is held back is not a matter of ids
    sample = sample.assign(at_draw=[_bucket(str(i), 1 << 30) for i in sample["id"]]).sort_values(["at_draw", "id"])
    x, y = x[sample.index], sample["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    learnt = _hashes(docs.sparkSession, set(sample["text"]))
    return co_train(x, y, _picker(rows.join(F.broadcast(learnt), HASH, "left_anti")))


def _judged(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """docs, described or not, with the views' calibrated logits and the joint score."""
    (a, b), (c, d), (e, f, g) = model.content_scale, model.meta_scale, model.joint
    rows = _logits(docs, model.content, model.meta, text_col)
    first, second = F.col(LOGITS[0]) * a + b, F.col(LOGITS[1]) * c + d

    def probability(z):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    return rows.withColumn("tessera_p", F.struct(probability(first).alias("content"), probability(second).alias("meta"), probability(first * e + second * f + g).alias("score")))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, content_score, meta_score, score, kept of every document, from its whole text.

    Null text is scored as empty, null metadata as unknown; ids may be null; repeated rows are scored each; an empty table
    gives an empty result; columns other than id, text, source, lang and n_chars are ignored. Without a model (no labels of
    both classes) scores are null and all documents are kept.
    """
    if model is None:
        void = F.lit(None).cast("double")
        return docs.select(F.col(id_col).cast("long").alias(id_col), void.alias("content_score"), void.alias("meta_score"), void.alias("score"), F.lit(True).alias("kept"))
    p = F.col("tessera_p")
    return _judged(described(docs, text_col, False), model, text_col).select(
        F.col(id_col).cast("long").alias(id_col), p["content"].alias("content_score"), p["meta"].alias("meta_score"), p["score"].alias("score"),
        (p["score"] >= model.threshold).alias("kept"),
    )


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents the classifier keeps, with all their columns. Rows without id are kept as scored by their text.

    Of docs that aren't described, the views are made in the same pass and nothing is written.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (HASH, VIEW)]
    if model is None:
        return docs.select(*own)
    return _judged(docs, model, text_col).filter(F.col("tessera_p.score") >= model.threshold).select(*own)
