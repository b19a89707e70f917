"""Operators 11 to 13 against plain versions, and the cases they must stand."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import filter_audit, prefix_trie, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# 12


def plain_audit(docs, labels):
    good, toxic, least = set(), set(), {}
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        parts[source or ""].append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in x for _, x in rows) - len(gone), sum(x == {f} for _, x in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                ]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels, **more):
    frame = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in docs], DOC).repartition(3)
    for c in ("part", "mask", "n", "range_id", "lid", "spread", "good"):
        frame = frame.withColumn(c, F.lit("x"))
    out = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out.collect()}


def audit_rows():
    rng = random.Random(5)
    long = " ".join(f"w{i}é" for i in range(230))
    texts = [long, long + " x", long + " x", long, "ABC def", "a # b", "", None, " \t\n", "x " * 300, "A" + "b" * 49, "AB" + "c" * 98, "日本 | 語", long.upper(), "p" * 5000, "p" * 5000 + "q", "\x1c \x85 a"]
    docs = [(i, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for i in range(120)] + [(None, long, "s1"), (None, long, "s1"), (-5, long, "s2"), (7, texts[4], "s1"), (7, texts[4], "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    return docs, labels


def test_filter_audit(spark, monkeypatch):
    docs, labels = audit_rows()
    want = plain_audit(docs, labels)
    assert audited(spark, docs, labels) == want
    assert len(want) == 600 * len({s or "" for _, _, s in docs})
    # many ranges and blocks of few texts
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 300)
    assert audited(spark, docs, labels) == want


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
@settings(max_examples=150, deadline=None)
def test_radix_trie(texts):
    trie = filter_audit.RadixTrie()
    for i, t in enumerate(texts):
        node = trie.node(t)
        node[filter_audit.VALUE] = min(i, node[filter_audit.VALUE]) if node[filter_audit.VALUE] is not None else i
    assert sorted(trie.terminals()) == sorted((t, texts.index(t)) for t in set(texts))
    todo = [trie.root]
    while todo:  # compressed: an inner node without a terminal has two children at least
        for kid in todo.pop()[filter_audit.KIDS].values():
            assert kid[filter_audit.LABEL] and (kid[filter_audit.VALUE] is not None or len(kid[filter_audit.KIDS]) > 1)
            todo.append(kid)


@given(st.lists(st.text("ab", max_size=8), min_size=1, max_size=60), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_equal_texts_share_a_range(texts, target):
    cuts = filter_audit.splitters([(t.encode()[:4], len(t) + 1) for t in texts], 7 * len(texts), target)
    assert list(cuts.cuts) == sorted(set(cuts.cuts)) and len(cuts.parts) == len(cuts.cuts) + 1
    for t in texts:
        assert cuts.range_id(t.encode()) >> 32 == sum(c <= t.encode() for c in cuts.cuts)


# 13


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    out = {}
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    for k, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest)
    return out


def trie(spark, rows, height=prefix_trie.HEIGHT):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("k1", "p", "n", "depth", "digest", "points", "band"):
        frame = frame.withColumn(c, F.lit("x"))
    out = prefix_trie.trie_nodes(frame, height).collect()
    found = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out}
    assert len(found) == len(out)
    return found


def trie_rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 206, 999_999_999_999]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yo", "é日", "", None])) for t in range(rng.choice([1, 2, 4, 9]))]
    rows += [(300, None, "user", "first"), (300, 1, "user", "b"), (300, 1, "user", "a"), (300, 1, "user", "a"), (None, 1, "user", "lost")]
    # a long talk that others share, beyond several bands of bands
    rows += [(c, t, "user", f"t{t}") for c in (400, 401, 402) for t in range(40 + c % 3)]
    return rows


@pytest.mark.parametrize("height", [2, 3, 16])
def test_prefix_trie(spark, height):
    assert trie(spark, trie_rows(), height) == plain_trie(trie_rows())


def test_prefix_trie_of_few_rows(spark):
    assert trie(spark, []) == {} == plain_trie([])
    # nothing is left of a conversation that lends more turns than there are
    one = [(6, 0, "user", "x")]
    assert trie(spark, one) == plain_trie(one)


# 11


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    field = toxicity.Field(np.zeros(4), rng.normal(size=(2, 2)), 0.7)
    lengths = np.array([1, 5, 3, 7])
    starts = np.cumsum(lengths) - lengths
    emitted = rng.normal(size=lengths.sum())
    forward, backward = toxicity.log_odds(field, emitted, starts, lengths)
    for s, n in zip(starts, lengths):
        mass = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            p = np.exp(field.first * path[0] + emitted[s : s + n] @ path + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
            mass[np.arange(n), path] += p
        assert np.allclose(np.log(mass[:, 1] / mass[:, 0]), (forward + backward)[s : s + n])


def test_chains_end_with_sentences_and_documents():
    rows = np.array([3, 4, 0, 0, 5, *[6] * 300, 0, 7])
    starts, lengths = toxicity.chains(rows, np.array([5, len(rows)]))
    assert list(zip(starts, lengths)) == [(0, 2), (4, 1), (5, 128), (133, 128), (261, 44), (306, 1)]


def toxic_docs(n=400):
    """A toxic document holds one of two words, or a word that begins like others never seen."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Scoundrel", "scoundrel", "villain", f"grumbl{rng.choice('aeiou')}{rng.choice('xyz')}"]))
        for k in range(4, len(words), 9):
            words[k] += "."
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxic_spans(spark):
    docs, labels = toxic_docs()
    more = [(1000, None, "en", None, None), (1001, "", None, None, None), (None, "a villain", "en", "s", 1), (1002, "ab " * 50_000 + "grumbloo ba", "en", "s", None), (1002, "cab", "en", "s", None), (1003, "日本語。villain", "ja", "s", None)]
    frame = spark.createDataFrame(docs + more, DOC).repartition(3).withColumn("score", F.lit("x")).withColumn("top", F.lit("x")).withColumn("id", F.lit("x"))
    labelled = spark.createDataFrame(labels + [(None, 1, 1), (77_777, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, labelled)
    out = toxicity.score(frame, model).collect()
    assert len(out) == len(docs) + len(more)
    texts = {(i, t) for i, t, *_ in docs + more}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held if r["doc_id"] < 400} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    toxic = dict((i, t) for i, _, t in labels)
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held if r["doc_id"] in toxic]) > 0.95
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] != 1002}
    assert by[1000]["predicted"] == by[1001]["predicted"] == 0 and by[1000]["score"] == by[1001]["score"]
    assert next(r for r in out if r["doc_id"] is None)["predicted"] == 1 and not next(r for r in out if r["doc_id"] is None)["held_out"]
    assert sorted(r["predicted"] for r in out if r["doc_id"] == 1002) == [0, 1]
    text = dict((i, t) for i, t in texts if t)
    for r in out:
        if r["doc_id"] in toxic and toxic[r["doc_id"]] and r["predicted"]:
            assert any(re.match("(?i)scoundrel|villain|grumbl", text[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"])
    assert [text[1003][s["start"] : s["end"]] for s in by[1003]["spans"]] == ["villain"]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.score(docs, None).select("doc_id", "score", "predicted").collect() == [(1, 0.0, 0)]
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = toxic_docs(120)
    frame = spark.createDataFrame(docs, DOC)
    kind = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (toxicity.fit(frame, spark.createDataFrame(x, kind)) for x in (labels, flipped))
    assert one.joint == two.joint and np.array_equal(one.field.weights, two.field.weights)


# volumes, blocks and names of operators 1, 5, 7 and 8


def _rows(run, column, texts):
    import pyarrow as pa

    return [row for batch in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=[column])])) for row in batch.to_pylist()]


def test_dealt_anchors_stay_in_proportion():
    from tessera.llm import substring_dedup

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(600)]
    size = {}
    for bits in (3, 9, 14):
        rows = _rows(substring_dedup._counted(50, bits), "text", texts)
        anchors = sum(len(r["grams"]) for r in rows) // 4
        size[bits] = sum(len(r["keys"]) + len(r["counts"]) + len(r["grams"]) for r in rows) / anchors
    # bytes an anchor: 4 of its own, and at most 8 that say whose it is, however many fragments there are
    assert size[3] < 6 and max(size.values()) <= 12.01


def test_blocks_close_after_texts_of_any_length(monkeypatch):
    from tessera.llm import substring_dedup

    rng = random.Random(4)
    for length in (3000, 300_000):
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(length)) for _ in range(3_000_000 // length)]
        monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 600_000)
        assert sum(r["f"] == 0 for r in _rows(substring_dedup._counted(50, 2), "text", texts)) >= 3


def test_dealt_heads_stay_in_proportion():
    import pyarrow as pa

    from tessera.llm import ngram_join

    rng = np.random.default_rng(3)
    heads = [np.sort(rng.integers(0, 1 << 62, 60, np.uint64)) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array([100] * 900, pa.int64()), pa.array([h.tobytes() for h in heads], pa.binary())], names=["c", "n", "head"])
    for fragments in (8, 512, 16384):
        rows = [r for b in ngram_join._dealt(fragments, (1 << 62) // fragments)(iter([batch])) for r in b.to_pylist()]
        assert sum(len(r["grams"]) for r in rows) == 900 * 60 * 8
        assert sum(len(r["who"]) + len(r["counts"]) for r in rows) <= 900 * 60 * 6


def test_names_that_clash_with_the_operators_own(spark):
    import corpus_pipeline
    from tessera.llm import substring_dedup

    shared = "a passage that is much longer than fifty bytes, for sure, and comes twice"
    rows = [(1, f"one {shared} end"), (2, f"two {shared} fin"), (None, shared)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["repeat_starts", "Repeat_Ends", "repeat_id", "repeat_sha", "_starts", "_ends", "gone", "GONE_"]
    for c in names:
        frame = frame.withColumn(c, F.lit(c))
    out = substring_dedup.remove_repeats(frame, 50)
    assert out.columns == frame.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "twofin" and got[None]["text"] == shared and all(got[2][c] == c for c in names)
    assert corpus_pipeline.one_of_each_group(spark, frame, "").columns == frame.columns


def test_given_tables_have_several_pivots_and_leaves(spark, monkeypatch):
    from tessera.llm import registry, vector_dedup, vector_search

    d, seen = "/root/testdata/sf0.1", {}
    pivots, fit_tree = vector_dedup._pivots, vector_search.fit_tree
    monkeypatch.setattr(vector_dedup, "_pivots", lambda *a: seen.setdefault("pivots", pivots(*a)))
    monkeypatch.setattr(vector_search, "fit_tree", lambda *a: seen.setdefault("tree", fit_tree(*a)))
    registry.queries()["op7_metric_join"](spark, d)
    registry.queries()["op5_kmeans_tree"](spark, d)
    assert all(len(p) > 2 for p in seen["pivots"].values()) and seen["tree"].leaves >= 30
