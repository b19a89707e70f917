"""The patch stream, the fitted encoder and the stage table against plain versions."""

import math
import random
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import conversations, encoder, retrieval, stages
from tessera.streaming import patches

PATCH = "c long, m long, text string, n long, seq long"


def test_patch_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 3, None]), rng.choice([0, 1, 2]), rng.choice([None, "x", "y", ""]), rng.choice([None, 5, 6]), s) for s in [*range(40), None, None]]
    rows += rng.sample(rows, 15)
    rng.shuffle(rows)
    keys, fields = ["c", "m"], ["text", "n"]
    messages = spark.createDataFrame([(c, m, f"old {c} {m}", 1, "kept") for c in (0, 1, 2, 9, None) for m in (0, 1, None)], "c long, m long, text string, n long, extra string")
    source, path = str(tmp_path / "source"), str(tmp_path / "newest")
    spark.createDataFrame([], PATCH).write.parquet(source)
    for n in range(0, len(rows), 15):
        spark.createDataFrame(rows[n : n + 15], PATCH).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PATCH).option("maxFilesPerTrigger", 1).parquet(source)
        patches.start(stream, path, keys, fields, str(tmp_path / "offsets")).awaitTermination()
        # what came so far
        want = conversations.patched(messages, spark.createDataFrame(rows[: n + 15], PATCH), keys, fields)
        assert sorted(map(repr, patches.applied(messages, path, keys, fields).collect())) == sorted(map(repr, want.collect()))
    # an older patch than the one that is kept isn't written
    seqs = [r["seq"] for r in spark.read.parquet(path).filter("c = 0 and m = 0").orderBy("batch").collect()]
    assert seqs == sorted(set(seqs))


def test_patches_count_again_when_state_is_forgotten(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "newest")
    one = spark.createDataFrame([(1, 1, "new", None, 7)], PATCH)
    messages = spark.createDataFrame([(1, 1, "old", 1)], "c long, m long, text string, n long")
    for row in (one, one.withColumn("seq", F.lit(3).cast("long")).withColumn("text", F.lit("late"))):
        row.write.mode("append").parquet(source)
        patches.start(spark.readStream.schema(PATCH).parquet(source), path, ["c", "m"], ["text", "n"], str(tmp_path / "offsets"), forget_s=1).awaitTermination()
    assert [tuple(r) for r in patches.applied(messages, path, ["c", "m"], ["text", "n"]).collect()] == [(1, 1, "new", 1)]


def test_encoder_weights_and_modes(spark, tmp_path):
    texts = [None, "", "one", "One two. one TWO one two", "two three four", "Été à la plage, été à la", "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("stays"))
    path = str(tmp_path / "encoder")
    encoder.save(encoder.fit(frame, cells=32), path)
    model = encoder.load(path)

    def cells(t):
        w = retrieval.WORD.findall((t or "").lower())
        return [int(md5(f"{a} {b}".encode()).hexdigest()[:8], 16) % 32 for a, b in zip(w, w[1:])]

    n = [sum(c in cells(t) for t in texts) for c in range(32)]
    weight = [math.log((len(texts) + 1) / (x + 1)) for x in n]
    got = encoder.weights(spark, model).orderBy("cell").collect()
    assert [r["n_texts"] for r in got] == n and np.allclose([r["weight"] for r in got], weight)
    for is_query in (False, True):
        out = encoder.encoded(frame, model, is_query).orderBy("doc_id")
        assert out.columns == ["doc_id", "text", "label", "embedding"]
        for t, r in zip(texts, out.collect()):
            own = cells(t)
            want = np.array([(min(1, own.count(c)) if is_query else own.count(c)) * weight[c] for c in range(32)])
            assert np.allclose(r["embedding"], want / (np.linalg.norm(want) or 1))


def test_stage_table(spark, tmp_path):
    run = stages.Stages(spark)
    kept = run.run("kept", lambda: spark.range(100).filter("id % 4 = 0"))
    assert kept.count() == 25
    assert run.run("saved", lambda: kept.groupBy((F.col("id") % 3).alias("k")).count(), lambda df: df.write.format("noop").mode("overwrite").save()) is None
    run.run("none", lambda: kept.limit(0))
    for n in ("a", "b"):
        run.append(str(tmp_path / "bench"), n)
    rows = spark.read.parquet(str(tmp_path / "bench")).filter("run = 'b'").collect()
    assert {(r["stage"], r["rows"]) for r in rows} == {("kept", 25), ("saved", 3), ("none", 0)}
    assert all(r["seconds"] > 0 and r["jobs"] > 0 for r in rows) and all(r["tasks"] > 0 for r in rows if r["rows"])
