"""A stored word-pair index that grows while questions stream.

Postings lie in partitions by hash of the pair, a folder for each batch of pages; a batch of questions reads the partitions of its
own pairs only. A page that arrives again replaces its older version, whose postings are passed over from then on.

The index is most of what a run keeps on disk, so it is written where texts are read, without a shuffle of texts or pairs, and packed: a row
has the sorted pairs that a page has in one partition, in Parquet's delta encodings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.session import materialized

BUCKETS = 64
POSTING = "fid long, nf long, pairs array<string>, batch long, bucket int"
#: So many repeated ids are broadcast at most.
IDS_SHIPPED = 1 << 19
#: A task has a file open for each bucket, with a row group of at most so many bytes.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20)}
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _bucket(pair: str):
    return F.pmod(F.xxhash64(pair), F.lit(BUCKETS)).cast("int").alias("bucket")


def _one_each(pages: DataFrame) -> DataFrame:
    """pages with one row a doc_id. Rows whose id doesn't repeat stay where they are; of the others one each is written, so that all
    that is made of them has the same one. Only if more than IDS_SHIPPED ids repeat, all rows are dealt out by id."""
    pages = pages.filter("doc_id is not null")
    again = materialized(pages.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    n = again.count()
    if n > IDS_SHIPPED:
        return materialized(pages.dropDuplicates(["doc_id"]), "one_each")
    if not n:
        return pages
    ids = F.broadcast(again)
    kept = materialized(pages.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "one_each")
    return pages.join(ids, "doc_id", "left_anti").unionByName(kept)


def _packed(pages: DataFrame) -> DataFrame:
    """(fid, nf, pairs, bucket): the pairs of `retrieval.postings`, a row for each text and bucket, sorted; a text is handled by itself."""
    words = pages.select(F.col("doc_id").cast("long").alias("fid"), retrieval.words_of(F.col("text")).alias("words"))
    rows = words.select("fid", retrieval.distinct_pairs(F.col("words")).alias("pairs"))
    sorted_ = F.sort_array(F.transform("pairs", lambda p: F.struct(_bucket(p), p.alias("pair"))))
    rows = rows.select("fid", F.size("pairs").cast("long").alias("nf"), sorted_.alias("own")).select("fid", "nf", F.col("own.bucket").alias("buckets"), F.col("own.pair").alias("pairs"))
    # outer: see retrieval._postings
    rows = rows.select("*", F.explode_outer(F.array_distinct("buckets")).alias("bucket")).filter("bucket IS NOT NULL")
    first = F.array_position("buckets", F.col("bucket"))
    last = F.size("buckets") + 1 - F.array_position(F.reverse("buckets"), F.col("bucket"))
    return rows.select("fid", "nf", F.slice("pairs", first.cast("int"), (last - first + 1).cast("int")).alias("pairs"), "bucket")


def append(pages: DataFrame, path: str, batch: int) -> None:
    """Add pages (doc_id, text, ...) as batch number `batch`; a batch that is written again replaces itself.

    Postings are written before pages, and count only with their page: a batch that broke off shows nothing. Of rows that repeat a
    doc_id within a batch one is kept; rows without doc_id are left out.
    """
    pages, conf = _one_each(pages), pages.sparkSession.conf
    before = conf.get(WRITERS)
    # with a writer for each bucket, a task needn't sort its rows by bucket, which would spill them to disk
    conf.set(WRITERS, BUCKETS)
    try:
        _packed(pages).write.mode("overwrite").options(**PACKED).partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    finally:
        conf.set(WRITERS, before)
    pages.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/pages/batch={batch}")


def create(spark: SparkSession, path: str, schema) -> None:
    """An index without pages, of the given page schema."""
    append(spark.createDataFrame([], schema), path, -1)


def follow(pages: DataFrame, path: str, checkpoint: str, **trigger):
    """Start appending a stream of pages to the index at path, which must have been created."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            append(batch, path, number)
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all pages, with their batch."""
    return spark.read.option("basePath", f"{path}/pages").parquet(f"{path}/pages").withColumn("batch", F.col("batch").cast("long"))


def postings_for(pairs: DataFrame, path: str) -> DataFrame:
    """(fid, nf, pair, batch, bucket) in the partitions of `pairs` (pair): at most BUCKETS partition values are looked up on the driver."""
    spark = pairs.sparkSession
    own = sorted(r[0] for r in pairs.select(_bucket("pair")).distinct().collect())
    rows = spark.read.schema(POSTING).option("basePath", f"{path}/postings").parquet(f"{path}/postings")
    return rows.filter(F.col("bucket").isin(own)).select("fid", "nf", F.explode("pairs").alias("pair"), "batch", "bucket")


def candidates(questions: DataFrame, path: str, k: int) -> DataFrame:
    """Candidates of (qid, text) as `retrieval.lexical` finds them in the pages that have arrived so far, with their batch."""
    asked = retrieval.asked(questions, "qid")
    index, own = postings_for(asked, path).drop("bucket"), retrieval.shipped(asked)
    if own is not None:
        index = index.join(F.broadcast(own), "pair", "left_semi")
    # one row a page: its latest version, read from two columns
    latest = pages_of(questions.sparkSession, path).groupBy(F.col("doc_id").alias("fid")).agg(F.max("batch").alias("batch"))
    # dealt out once, by page: both the count and the join of versions find their rows together
    found = asked.join(index, "pair").drop("pair").repartition("fid", "batch")
    return retrieval.ranked(retrieval.pair_scores(retrieval.counted(found, "batch").join(latest, ["fid", "batch"]), "batch"), k)
