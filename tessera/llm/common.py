"""Shared folders, written tables and column handling for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the largest map that hash_test broadcasts; with more keys it lets more other rows through.
MOST_CELLS = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet at path and read it back: cuts lineage and survives lost executors."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to a path of its own in the shared folder."""
    return written(df, new_path(df.sparkSession, label))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)


class Tables:
    """Tables that one call writes on its way, to be removed once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(new_path(self.spark, label))
        return written(df, self.paths[-1])

    def remove(self, *labels: str) -> None:
        """Delete the tables of these labels (all, if none is named)."""
        gone = [p for p in self.paths if not labels or p.rsplit("/", 1)[1] in labels]
        for path in gone:
            removed(self.spark, path)
        self.paths = [p for p in self.paths if p not in gone]


def hash_test(rows: DataFrame, on: list[Column], keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose `on` may be among the rows of keys: all that are, and few others (with left_anti: the rest, none of which is).

    A bit map of hashes, sized by the number of keys and of 4 MB at most (8 MB as rows of a number and its bits), is broadcast, so that a join which then decides has
    few rows to shuffle. `on` has the types of keys' columns.
    """
    cells = min(MOST_CELLS, 64 << (keys.count() // 4).bit_length())
    word, bits = free_name("hash_word", rows.columns), free_name("hash_bits", rows.columns)

    def cell(*values: Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(cells).cast("long"))

    at = cell(*(F.col(k) for k in keys.columns))
    known = keys.select(F.shiftright(at, 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    own = cell(*on)
    return rows.join(F.broadcast(known), (F.shiftright(own, 6) == F.col(word)) & (F.getbit(F.col(bits), own.bitwiseAND(63).cast("int")) == 1), how)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of `taken` has, whatever its case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    """A text column as string, null counted as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_draw(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows (all, if fewer), drawn by hash of key. Tasks hand on about 2 n rows in total, however many tasks there are."""
    span = 1 << 30
    total = df.count()
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(span))
    return df.filter(drawn < F.lit(int(min(1.0, (2 * n + 50) / max(1, total)) * span))).orderBy(drawn, key).limit(n)
