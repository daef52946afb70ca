"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="foliate-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: computed once, and it survives lost executors.

    The shuffle files of the plan are deleted as soon as the checkpoint is there, as nothing reads them again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, so that no other plan loses its files
    finally:
        conf.set(name, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: smaller than a checkpoint, and read by columns."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A key with more than one in so many rows is hot; so there are at most so many hot keys.
HOT = 4096
#: No key with fewer rows is hot: one task takes that many narrow rows in a moment.
HOT_LEAST = 100_000


def split_join(rows: DataFrame, each: DataFrame, key: list[str], by: str, how: str = "inner", least: int | None = None) -> DataFrame:
    """``rows`` joined with ``each`` (one row a key at most), hot keys split over many tasks.

    A key that more than one in ``HOT`` rows hold is split by a hash of column ``by``, and its row of ``each`` is
    repeated for every part. Only the hot keys with their number of parts, ``HOT`` rows at most, go through the
    driver and are broadcast. ``rows`` should be durable: it is counted first.
    """
    n, least = rows.count(), HOT_LEAST if least is None else least
    if n <= least:
        return rows.join(each, key, how)
    limit = max(n // HOT, least)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = sizes.select(*key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    found = hot.collect()
    if not found:
        return rows.join(each, key, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    dealt = rows.join(few, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    repeated = each.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*key, "_part"], how).drop("_part")


#: So many rows of a few longs may be broadcast.
FEW = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (columns of fixed width only), written once and counted; to be broadcast in a join if they are ``FEW`` at most."""
    rows = durable(rows)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def as_text(column: Column) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(column.cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), as_text(F.col(text_col)).alias("text"))
