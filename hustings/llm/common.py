"""Small pieces that several text operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: blank and the five ASCII controls.
SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """Only the columns an operator needs, so that other columns can have any name.

    A null text counts as the empty text.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *(F.col(c) for c in extra),
    )


def boxed(docs: DataFrame) -> DataFrame:
    """One column ``row`` with all columns inside, so that none clashes with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(c, UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is ``spark.checkpoint.dir``, which every executor shares.  Only a
    session on one machine that lacks the setting gets a folder of its own; on a
    cluster that is an error, as executors don't see each other's disks.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="hustings-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


#: Rows and bytes that go to a Python worker at once: a worker holds texts several times over.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of bounded bytes, however long the texts are.

    A setting of the session, so it holds for all that it runs from here on.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released(spark: SparkSession) -> None:
    """Let go of shuffle files that only finished steps needed.

    Spark removes them when the driver's objects for them are collected, which on a
    driver with memory to spare is long after a checkpoint has made them useless.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fits_broadcast(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than needed."""
    return df.limit(most_rows + 1).count() <= most_rows
