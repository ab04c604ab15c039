"""Storage, readers and small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without the ASCII white space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is unset a local session (tests, a laptop) gets a folder of its own. On a cluster
    that would be a folder no other machine sees, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="logsieve-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are; ``clean`` removes them."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def _bucketed_prefix(spark: SparkSession) -> str:
    """Bucketed tables are in the catalog, which applications share: their names tell whose they are."""
    return "logsieve_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower() + "_"


def save_bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` into the shared folder in buckets of its keys, so that joins and groups by them move no row."""
    spark = df.sparkSession
    name = f"{_bucketed_prefix(spark)}{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{tables_dir(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def clean(spark: SparkSession) -> None:
    """Remove this application's intermediate tables. Results that weren't written yet still need them."""
    for t in spark.catalog.listTables():
        if t.name.startswith(_bucketed_prefix(spark)):
            spark.sql(f"DROP TABLE {t.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of the table, not the work behind it.
    """
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 4) -> DataFrame:
    """Deal rows that cost much CPU each evenly over the cluster's cores."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism * rows))


def fold(doc_id: F.Column) -> F.Column:
    """One of five folds, by the crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: F.Column) -> F.Column:
    """Fold 0: rows whose labels are never learned from."""
    return fold(doc_id) == 0


def held_out_py(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def small_batches(spark: SparkSession, rows: int = 10_000) -> None:
    """Bound what a Python worker holds at once: few bytes to an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
