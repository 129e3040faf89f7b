"""Writing indexed documents: whole documents are replaced, never patched."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share; one of our own only under a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/corpusloom-streams"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, so what several steps read is computed once and outlives executors."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(rows: DataFrame) -> None:
    """Deletes a table of kept() that no later step reads."""
    spark = rows.sparkSession
    for path in {f.rpartition("/")[0] for f in rows.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_documents(rows: DataFrame, path: str, partition: str = "kb_id", key: str = "document_id", buckets: int = 64) -> None:
    """Replaces the documents that rows hold and leaves all others; a repeated run leaves the same table.

    The table is partitioned by base and by bucket of the document. Only partitions that get rows are read, without the documents
    that are replaced, and overwritten with what is left and the new rows, so a call costs the touched buckets, not a base. A
    document that has moved to another base is also taken out of the partitions it left, if they are among the touched ones.
    """
    spark = rows.sparkSession
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        touched = new.select(partition, "bucket").distinct()
        rest = old.join(F.broadcast(touched), [partition, "bucket"], "left_semi").join(new.select(key).distinct(), key, "left_anti")
        new = new.unionByName(rest)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "bucket").parquet(path)
