"""Session helpers: the shared folder for cut lineage, and settled small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    On a local master the setting may be missing (tests); then a fresh temporary
    folder is used. On a cluster a missing setting is an error, because a
    machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="moderata-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it as a table in the shared folder.

    Used where a result feeds several branches, or where its row numbers must
    not change if an executor is lost and a stage is run again. A written table
    is computed in one pass (a checkpoint runs its last stage twice), its columns
    can be pruned and its rows are counted from the file footers.
    """
    spark = df.sparkSession
    path = new_folder(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing will read again, so that scratch does not add up over a job."""
    for table in tables:
        spark = table.sparkSession
        context = spark.sparkContext
        folder = shared_dir(spark).rstrip("/")
        held = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
        for path in held:
            name = path.rsplit("/", 1)[1]
            if not name.startswith("settled-"):
                raise ValueError(f"not a settled table: {path}")
            own = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            own.getFileSystem(context._jsc.hadoopConfiguration()).delete(own, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small scan over all cores before expensive work on each row.

    A table in one small file is read by one task however many cores there are.
    Only a scan with fewer partitions than the cluster has cores is moved; a
    large table stays where it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
