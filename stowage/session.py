"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC keeps date arithmetic free of daylight-saving gaps; AQE picks join strategies from
# measured sizes and splits skewed join partitions, so no operator hints a data-sized broadcast.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # More tasks over more rows, so that what a task sorts at once does not grow with the tables: weekly rows compress to some ten bytes each.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    # The JVM never compiles a method above 8,000 bytes of bytecode; a stage whose loop is longer would be interpreted row by row.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A table that is partitioned by some of the join's columns stays where it is; the other side comes to it.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The shuffle files of a job go when it ends, not when the driver next collects garbage: on a cluster that can be after the whole run.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # See stowage.functions.running.stacked.
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so that later stages restart from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Without it only a local session, whose
    executor is the driver, gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession.conf.get("spark.checkpoint.dir", None), context.master))
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints, so that each later step reads only its columns.

    A table that came from here is returned as it is. The folder goes with the checkpoint folder.
    """
    if getattr(df, "_materialised", False):
        return df
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), context.master))
    folder = f"{context.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    stored = spark.read.schema(df.schema).parquet(folder)
    stored._materialised = True
    return stored


def checkpoint_folder(named: str | None, master: str) -> str:
    if named:
        return named
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="stowage-checkpoint-")
