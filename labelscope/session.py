"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on; none of them fixes a cluster size.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A page, file or key may hold a third of the rows: let AQE split its join partition.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where the next aggregate counts on the partitioning of the join: its partial
    # results are then exchanged once more, which is little beside one overfull task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The few rows a join is after may be many: let their Bloom filter thin a large scan ahead of the exchange.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    # A repeated JSON key counts once, with its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelscope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Without that setting, the checkpoint folder of the context counts; without either there
    is no folder that all of them see, and nothing is written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table of the shared folder, which cuts its lineage; it goes when the application ends."""
    spark, path = frame.sparkSession, shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(frame.schema).parquet(path)
