"""What the operators of this package share: the shared folder, tables that cut lineage, ids, Bloom filters."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of a Bloom filter. Its size is fixed: a fuller filter lets more rows through to the exact join behind it.
BLOOM_BITS = 1 << 23


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the checkpoint folder of the context; without either nothing is written."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Hands texts to Python in batches of some megabytes, so that memory does not hang on their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


class Scratch:
    """Tables of the shared folder that cut lineage. They go when the owner drops them, at the latest when the application ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.path)
        small_batches(spark)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        """For when everything that reads these tables has been written itself."""
        self.files.delete(self.path, True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table of a scratch of its own."""
    return Scratch(frame.sparkSession).write(frame, name)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bloom(keys: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes; the driver gets ``bits / 64`` rows at most."""
    key = F.col(column)
    places = F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1)))
    rows = (
        keys.select(F.explode(places).alias("place"))
        .groupBy(F.shiftrightunsigned("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
        .toPandas()
    )
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return words


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    found = np.ones(len(keys), dtype=bool)
    for part in (keys, keys >> np.uint64(32)):
        place = part & np.uint64(len(words) * 64 - 1)
        found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found
