"""Sums per slice of a volume whose voxels arrive as files.

The reference capabilities have no streams; a scanner's slices do arrive one by
one, and these are the sums that equalising starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.plans.scratch import folder, materialise


def slice_sums(voxels: DataFrame, least: int) -> DataFrame:
    """Running sums per slice of values above ``least``; a streaming or a plain voxel table."""
    return voxels.where(F.col("v") > least).groupBy("z").agg(F.sum("v").alias("raw"), F.count("*").alias("n"))


def streamed_sums(spark: SparkSession, voxels: DataFrame, least: int, files_a_batch: int = 2) -> DataFrame:
    """The sums of a stream over the files of ``voxels``, after all that is there has been read.

    State and offsets are kept in the shared folder, so a stream that breaks
    off goes on where it stood; each batch replaces the result.
    """
    arrived, at = materialise(voxels.select("x", "y", "z", "v"), "arrived"), folder(spark)
    path = arrived.inputFiles()[0].rsplit("/", 1)[0] if arrived.inputFiles() else None
    if path is None:
        return slice_sums(voxels, least)
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    put = lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/sums")
    run = slice_sums(stream, least).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/sums")
