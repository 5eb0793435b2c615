"""Lines in, spoken lines out, as a stream: stateless, so no watermark and no state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbaspark.api import language_of
from verbaspark.operators import multilingual


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New text files of a folder, one row a line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumnRenamed("value", "text")


def spoken_lines(lines: DataFrame, locale: str = "en-US") -> DataFrame:
    return multilingual.normalize(lines, F.lit(language_of(locale)), "text", "spoken")


def write_lines(spoken: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing the spoken lines as text files; ``available_now``: stop once all present input is done."""
    out = spoken.select(F.col("spoken").alias("value")).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
