"""Scene summaries over arriving pixels, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom import schema as S


def read_arrivals(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_extent(stream: DataFrame, time: str = "ts", key: str = "lago", value: str = "v", late: str = "1 day", window: str = "1 day", threshold: float = S.HIGH_UGL) -> DataFrame:
    """Valid and high pixels and mean of every zone and window; later rows than ``late`` are left out."""
    v = F.col(value)
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key)
    out = grouped.agg(F.count(v).alias("n_valido"), F.count_if(v >= threshold).alias("n_alto"), F.avg(v).alias("media"))
    return out.select(key, F.col("w.start").alias("inicio"), "n_valido", "n_alto", "media")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write finished windows as Parquet, then stop: a run over all that has arrived."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
