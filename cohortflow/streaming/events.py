"""Events as a stream: validation, first-of-id, windowed rating counts, links within a watermark. An
extension: the batch operators' rules on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..operators.validate import problems


def read(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines files as they arrive: row (VARIANT) and the file's arrival time."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).format("text").load(folder)
    return lines.select(F.try_parse_json("value").alias("row"), F.current_timestamp().alias("arrived"))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(P.is_object(F.col("row")) & (F.size(problems(F.col("row"))) == 0))


def first_of_id(events: DataFrame, time_col: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """The first event of each event_id that comes within the delay; state is as old as the delay."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, time_col: str, width: str, delay: str, *keys: str) -> DataFrame:
    """n and mean value per window and key; late events beyond the delay are dropped."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def linked(evaluations: DataFrame, selections: DataFrame, time_col: str, within: str) -> DataFrame:
    """Evaluations with their selections, which come no earlier than `within` before; unmatched ones come
    out once the watermark has passed, with null selected_at."""
    left = evaluations.withWatermark(time_col, within)
    right = selections.select(F.col("event_id").alias("_selection"), F.col(time_col).alias("selected_at")).withWatermark("selected_at", within)
    near = (F.col("selection_id") == F.col("_selection")) & (F.col("selected_at") <= F.col(time_col)) & (F.col("selected_at") >= F.col(time_col) - F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "left_outer").drop("_selection")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once into Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
