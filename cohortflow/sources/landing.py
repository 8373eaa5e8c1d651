"""Event files landed once: Parquet by event type, with a typed column for each declared field.

Metrics over open payloads parse and probe them in every query. Landed, an outcome is a column: filters on the
event type choose folders, filters on values reach the scan, and what a query does not name is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..operators.validate import Field


def typed(payload: Column, field: Field) -> Column:
    """The field in the type that is declared for it; null where a row has another."""
    if field.type in ("int", "float"):
        return P.number(payload, field.name)
    if field.type == "bool":
        return F.when(P.kind(payload, field.name) == "BOOLEAN", F.try_variant_get(P.field(payload, field.name), "$", "boolean"))
    if field.type == "json":
        return F.to_json(P.field(payload, field.name))
    return P.string(payload, field.name)


def land(events: DataFrame, folder: str, outcomes: list[Field], traces: list[Field] = (), mode: str = "errorifexists") -> None:
    """Write events to `folder`: their columns as they are, and outcome_x, trace_x for each declared field; compressed by zstd."""
    made = [typed(F.col(payload), f).alias(f"{name}_{f.name}") for payload, name, fields in (("outcomes", "outcome", outcomes), ("traces", "trace", traces)) for f in fields]
    events.select("*", *made).write.partitionBy("event_type").mode(mode).option("compression", "zstd").parquet(folder)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
