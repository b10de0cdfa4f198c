"""Feature files that keep arriving, joined with footprints as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrastock.operators.spatial import points_in_rings


def stream_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def stream_matches(points: DataFrame, rings: DataFrame, cell: float = 0.02) -> DataFrame:
    """Each arriving point with the rings whose envelope holds it: a stream joined with a table, without state."""
    return points_in_rings(rings, points, cell)
