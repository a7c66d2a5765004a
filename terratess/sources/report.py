"""The statistics table as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(path: str, report: DataFrame) -> None:
    """``error,area,min_angle,max_angle`` in order of triangles, a directory of parts written in parallel."""
    report.orderBy("tri").select("error", "area", "min_angle", "max_angle").write.mode("overwrite").csv(path, header=True)
