"""Makes this package importable in Python workers wherever they start."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from terratess.staging import put

def ship(spark: SparkSession) -> None:
    """Hands the package's sources and data files to every executor, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_terratess_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package came in a zip that Spark has shipped already
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(x for x in root.rglob("*") if x.suffix in (".py", ".txt")):
                z.write(p, p.relative_to(root.parent).as_posix())
        context.addPyFile(put(spark, f"lists/terratess-{context.applicationId}.zip", held.getvalue()))
    context._terratess_shipped = True
