"""The package's own code to executors, wherever they run and whatever their Python path is."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules once for each application, through Spark's own file service."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tarnflow-code-")) / "tarnflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
        for path in package.parent.glob("corpus_pipeline.py"):
            z.write(path, path.name)
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
