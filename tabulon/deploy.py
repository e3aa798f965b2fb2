"""Makes this package importable for Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

TOP = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers unless they find it by PYTHONPATH or their working directory; once a session."""
    context = spark.sparkContext
    seen = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(context, "_tabulon_shipped", False) or any(p and Path(p).resolve() == TOP for p in seen):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tabulon-code-"), "tabulon_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted((TOP / "tabulon").rglob("*.py")):
            z.write(path, path.relative_to(TOP))
    context.addPyFile(target)
    context._tabulon_shipped = True
