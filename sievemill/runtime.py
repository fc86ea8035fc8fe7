"""Makes the package importable on the Python workers of any cluster."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so workers need no PYTHONPATH."""
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    mark = (spark.sparkContext.applicationId, digest)
    if mark in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="sievemill-ship-")) / f"sievemill_{digest}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(mark)
