"""Sessions: the package on the workers, and a local session for tests and benchmarks."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch to a Python worker, where the session doesn't say: rows are texts of any length, so a number of rows bounds nothing.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session, once, and bound the batches that they get."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    if app in _shipped:
        return spark
    root = Path(__file__).parent
    files = sorted(root.rglob("*.py"))
    name = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), f"tidemark_{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f"tidemark/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
    return spark


def local_session(cores: int = 8, partitions: int = 8, name: str = "tidemark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
