"""Make this package importable on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


#: Bytes of one Arrow batch of a session that sets no limit of its own: Spark's default of 64 MB is large for small executors.
ARROW_BYTES = 8 << 20
DEFAULT_BYTES = "67108864b"
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, as --py-files would, and lower the size of Arrow batches
    where the session keeps the default; returns the session."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(_LIMIT) == DEFAULT_BYTES:
        spark.conf.set(_LIMIT, str(ARROW_BYTES))
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / f"{here.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


def shared_base(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir; only where that is unset and Spark is local,
    below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + f"/_{name}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def work_folder(spark: SparkSession) -> str:
    """A new shared folder for the files of a query."""
    return shared_base(spark, "work")


def stored(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read again, so that it is computed once and survives lost executors."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
