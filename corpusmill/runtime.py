"""What operators need of the session: the shared folder, tables that cut lineage, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications whose executors have this package.
_SHIPPED: set[str] = set()
#: Tables written by :func:`materialize`, by application.
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; the session is not changed.  A default exists in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/corpusmill/{app}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(app, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> list[str]:
    """Paths that :func:`materialize` has written and :func:`release` has not deleted."""
    return list(_TABLES.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete tables of :func:`materialize` (all of this application's, or those listed); results that read them are gone."""
    known = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    for path in list(known if paths is None else paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in known:
            known.remove(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir() and (root / "__init__.py").exists():
        path = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for base, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = Path(base) / name
                        z.write(full, full.relative_to(root.parent))
        sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
