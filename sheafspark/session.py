"""Session helpers: shared scratch space, staging tables, columns computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under the shared folder of the cluster.

    It is below the folder named by ``spark.checkpoint.dir``, in one folder per
    application, which can be deleted when the application's results have been
    read. Only a local session without that setting (a test) gets a temporary
    folder of its own, which goes when the session's process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheafspark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sheafspark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    target = shared_dir(df.sparkSession)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def attach(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are costly, so that each is computed once.

    Catalyst moves a filter on a projected column below the projection and
    computes the expression a second time there. It does not do so with the
    output of a generator, so the columns come out of a one-row ``inline``.
    """
    kept = [F.col(name) for name in df.columns if name not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
