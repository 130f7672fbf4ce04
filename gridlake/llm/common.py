"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write.

    It is ``spark.checkpoint.dir`` where the session names one.  Otherwise it is a temporary folder in local
    mode, where driver and executors are one process, and a folder beside the warehouse on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            root = tempfile.mkdtemp(prefix="gridlake-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and losing an executor costs no rerun."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle whatever its estimated size.

    The estimate doesn't count the rows that explode, stack or Python make, and takes compressed files for their rows, so tables that grow with the input would be broadcast through the driver.
    """
    return df.hint("merge")


def input_columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so further columns of any name can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in names.items()])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


#: Words are runs of anything but space and \x09-\x0D; bytes.split() without arguments splits at exactly these six.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def windows_of_bytes(data: bytes, width: int) -> np.ndarray:
    """Every ``width``-byte window (4 or 8) as an unsigned integer, without copying the text."""
    n = len(data) - width + 1
    kind = {4: "<u4", 8: "<u8"}[width]
    return np.ndarray((max(n, 0),), dtype=kind, buffer=data, strides=(1,)) if n > 0 else np.empty(0, dtype=kind)
