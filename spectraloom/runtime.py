"""Session-level helpers: quoted column access and durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of the tables in use.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def col(name: str) -> Column:
    """Column by its literal name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, as no other folder is known to be shared.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
            where = tempfile.mkdtemp(prefix="loom-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Cuts the lineage; the files survive the loss of any executor. They are
    deleted when the driver's Python exits, or by ``release``. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_delete, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned and nothing will read again."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        pass


def runs(table: pa.Table, by: Sequence[str], tables: bool = True) -> list:
    """Slices, or their bounds, of neighbouring rows that are equal in the columns ``by``, of which null is one value."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        code = table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    ends = [*np.flatnonzero(new).tolist(), table.num_rows]
    bounds = list(zip(ends[:-1], ends[1:]))
    return [table.slice(i, j - i) for i, j in bounds] if tables else bounds
